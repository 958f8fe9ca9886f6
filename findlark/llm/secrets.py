"""Operator 4: secret scans by one combined deterministic automaton.

All rules are compiled into one minimal byte automaton (``automaton.Dfa``). A
single backward pass over the bytes of a chunk finds every place where a match
of any rule begins; from those few places each rule's own automaton takes the
longest match, leftmost first and without overlap within a kind. The data never
leave their partition: no shuffle, and what is shipped to the executors is the
rule list.

Defined results: null or empty text has no spans; NUL bytes in texts end every
match like any other byte no rule allows; offsets are code points; equal rows
give equal results; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import common
from .automaton import Dfa, longest, scan_back


@dataclass(frozen=True)
class Rule:
    """more: what a match may go on with, the longest way. least: matches with fewer characters are dropped. value: pattern whose group 1 is the secret, which needs least_value characters."""

    kind: str
    pattern: str
    least: int = 1
    value: str = ""
    least_value: int = 0
    more: str = ""


_WORD = "(?i:password|passwd|secret|token|api_?key)"
_SEP = "[\"']?\\x20*[:=]\\x20*[\"']?"
BASE = (
    Rule("assign", _WORD + _SEP + "[A-Za-z0-9+/_.=\\-]+", value=_WORD + _SEP + "([A-Za-z0-9+/_.=\\-]+)", least_value=6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    # As long runs only: the leftmost maximal runs of 24 or more are the same.
    Rule("hex", "[0-9a-f]{24,}", least=24),
)
_BODY = "A-Za-z0-9+/=:,\\\\\\x09\\x0A\\x0D\\x20"
MORE = (
    # The key to its END line; without one, the full lines of base64 that follow.
    Rule("pem", "-----BEGIN\\x20[A-Z\\x20]*PRIVATE\\x20KEY-----", more=f"([{_BODY}]|-[{_BODY}])*-----END\\x20[A-Z\\x20]*PRIVATE\\x20KEY-----|([\\x09\\x0A\\x0D\\x20]*[A-Za-z0-9+/=]{{32,}})+"),
    Rule("hosting", "gh[opusr]_[A-Za-z0-9]+", least=40),
    Rule("jwt", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9\\-]+", least=20),
    Rule("cloud", "AIza[A-Za-z0-9_\\-]+", least=39),
    Rule("payment", "[rs]k_(live|test)_[A-Za-z0-9]+", least=24),
    Rule("login", "://[A-Za-z0-9_.%\\-]+:[A-Za-z0-9_.%!$&*+\\-]+@"),
)
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Dfa([r.pattern for r in rules], reverse=True)
        self.each = [Dfa([f"{r.pattern}({r.more})?" if r.more else r.pattern], anchored=True) for r in rules]
        self.value = [re.compile(r.value) if r.value else None for r in rules]

    def spans(self, texts: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
        """(rule number, start, end) in code points, by start and rule, of each text that has any."""
        joined = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", "\0")
        data = np.frombuffer(joined.buffers()[2], dtype=np.uint8) if joined.buffers()[2] else np.empty(0, np.uint8)
        offsets = np.frombuffer(joined.buffers()[1], dtype=np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        places, masks = scan_back(self.all, data)
        row = np.searchsorted(offsets, places, side="right") - 1
        found: dict[int, list[tuple[int, int, int]]] = {}
        cuts = np.flatnonzero(np.diff(row, prepend=-1)).tolist() + [len(row)]
        for a, b in zip(cuts, cuts[1:]):
            i = int(row[a])
            own = data[offsets[i] : offsets[i + 1] - 1]
            raw, point, got = own.tobytes(), None, []
            for k, rule in enumerate(self.rules):
                at = 0
                for p in (places[a:b][(masks[a:b] >> k) & 1 == 1] - offsets[i]).tolist():
                    if p < at:
                        continue
                    at = longest(self.each[k], raw, p)
                    if at - p < rule.least:
                        continue
                    if self.value[k] and len(self.value[k].fullmatch(raw[p:at].decode()).group(1)) < rule.least_value:
                        continue
                    if point is None:
                        point = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    got.append((k, int(point[p]), int(point[at])))
            if got:
                found[i] = sorted(got, key=lambda s: (s[1], s[0]))
        return found


@lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])
DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All spans of every text. docs needs doc_id and text; rules begins with BASE."""

    def run(batches):
        s = scanner(rules)
        none = hashlib.sha256(b"").hexdigest()
        for b in common.chunks(batches):
            found = s.spans(b.column("text"))
            n = b.num_rows
            counts = [[0] * n for _ in BASE]
            sha, spans, total = [none] * n, [""] * n, [0] * n
            for i, got in found.items():
                parts = [f"{rules[k].kind}:{x}:{y}" for k, x, y in got]
                base = [p for p, (k, _, _) in zip(parts, got) if k < len(BASE)]
                for k, _, _ in got:
                    if k < len(BASE):
                        counts[k][i] += 1
                sha[i], spans[i], total[i] = hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(parts), len(got)
            yield common.batch(SCHEMA, b.column("doc_id"), *counts, sha, spans, total)

    common.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, DDL)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span of its texts replaced by ``[kind]``; overlapping spans are replaced together, under the first one's kind. All columns stay; n_chars, where there is one, is the new length. Null stays null."""
    names = docs.columns
    schema = docs.schema

    def run(batches):
        s = scanner(rules)
        for b in common.chunks(batches):
            found = s.spans(b.column("text"))
            if not found:
                yield b
                continue
            texts = b.column("text").to_pylist()
            for i, got in found.items():
                out, at, text = [], 0, texts[i]
                for k, x, y in got:
                    if x >= at:
                        out += [text[at:x], f"[{rules[k].kind}]"]
                    at = max(at, y)
                texts[i] = "".join(out) + text[at:]
            new = pa.array(texts, type=b.schema.field("text").type)
            columns = [new if c == "text" else b.column(c) for c in names]
            if "n_chars" in names:
                j = names.index("n_chars")
                lens = pc.utf8_length(new)
                changed = pa.array([i in found for i in range(b.num_rows)])
                columns[j] = pc.if_else(changed, lens.cast(b.schema.field("n_chars").type), b.column("n_chars"))
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.load(spark, sf_dir, "documents")).drop("n_spans")
