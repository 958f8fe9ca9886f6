"""Highlighted fragments of a text for a query. Offsets are UTF-8 bytes, so fragment sizes do not depend on the script."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.analysis import ALNUM, Analyzer
from ..plans.ast import NOT, Boolean, Phrase, Prefix, Query, QueryError, Term, bind
from ..plans.parser import parse

_RUN = regex.compile(ALNUM)
FRAGMENTS = "array<struct<text: string, matches: int>>"


@dataclass(frozen=True)
class Style:
    open: str = "<mark>"
    close: str = "</mark>"
    fragments: int = 3
    size: int = 150
    ellipsis: str = " ... "


@dataclass(frozen=True)
class Wanted:
    """What to mark: exact tokens and token prefixes."""

    exact: frozenset[str] = frozenset()
    prefixes: tuple[str, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.exact or self.prefixes)

    def hits(self, token: str) -> bool:
        return token in self.exact or any(token.startswith(p) for p in self.prefixes)


def plain(text: str, analyzer: Analyzer) -> Wanted:
    return Wanted(frozenset(analyzer.tokens(text)))


def wanted(query: str | Query, analyzer: Analyzer, field: str | None = None) -> Wanted:
    """Tokens of all clauses that are not excluded; a query that cannot be read, or asks for nothing, is plain text. field: mark only what a query asks of it."""
    try:
        q = parse(query) if isinstance(query, str) else query
    except QueryError:
        return plain(query, analyzer)
    exact: set[str] = set()
    prefixes: list[str] = []

    def walk(q: Query | None) -> None:
        if q is None:
            return
        if isinstance(q, Boolean):
            for c in q.clauses:
                if c.occur != NOT:
                    walk(c.query)
        elif field is not None and q.field and q.field != field:
            return
        elif isinstance(q, Prefix):
            prefixes.extend(analyzer.tokens(q.text))
        elif isinstance(q, Term | Phrase):
            exact.update(analyzer.tokens(q.text))

    walk(bind(q, ""))
    got = Wanted(frozenset(exact), tuple(dict.fromkeys(prefixes)))
    return got or (plain(query, analyzer) if isinstance(query, str) else got)


def matches(text: str, want: Wanted, analyzer: Analyzer) -> list[tuple[int, int]]:
    """(start, end) in bytes of the alphanumeric runs whose tokens are wanted."""
    out, at, byte = [], 0, 0
    for m in _RUN.finditer(text):
        byte += len(text[at : m.start()].encode())
        end = byte + len(m.group().encode())
        if any(want.hits(t) for t in analyzer.tokens(m.group())):
            out.append((byte, end))
        at, byte = m.end(), end
    return out


def _boundary(data: bytes, at: int, step: int) -> int:
    """From at, outward, to the edge of the word that at lies in."""

    def inside(i: int) -> bool:
        if not 0 <= i < len(data):
            return False
        return data[i] >= 0x80 or chr(data[i]).isalnum()

    while (inside(at - 1) and inside(at)) if 0 < at < len(data) else False:
        at += step
    return at


def fragments(text: str | None, want: Wanted, analyzer: Analyzer, style: Style = Style()) -> list[tuple[str, int]]:
    """Up to style.fragments pieces of the text with most matches, in text order, with marks."""
    if not text or not want:
        return []
    size, most = style.size if style.size > 0 else 150, style.fragments if style.fragments > 0 else 3
    found = matches(text, want, analyzer)
    clusters: list[list[tuple[int, int]]] = []
    for m in found:
        if clusters and m[1] - clusters[-1][0][0] <= size:
            clusters[-1].append(m)
        else:
            clusters.append([m])
    clusters = sorted(sorted(clusters, key=lambda c: -len(c))[:most], key=lambda c: c[0][0])
    data, out = text.encode(), []
    for c in clusters:
        pad = max(0, (size - (c[-1][1] - c[0][0])) // 2)
        a = _boundary(data, max(0, c[0][0] - pad), -1)
        e = _boundary(data, min(len(data), c[-1][1] + pad), 1)
        piece, at = [style.ellipsis.lstrip() if a > 0 else ""], a
        for s, t in c:
            piece += [data[at:s].decode(), style.open, data[s:t].decode(), style.close]
            at = t
        piece += [data[at:e].decode(), style.ellipsis.rstrip() if e < len(data) else ""]
        out.append(("".join(piece), len(c)))
    return out


def highlight_column(text: Column, want: Wanted, analyzer: Analyzer, style: Style = Style()) -> Column:
    """Fragments of a text column (Arrow batches; the plan of the query is made once, on the driver)."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("matches", pa.int32())]))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[{"text": t, "matches": n} for t, n in fragments(x, want, analyzer, style)] for x in texts.to_pylist()], kind)

    return F.arrow_udf(run, FRAGMENTS)(text)
