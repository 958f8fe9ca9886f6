"""Operator 5: quality rules and line labelling by a linear-chain CRF.

Lines with words get binary features (length, symbols, repetition, layout,
place); Viterbi decoding of a two-label conditional random field marks each as
content or boilerplate, and a document stays if enough of its words stand in
content lines. The weights are learned on the driver from a bounded sample of
labelled documents (``per_class`` of each quality): lines of low-quality
documents that look suspect, and repeated lines, are taken as boilerplate; the
share that decides retention is the one that fits the labels best. Everything
over the whole table is one narrow pass with no shuffle.

Defined results: null, empty and word-free texts have zero counts and fail the
base rules (n_words < 50); a tie of two labelings goes to content; without
labels the fixed start weights decide; repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .toxicity import sample

FEATURES = 24


class Lines:
    """Word-bearing lines of a chunk: document (doc), feature matrix x, words, and the base counts of each document."""

    def __init__(self, texts: pa.Array):
        n = len(texts)
        lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        lines = lists.flatten()
        doc = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
        w = common.Words(lines)
        chars = np.asarray(pc.utf8_length(w.vocab), dtype=np.int64)
        marks = np.asarray(pc.count_substring_regex(w.vocab, r"[#*$%&|<>]"), dtype=np.int64)
        total = lambda v: np.bincount(w.row, weights=v[w.ids], minlength=len(doc))
        there = np.flatnonzero(w.count > 0)
        lc, lm, lw = total(chars), total(marks), w.count
        has = lambda pattern: np.asarray(pc.match_substring_regex(w.vocab, pattern), dtype=np.float64)
        digits = total(has(r"[0-9]"))
        links = total(has(r"://|@|www\."))
        rights = total(has(r"(?i)licen[sc]|copyright|©|rights|terms|cookie|privacy|subscribe"))
        capital = total(has(r"^\p{Lu}"))
        ends = np.zeros(len(doc))
        last = w.ids[(w.start + w.count - 1)[there]] if len(there) else np.empty(0, np.int64)
        ends[there] = has(r"[.!?][\"')\]]*$")[last] if len(last) else 0
        # Distinct words of each line, and words that repeat the one before.
        key = common.distinct(w.row.astype(np.int64) << 32 | w.ids) >> 32
        distinct = np.bincount(key, minlength=len(doc))
        again = np.bincount(w.row[1:][(w.ids[1:] == w.ids[:-1]) & (w.row[1:] == w.row[:-1])], minlength=len(doc)) if len(w.ids) else np.zeros(len(doc))
        # Lines equal to an earlier one of their text.
        line = np.asarray(lines.dictionary_encode().indices)[there].astype(np.int64)
        own = doc[there]
        o = np.lexsort((line, own))
        dup = np.zeros(len(there), bool)
        dup[o[1:]] = (line[o][1:] == line[o][:-1]) & (own[o][1:] == own[o][:-1])
        # Words in windows of three that occur again in the text.
        word_doc = doc[w.row]
        m = len(w.ids) - 2
        twice = np.zeros(len(w.ids), bool)
        if m > 0:
            i = w.ids.astype(np.uint64)
            at = np.flatnonzero(word_doc[:m] == word_doc[2:])
            h = common.mix(common.mix(i[:m] * common.MULT[0] + i[1 : m + 1] * common.MULT[1] + i[2:] * common.MULT[2])[at] + word_doc[at].astype(np.uint64) * common.MULT[3])
            s = np.sort(h)
            many = common.distinct(s[1:][s[1:] == s[:-1]])
            if len(many):
                k = np.minimum(np.searchsorted(many, h), len(many) - 1)
                hit = at[many[k] == h]
                for j in range(3):
                    twice[hit + j] = True
        by = lambda v, d: np.bincount(d, weights=v, minlength=n).astype(np.int64)
        self.n_words, self.word_chars, self.n_symbols = by(lw, doc), by(lc, doc), by(lm, doc)
        self.n_dup_lines, self.n_repeat_words = by(dup, own), by(twice, word_doc)
        self.base_failed = (self.n_words < 50) | (100 * self.n_repeat_words > 50 * self.n_words)
        self.doc, self.words, self.n = own, lw[there], n
        k = lw[there]
        symbols, unlike, mean = lm[there] / lc[there], distinct[there] / k, lc[there] / k
        first = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.empty(0, bool)
        final = np.concatenate([own[1:] != own[:-1], [True]]) if len(own) else first
        self.suspect = (symbols > 0.05) | (unlike < 0.5) | (again[there] > 0.3 * k) | (rights[there] > 0) & (k < 15)
        self.dup = dup
        self.x = np.column_stack(
            [
                np.ones(len(k)), k <= 2, (k > 2) & (k < 8), (k >= 8) & (k <= 25), k > 25,
                symbols == 0, (symbols > 0) & (symbols <= 0.05), (symbols > 0.05) & (symbols <= 0.15), symbols > 0.15,
                unlike >= 0.8, (unlike < 0.8) & (unlike >= 0.5), unlike < 0.5, again[there] > 0.3 * k,
                dup, ends[there] > 0, digits[there] > 0.2 * k, links[there] > 0, rights[there] > 0,
                capital[there] > 0.6 * k, mean < 3, mean > 9, first, final, (rights[there] > 0) & (k < 15),
            ]
        ).astype(np.float64)


def _steps(doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lines by their place in the document: (documents still going on, longest first; their lines)."""
    if not len(doc):
        return []
    start = np.flatnonzero(np.diff(doc, prepend=-1))
    count = np.diff(np.append(start, len(doc)))
    o = np.argsort(-count, kind="stable")
    start, count = start[o], count[o]
    out = []
    for t in range(int(count[0])):
        k = int(np.searchsorted(-count, -t, side="left"))
        out.append((np.arange(k), start[:k] + t))
    return out


@dataclass
class Crf:
    """Scores of label 1 (boilerplate) over label 0: w . features of a line, and 2 x 2 transitions."""

    w: np.ndarray
    t: np.ndarray
    least_content: float = 0.5

    def decode(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Viterbi labels of the lines."""
        e = x @ self.w
        labels, back, score = np.zeros(len(doc), np.int8), np.zeros((len(doc), 2), np.int8), None
        steps = _steps(doc)
        for k, (alive, at) in enumerate(steps):
            own = np.column_stack([np.zeros(len(at)), e[at]])
            if k:
                s = score[: len(alive), :, None] + self.t
                back[at] = s.argmax(axis=1)
                own += s.max(axis=1)
                rest = score[len(alive) :]
            else:
                rest = np.empty((0, 2))
            score = np.vstack([own, rest])
        if not steps:
            return labels
        now = score.argmax(axis=1).astype(np.int8)
        for k in range(len(steps) - 1, -1, -1):
            alive, at = steps[k]
            labels[at] = now[: len(alive)]
            now[: len(alive)] = back[at, now[: len(alive)]] if k else now[: len(alive)]
        return labels

    @staticmethod
    def start() -> "Crf":
        w = np.zeros(FEATURES)
        w[0], w[8], w[11], w[12], w[13], w[23] = -1, 3, 3, 3, 1, 2
        return Crf(w, np.array([[1.0, 0.0], [0.0, 1.0]]))

    @staticmethod
    def fit(x: np.ndarray, doc: np.ndarray, y: np.ndarray, rounds: int = 150, l2: float = 1e-4, rate: float = 0.2) -> "Crf":
        """Maximum likelihood by Adam; marginals by forward and backward sums over all documents at once."""
        w, t = np.zeros(FEATURES), np.zeros((2, 2))
        steps = _steps(doc)
        n = len(doc)
        gold_t = np.zeros((2, 2))
        same = doc[1:] == doc[:-1]
        np.add.at(gold_t, (y[:-1][same], y[1:][same]), 1)
        gold_w = x.T @ y
        m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
        for r in range(1, rounds + 1):
            e = np.column_stack([np.zeros(n), x @ w])
            a, b, alpha = np.zeros((n, 2)), np.zeros((n, 2)), None
            for k, (alive, at) in enumerate(steps):
                own = e[at] + (np.logaddexp(alpha[: len(alive), :1] + t[0], alpha[: len(alive), 1:] + t[1]) if k else 0)
                a[at] = own
                alpha = own
            for k in range(len(steps) - 2, -1, -1):
                at, nxt = steps[k][1], steps[k + 1][1]
                z = (b + e)[nxt]
                b[at[: len(nxt)]] = np.logaddexp(z[:, :1] + t[:, 0], z[:, 1:] + t[:, 1])
            lp = a + b
            z = np.logaddexp(lp[:, 0], lp[:, 1])
            p = np.exp(lp[:, 1] - z)
            exp_t = np.zeros((2, 2))
            i = np.flatnonzero(same)
            for c in range(2):
                for d in range(2):
                    exp_t[c, d] = np.exp(a[i, c] + t[c, d] + e[i + 1, d] + b[i + 1, d] - z[i]).sum()
            g = np.concatenate([(x.T @ p - gold_w) / n + l2 * w, ((exp_t - gold_t) / n + l2 * t).ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            d = rate * m / (1 - 0.9**r) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
            w, t = w - d[:FEATURES], t - d[FEATURES:].reshape(2, 2)
        return Crf(w, t)


def content_share(lines: Lines, labels: np.ndarray) -> np.ndarray:
    good = np.bincount(lines.doc, weights=lines.words * (labels == 0), minlength=lines.n)
    return good / np.maximum(1, lines.n_words)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Crf:
    """Learns from at most per_class documents of each quality. docs(doc_id, text), labels(doc_id, quality)."""
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample(labels, "quality", per_class)), "doc_id")
    fields = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.binary()), ("words", pa.binary())])

    def run(batches):
        for b in common.chunks(batches):
            s = Lines(b.column("text"))
            cut = np.searchsorted(s.doc, np.arange(b.num_rows + 1))
            flags = np.column_stack([s.x.astype(np.uint8), s.suspect, s.dup]).astype(np.uint8)
            yield common.batch(fields, b.column("doc_id"), b.column("y"), [flags[i:j].tobytes() for i, j in zip(cut, cut[1:])], [s.words[i:j].astype(np.int64).tobytes() for i, j in zip(cut, cut[1:])])

    got = rows.mapInArrow(run, "doc_id long, y int, x binary, words binary").toArrow().to_pylist()
    got = sorted((r for r in got if r["words"]), key=lambda r: (r["doc_id"], r["x"]))
    good = np.array([r["y"] for r in got], dtype=np.int64)
    if not len(good) or good.min() == good.max():
        return Crf.start()
    flags = np.concatenate([np.frombuffer(r["x"], np.uint8).reshape(-1, FEATURES + 2) for r in got])
    words = np.concatenate([np.frombuffer(r["words"], np.int64) for r in got])
    doc = np.repeat(np.arange(len(got)), [len(r["words"]) // 8 for r in got])
    x, suspect, dup = flags[:, :FEATURES].astype(np.float64), flags[:, FEATURES] > 0, flags[:, FEATURES + 1] > 0
    y = (((good[doc] == 0) & suspect) | dup).astype(np.int64)
    crf = Crf.fit(x, doc, y)
    bad = crf.decode(x, doc)
    share = np.bincount(doc, weights=words * (bad == 0)) / np.bincount(doc, weights=words)
    # The threshold with the best balanced fit; of equal ones the lowest, which keeps most.
    grid = np.arange(0.05, 1.0, 0.05)
    fit = [(share[good == 1] >= c).mean() * 2 + (share[good == 0] < c).mean() for c in grid]
    crf.least_content = float(grid[int(np.argmax(fit))])
    return crf


SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())])
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def assess(docs: DataFrame, crf: Crf) -> DataFrame:
    """Counts and verdict of every text of docs(doc_id, text)."""
    common.small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches):
        crf = shipped.value
        for b in common.chunks(batches):
            s = Lines(b.column("text"))
            share = content_share(s, crf.decode(s.x, s.doc))
            yield common.batch(SCHEMA, b.column("doc_id"), s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed, ~s.base_failed & (share >= crf.least_content), share)

    return docs.select("doc_id", "text").mapInArrow(run, DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    return assess(docs, train(docs, common.load(spark, sf_dir, "labels"))).drop("content_share")
