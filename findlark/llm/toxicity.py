"""Operator 7: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are the distinct hashes of its words (lower-cased letters),
of their first four and five letters, of neighbouring words and of words with
one between. Training sees a bounded sample of labelled rows (``per_class`` of
each class, by a hash of doc_id), one document at a time, with per-coordinate
rates and L1 sparsity, so the weights that are broadcast are the few hundred or
thousand that are not zero (2^20 at most). The bias is corrected by the shares of the
classes that the sample has, so that scores keep to the odds of all labelled rows. Scoring is one narrow pass.

Defined results: null and empty texts score as the bias alone; rows of labels
that disagree on a document count by their majority (a tie is toxic); without
labels every score is 0.5; a null doc_id is held out; input columns besides
doc_id and text are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 20
BIAS = 1 << BITS


def _slots(h: np.ndarray, salt: int) -> np.ndarray:
    return (common.mix(h + np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int64)


class Features:
    """(row, slot) of every feature occurrence of a chunk, in parts."""

    def __init__(self, texts: pa.Array):
        w = common.Words(texts)
        low = pc.utf8_lower(w.vocab)
        bare = pc.if_else(pc.match_substring_regex(low, "^[a-z]+$"), low, pc.replace_substring_regex(low, r"[^\p{L}]+", "")).dictionary_encode()
        to, words = np.asarray(bare.indices), bare.dictionary
        there = np.asarray(pc.greater(pc.binary_length(words), 0), dtype=bool)
        keep = there[to][w.ids] if len(words) else np.empty(0, bool)
        self.ids, self.row, self.n = to[w.ids[keep]], w.row[keep], w.n
        h = common.word_hashes(words)
        self.unary = np.stack([_slots(h, 1), _slots(common.word_hashes(pc.utf8_slice_codeunits(words, 0, 4)), 2), _slots(common.word_hashes(pc.utf8_slice_codeunits(words, 0, 5)), 3)]) if len(words) else np.empty((3, 0), np.int64)
        self.h = h

    def parts(self):
        for u in self.unary:
            yield self.row, u[self.ids]
        w = self.h[self.ids]
        for gap in (1, 2):
            if len(w) > gap:
                ok = self.row[:-gap] == self.row[gap:]
                pair = w[:-gap] * common.MULT[0] + w[gap:] * common.MULT[1]
                yield self.row[:-gap][ok], _slots(pair, 10 + gap)[ok]


def ftrl(examples: list[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, epochs: int = 10) -> np.ndarray:
    """Weights (the last is the bias, free of L1) after ``epochs`` passes over (distinct slots, label)."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(i):
        zi = z[i]
        # A document's weights are summed, so L1 keeps coordinates out until their evidence adds up.
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for slots, y in examples:
            w = weights(slots)
            b = -z[BIAS] / ((beta + np.sqrt(n[BIAS])) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            s = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / alpha
            z[slots] += g - s * w
            n[slots] += g * g
            s = (np.sqrt(n[BIAS] + g * g) - np.sqrt(n[BIAS])) / alpha
            z[BIAS] += g - s * b
            n[BIAS] += g * g
    out = weights(np.arange(BIAS + 1))
    out[BIAS] = -z[BIAS] / ((beta + np.sqrt(n[BIAS])) / alpha)
    return out


def held_out(doc_id, mod: int = 5, rest: int = 0):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(True))


def learnable(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) of all labelled documents that may be learned from."""
    return labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("y"))


def sample(labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """(doc_id, y): at most per_class documents of each class that may be learned from, chosen by a hash of doc_id."""
    y = learnable(labels, column)
    by = F.xxhash64("doc_id", F.lit(7))
    return y.where("y = 1").orderBy(by, "doc_id").limit(per_class).unionByName(y.where("y = 0").orderBy(by, "doc_id").limit(per_class))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights that are not zero. docs(doc_id, text), labels(doc_id, toxic)."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample(labels, "toxic", per_class)), "doc_id")  # at most 2 x per_class ids

    def run(batches):
        for b in common.chunks(batches):
            rs, ss = zip(*Features(b.column("text")).parts())
            key = common.distinct(np.concatenate(rs).astype(np.int64) << 32 | np.concatenate(ss))
            cut = np.searchsorted(key >> 32, np.arange(b.num_rows + 1))
            slots = (key & 0xFFFFFFFF).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([slots[a:e].tobytes() for a, e in zip(cut, cut[1:])], pa.binary())], names=["doc_id", "y", "slots"])

    got = rows.mapInArrow(run, "doc_id long, y int, slots binary").toArrow().to_pylist()
    got.sort(key=lambda r: ((r["doc_id"] * 0x9E3779B97F4A7C15) % (1 << 64), r["slots"]))
    if not got:
        return np.empty(0, np.int64), np.empty(0)
    w = ftrl([(np.frombuffer(r["slots"], dtype=np.int32), r["y"]) for r in got])
    n = {r["y"]: r["n"] for r in learnable(labels, "toxic").groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) == 2:  # the odds of all labelled rows in place of those of the sample
        w[BIAS] += np.log(min(per_class, n[0]) / n[0]) - np.log(min(per_class, n[1]) / n[1])
    on = np.flatnonzero(w)
    return on, w[on]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scores(slots: np.ndarray, weights: np.ndarray, texts: pa.Array) -> np.ndarray:
    table = np.zeros(BIAS + 1, np.float64)
    table[slots] = weights
    rs, ss = [], []
    for row, slot in Features(texts).parts():
        on = np.flatnonzero(table[slot])
        rs.append(row[on].astype(np.int64))
        ss.append(slot[on])
    key = common.distinct(np.concatenate(rs) << 32 | np.concatenate(ss))
    total = np.bincount(key >> 32, weights=table[key & 0xFFFFFFFF], minlength=len(texts)) + table[BIAS]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def predict(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score) of docs(doc_id, text)."""
    common.small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in common.chunks(batches):
            yield common.batch(SCHEMA, b.column("doc_id"), scores(*shipped.value, b.column("text")))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    out = predict(docs, train(docs, common.load(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
