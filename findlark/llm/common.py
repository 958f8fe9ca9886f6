"""Arrow and numpy helpers shared by the operators of this subpackage.

Texts cross into Python as Arrow batches (``mapInArrow``); words are split and
dictionary-encoded by Arrow's C++ kernels, so Python sees each distinct word of
a chunk once, and per-word results are spread over the occurrences by numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Odd multipliers, one per place in a window.
MULT = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ (0xD6E8FEB86659FD93 * (i + 1))) % (1 << 64) | 1 for i in range(64)], dtype=np.uint64)
CHUNK_BYTES = 4 << 20


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB between JVM and Python, unless the session asks for smaller ones: rows of text come in thousands at a time otherwise."""
    if int(spark._jsparkSession.sessionState().conf().getConfString(BATCH_BYTES, str(1 << 30)).rstrip("bB")) > 8 << 20:
        spark.conf.set(BATCH_BYTES, str(8 << 20))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0), dtype=np.int64) + 64)
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
            yield b.slice(at, to - at)
            at = to
        del b, size
        pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values; sorting beats numpy's hash-based ``unique`` many times over."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


#: A random number for each value of a byte.
BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)


def word_hashes(vocab: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words: byte numbers times the multipliers of their places, added up for all words at once; words of over 64 bytes by xxhash."""
    out = np.empty(len(vocab), np.uint64)
    vocab = vocab.cast(pa.large_string())
    for at in range(0, len(vocab), 1 << 18):
        part = vocab.slice(at, 1 << 18)
        ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        size = np.diff(ends)
        raw = part.buffers()[2]
        x = BYTES[np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]]] if raw is not None else np.empty(0, np.uint64)
        x *= MULT[np.minimum(np.arange(len(x)) - np.repeat(ends[:-1] - ends[0], size), 63)]
        total = np.concatenate([[U64(0)], np.cumsum(x)])[ends - ends[0]]
        own = mix(total[1:] - total[:-1] + size.astype(np.uint64) * BYTES[0] + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        for i in np.flatnonzero(size > 64).tolist():
            own[i] = xxhash.xxh64_intdigest(part[i].as_py(), seed)
        out[at : at + len(part)] = own
    return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk of texts (null: none).

    ids: index into vocab of each word, texts one after the other; count and
    start: words of each text and the place of its first; row: text of each word.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        enc = lists.flatten().dictionary_encode()
        ids, lens = np.asarray(enc.indices), np.diff(np.asarray(lists.offsets))
        self.vocab: pa.Array = enc.dictionary
        row = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
        empty = pc.index(self.vocab, pa.scalar("", self.vocab.type)).as_py()
        if empty >= 0:
            keep = ids != empty
            ids, row = ids[keep], row[keep]
        self.ids, self.row, self.n = ids, row, len(texts)
        self.count = np.bincount(row, minlength=len(texts)).astype(np.int64)
        self.start = np.cumsum(self.count) - self.count

    def windows(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first place of every window of k words that lies in one text. h: hash of each vocab entry."""
        m = len(self.ids) - k + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.row[:m] == self.row[k - 1 :])
        w = h[self.ids]
        acc = np.zeros(m, np.uint64)
        for j in range(k):
            acc += w[j : j + m] * MULT[j]
        return mix(acc[at]), at


def sums(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of values[start:start+count] for each text."""
    c = np.concatenate([[0], np.cumsum(values)])
    return c[start + count] - c[start]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def free(columns: list[str], name: str) -> str:
    """A name that none of the columns has, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Writes inside remove their shuffle files when they end: what they wrote is all that is read later."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def checkpoints(spark: SparkSession) -> None:
    """Sets a checkpoint folder only where the session has none: on one machine, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="findlark-checkpoint-")
    sc.setCheckpointDir(path)
