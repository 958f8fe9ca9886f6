"""Index persistence: mutable snapshots and sealed segments as Parquet folders.

A folder holds ``postings`` (range-partitioned and sorted by field and term, so
row-group statistics prune exact and prefix lookups), ``doc_stats`` and, in
snapshots, ``tombstones``; membership filters are one binary file. The manifest
is written last and is the commit mark: a folder without it is no index. Files
go through Spark's own file system layer, so any shared store will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import filters
from ..operators.index import Index

FORMAT = 1


class StoreError(RuntimeError):
    """A folder that is no index, or not the one that was expected."""


CODECS: dict[str, tuple] = {}


def register_codec(name: str, save, load) -> None:
    """Adds a filter codec: save(filter) -> bytes, load(bytes) -> filter."""
    if not name or save is None or load is None:
        raise ValueError("a codec needs a name and both functions")
    if name in CODECS:
        raise ValueError(f"codec {name!r} is registered already")
    CODECS[name] = save, load


for _name, _cls in filters.FILTERS.items():
    register_codec(_name, lambda f: f.serialize(), _cls.load)


def _codec_of(f) -> str:
    kind = getattr(f, "built", f) or f
    return next((n for n, c in filters.FILTERS.items() if isinstance(kind, c)), "")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    """Whole files only: to a name of its own first, then renamed."""
    fs, p, jvm = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise StoreError(f"cannot write {path}")


def _read(spark: SparkSession, path: str) -> bytes | None:
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    except Py4JJavaError as e:
        raise StoreError(f"{path} cannot be read") from e
    finally:
        stream.close()


def _delete(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


#: Bytes of unsorted files that become one sorted file: checksums read a file at once.
PART = 16 << 20


def _sorted(spark: SparkSession, path: str, one: bool, *by: str) -> DataFrame:
    """The rows of a written folder, range-partitioned by size, sorted. one: they have one value of the first key, which would only slow the comparisons."""
    fs, p, _ = _fs(spark, path)
    by = by[one:]
    return spark.read.parquet(path).repartitionByRange(max(1, -(-fs.getContentSummary(p).getLength() // PART)), *by).sortWithinPartitions(*by)


def faults(postings: DataFrame, file=None) -> dict[str, int]:
    """What is wrong with sorted postings, by kind: rows without a term or document, out of order, or there twice.

    One narrow pass. A task may read pieces of several files in any sequence, so order holds within each piece
    (file: the column that tells them apart) and, by the first and last key of each, between them.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        own, last, first, now = [0, 0, 0], None, None, None
        count = lambda mask: pc.sum(mask).as_py() or 0

        def piece():
            row = [*own, *(first[c][0].as_py() if first else None for c in range(4)), *(last[c][0].as_py() if last else None for c in range(4))]
            own[:] = 0, 0, 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 3 + KEY * 2)], names=PIECE)

        KEY = [pa.string(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            coded = b.column(4).dictionary_encode()
            files, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            cuts = [0, *((code[1:] != code[:-1]).nonzero()[0] + 1).tolist(), len(code)] if len(code) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                name = files[code[lo]]
                if now is not None and name != now:
                    yield piece()
                    last = first = None
                now = name
                cols = [b.column(i).slice(lo, hi - lo).cast(t) for i, t in enumerate(KEY)]
                none = [pc.equal(pc.fill_null(c, ""), "") for c in cols[1:3]]
                own[0] += count(pc.or_(*none))
                whole = pc.and_(pc.and_(cols[0].is_valid(), cols[1].is_valid()), pc.and_(cols[2].is_valid(), cols[3].is_valid()))
                cols = [c.filter(whole) for c in cols]
                if not len(cols[0]):
                    continue
                first = first or [c.slice(0, 1) for c in cols]
                if last:
                    cols = [pa.concat_arrays([x, c]) for x, c in zip(last, cols)]
                n = len(cols[0])
                last = [c.slice(n - 1) for c in cols]
                was, is_ = [c.slice(0, n - 1) for c in cols], [c.slice(1) for c in cols]
                same = [pc.equal(x, y) for x, y in zip(was, is_)]
                less = [pc.less(y, x) for x, y in zip(was[:3], is_)]  # strings by their bytes
                own[1] += count(pc.or_(less[0], pc.and_(same[0], pc.or_(less[1], pc.and_(same[1], less[2])))))
                own[2] += count(pc.and_(pc.and_(same[0], same[1]), pc.and_(same[2], same[3])))
        yield piece()

    PIECE = ["empty", "disorder", "twice", *(f"{at}_{c}" for at in ("first", "last") for c in ("field", "term", "doc_id", "ver"))]
    kinds = ", ".join(f"{c} {'long' if c in PIECE[:3] or c.endswith('ver') else 'string'}" for c in PIECE)
    found = [tuple(r) for r in postings.select("field", "term", "doc_id", "ver", (F.lit("") if file is None else file).alias("file")).mapInArrow(run, kinds).collect()]  # a row a piece
    out = dict(zip(PIECE, map(sum, zip(*(r[:3] for r in found))))) if found else {}
    key = lambda k: tuple(x.encode() for x in k[:3])
    pieces = sorted((key(r[3:7]), key(r[7:11]), r[3:7], r[7:11]) for r in found if r[3] is not None)
    for (_, end, _, z), (begin, _, a, _) in zip(pieces, pieces[1:]):
        out["disorder"] += begin < end
        out["twice"] += a == z
    return {k: n for k, n in out.items() if n}


def _files(spark: SparkSession, data: str) -> DataFrame:
    """(part, bytes, sha256) of the files of a segment."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([f"{data}/{x}" for x in ("postings", "doc_stats", "term_stats")])
    return files.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str) -> list[str]:
    """The files of a stored segment that are missing, new or not as they were written."""
    raw = _read(spark, f"{path}/manifest.json")
    if raw is None:
        raise StoreError(f"no manifest in {path}")
    data = f"{path}/{json.loads(raw)['data']}"
    kept, now = spark.read.parquet(f"{data}/checksums"), _files(spark, data)
    wrong = kept.exceptAll(now).select("part").union(now.exceptAll(kept).select("part")).distinct()
    return sorted(r["part"] for r in wrong.collect())


def _save(engine: Engine, path: str, mode: str, postings: DataFrame, stats: DataFrame, dead: DataFrame | None) -> None:
    spark = engine.spark
    data = f"{path}/{uuid.uuid4().hex}"  # a new folder each time; the manifest says which one counts
    old = _read(spark, f"{path}/manifest.json")
    # What is indexed is worked out once, as it comes; order is made of what was written.
    one = False
    for name, df, by in (("doc_stats", stats, ("field", "doc_id")), ("postings", postings, ("field", "term", "doc_id"))):
        df.write.parquet(f"{data}/raw-{name}")
        if name == "doc_stats":  # it has every field of every posting
            ends = spark.read.parquet(f"{data}/raw-{name}").agg(F.min("field").alias("a"), F.max("field").alias("z"), F.count_if(F.col("field").isNull()).alias("none")).first()
            one = ends["a"] == ends["z"] and not ends["none"]
        _sorted(spark, f"{data}/raw-{name}", one, *by).write.parquet(f"{data}/{name}")
        _delete(spark, f"{data}/raw-{name}")
    if mode == "segment":
        wrong = faults(spark.read.parquet(f"{data}/postings"), F.col("_metadata.file_name"))
        if wrong:
            _delete(spark, data)
            raise StoreError(f"the postings are no segment: {wrong}")
        spark.read.parquet(f"{data}/postings").groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.parquet(f"{data}/raw-term_stats")
        _sorted(spark, f"{data}/raw-term_stats", one, "field", "term").write.parquet(f"{data}/term_stats")
        _delete(spark, f"{data}/raw-term_stats")
        _files(spark, data).write.parquet(f"{data}/checksums")
    if dead is not None:
        dead.distinct().write.parquet(f"{data}/tombstones")
    codec, sum_ = "", ""
    if engine.filter is not None:
        codec = _codec_of(engine.filter)
        if not codec:
            raise StoreError("the filter has no codec")
        raw = CODECS[codec][0](engine.filter)
        sum_ = hashlib.sha256(raw).hexdigest()
        _write(spark, f"{data}/filter.bin", raw)
    manifest = {"format": FORMAT, "mode": mode, "data": data.rsplit("/", 1)[1], "analyzer": {"name": engine.analyzer.name, "version": engine.analyzer.version, "fingerprint": engine.analyzer.fingerprint}, "multi_field": engine.multi_field, "version": engine.version, "tombstones": dead is not None, "filter": codec, "filter_sha256": sum_}
    _write(spark, f"{path}/manifest.json", json.dumps(manifest, indent=1).encode())
    if old is not None:
        _delete(spark, f"{path}/{json.loads(old)['data']}")


def save_snapshot(engine: Engine, path: str) -> None:
    """The whole mutable state."""
    i = engine.index
    _save(engine, path, "snapshot", i.postings, i.doc_stats, i.tombstones)


def save_segment(engine: Engine, path: str) -> None:
    """A sealed index of the living documents."""
    _save(engine, path, "segment", engine.index.live_postings(), engine.index.live_stats(), None)


def load(spark: SparkSession, path: str, analyzer=None, expect_fingerprint: str | None = None, mmap: bool = False, check: bool = False, **options) -> Engine:
    """An engine over a saved index. The analyzer's fingerprint must be the stored one; check compares a segment's files with their checksums; mmap is accepted and means nothing here."""
    raw = _read(spark, f"{path}/manifest.json")
    if raw is None:
        raise StoreError(f"no manifest in {path}")
    try:
        m = json.loads(raw)
        data = f"{path}/{m['data']}"
        mode, stored = m["mode"], m["analyzer"]["fingerprint"]
    except (ValueError, KeyError, TypeError) as e:
        raise StoreError(f"the manifest of {path} cannot be read") from e
    if m.get("format") != FORMAT or mode not in ("snapshot", "segment"):
        raise StoreError(f"format {m.get('format')} / {mode} is not known")
    if "/" in m["data"] or m["data"] in ("", ".", ".."):
        raise StoreError("the manifest names a folder elsewhere")
    if check and mode == "segment" and (wrong := verify(spark, path)):
        raise StoreError(f"damaged files: {', '.join(wrong)}")
    if expect_fingerprint and expect_fingerprint != stored:
        raise StoreError("the index was made with another analyzer than expected")
    out = Engine(spark, analyzer if analyzer is not None else m["analyzer"]["name"], multi_field=m["multi_field"], **options)
    if out.analyzer.fingerprint != stored:
        raise StoreError("the index was made with another analyzer")
    read = spark.read.parquet
    out.index = Index(read(f"{data}/postings"), read(f"{data}/doc_stats"), read(f"{data}/tombstones") if m["tombstones"] else None)
    if mode == "segment":
        out.index.terms = read(f"{data}/term_stats")
        out.index.keep_stats()
    out.version = out.indexed = m["version"]
    out.sealed = mode == "segment"
    if m["filter"]:
        raw = _read(spark, f"{data}/filter.bin")
        if raw is None or hashlib.sha256(raw).hexdigest() != m["filter_sha256"]:
            raise StoreError("the membership filter is damaged")
        if m["filter"] not in CODECS:
            raise StoreError(f"no codec {m['filter']!r}")
        out.filter = CODECS[m["filter"]][1](raw)
    return out
