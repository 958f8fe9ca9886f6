"""Inverted index as DataFrames.

* ``postings(field, term, doc_id, ver, tf, positions, dl)`` - one row for a term
  of a document's field; dl is the field's length, kept here so that scoring
  needs no join with the documents.
* ``doc_stats(field, doc_id, ver, dl)`` - every field of every document, also
  those without a token: N and the average length come from here.
* ``tombstones(doc_id, ver)`` - deleted versions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer
from ..plans.ast import DEFAULT_FIELD

POSTINGS = "field string, term string, doc_id string, ver long, tf long, positions array<int>, dl long"
DOC_STATS = "field string, doc_id string, ver long, dl long"
TOMBSTONES = "doc_id string, ver long"


def long_form(docs: DataFrame, id_column: str = "doc_id", fields: list[str] | None = None, default: str | None = None) -> DataFrame:
    """(doc_id, field, value) of a table with one column a field; null and empty values are no fields. default: the one column that is the unnamed field."""
    if default is not None:
        return docs.select(F.col(id_column).cast("string").alias("doc_id"), F.lit(DEFAULT_FIELD).alias("field"), F.col(default).cast("string").alias("value"))
    fields = fields or [c for c in docs.columns if c != id_column]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields]))
    return docs.select(F.col(id_column).cast("string").alias("doc_id"), pairs.alias("f")).select("doc_id", "f.field", "f.value").where("value <> ''")


def analyzed(rows: DataFrame, analyzers: Callable[[str], Analyzer] | Analyzer, fields: list[str] | None = None) -> DataFrame:
    """rows(doc_id, field, value, ...) with tokens; a field may have an analyzer of its own."""
    value = F.coalesce(F.col("value"), F.lit(""))
    if isinstance(analyzers, Analyzer):
        return rows.withColumn("tokens", analyzers.column(value))
    default, own = analyzers
    tokens = default.column(value)
    for name, a in own.items():
        tokens = F.when(F.col("field") == name, a.column(value)).otherwise(tokens)
    return rows.withColumn("tokens", tokens)


#: Tokens of neighbouring rows that are folded together.
CHUNK = 1 << 18


def _fold(batches):
    """Postings of rows (doc_id, field, ver, dl, terms): terms has the index keys of each token. Each row on its own, its terms in order of appearance in the chunk."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    bits = lambda n: max(1, int(n).bit_length())
    offsets = lambda a: np.asarray(a.offsets).astype(np.int64)

    for b in batches:
        lists = b.column(4)
        if lists.null_count:
            lists = pc.fill_null(lists, pa.scalar([], lists.type))
        at = offsets(lists)
        place = None
        inner = lists.values
        if pa.types.is_list(inner.type):  # several keys a token, each at the token's place
            if inner.null_count:
                inner = pc.fill_null(inner, pa.scalar([], inner.type))
            deep = offsets(inner)
            token = np.repeat(np.arange(len(inner)), np.diff(deep))
            place, at, inner = token - np.repeat(at[:-1], np.diff(deep[at])), deep[at] - deep[0], inner.values.slice(deep[0], deep[-1] - deep[0])
        lo = 0
        while lo < len(at) - 1:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
            n = int(at[hi] - at[lo])
            if n:
                coded = inner.slice(at[lo], n).dictionary_encode()
                codes, sizes = np.asarray(coded.indices.fill_null(len(coded.dictionary))).astype(np.int64), np.diff(at[lo : hi + 1])
                row = np.repeat(np.arange(hi - lo), sizes)
                pos = np.arange(n) - np.repeat(at[lo:hi] - at[lo], sizes) if place is None else place[at[lo] : at[hi]]
                pb, cb = bits(pos.max()), bits(len(coded.dictionary))
                order = np.sort((row << cb | codes) << pb | pos)  # at most 18 bits each, or one long row
                key = order >> pb
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                where, tf = key[first] >> cb, np.diff(np.concatenate((first, [n])))
                take = pa.array(where + lo)
                term = coded.dictionary.take(pa.array(np.where((c := key[first] & ((1 << cb) - 1)) < len(coded.dictionary), c, 0), mask=c == len(coded.dictionary)))
                positions = pa.ListArray.from_arrays(pa.array(np.concatenate((first, [n])).astype(np.int32)), pa.array((order & ((1 << pb) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(1).take(take), term, b.column(0).take(take), b.column(2).take(take), pa.array(tf), positions, b.column(3).take(take)], names=["field", "term", "doc_id", "ver", "tf", "positions", "dl"])
            lo = hi


def asked(tokens: DataFrame, keys: Callable | None = None) -> DataFrame:
    """Postings as well, for queries that select a few terms: conditions on field and term reach the tokens, and only what they leave is grouped."""
    # Outer, as a filter on the number of tokens is inferred otherwise, and texts are analyzed twice.
    each = tokens.select("field", "doc_id", "ver", F.size("tokens").cast("long").alias("dl"), F.posexplode_outer("tokens").alias("pos", "token")).where("pos is not null")
    each = each.withColumnRenamed("token", "term") if keys is None else each.select("field", "doc_id", "ver", "dl", "pos", F.explode(keys(F.col("token"))).alias("term"))
    return each.groupBy("field", "term", "doc_id", "ver").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"), F.max("dl").alias("dl")).select("field", "term", "doc_id", "ver", "tf", "positions", "dl")


def build(tokens: DataFrame, keys: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, doc_stats) of rows (doc_id, field, ver, tokens).

    No shuffle where no document's field is there twice, which is looked up in
    the ids alone: a row's tokens are folded where they are read. Rows that
    repeat a document's field add up, as indexing twice does; the largest length
    counts. keys: a function from a token column to its array of index keys.
    """
    size = F.size(F.coalesce("tokens", F.expr("cast(array() as array<string>)"))).cast("long")
    terms = F.col("tokens") if keys is None else F.transform("tokens", keys)
    postings = tokens.select("doc_id", "field", "ver", size.alias("dl"), terms.alias("terms")).mapInArrow(_fold, POSTINGS)
    stats = tokens.select("field", "doc_id", "ver", size.alias("dl"))
    own = ("field", "doc_id", "ver")
    if not tokens.groupBy(*own).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        postings = postings.groupBy("field", "term", "doc_id", "ver").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.max("dl").alias("dl"))
        stats = stats.groupBy(*own).agg(F.max("dl").alias("dl"))
    return postings, stats


@dataclass
class Index:
    postings: DataFrame
    doc_stats: DataFrame
    tombstones: DataFrame | None = None
    positional: frozenset[str] | None = None  # fields with positions; None: all
    terms: DataFrame | None = None  # stored term_stats of an index that does not change
    kept_stats: DataFrame | None = None
    one_field: bool = False  # known to have no more than one
    asked: DataFrame | None = None  # the same postings, for conditions that leave a few of them

    def _live(self, df: DataFrame) -> DataFrame:
        return df if self.tombstones is None else df.join(self.tombstones, ["doc_id", "ver"], "left_anti")

    def live_postings(self, where=None) -> DataFrame:
        """The postings a query asks for (None: all); the condition reaches the scan, deleted versions go after it."""
        if where is None:
            return self._live(self.postings)
        return self._live((self.postings if self.asked is None else self.asked).where(where))

    def live_stats(self) -> DataFrame:
        return self._live(self.doc_stats)

    def field_stats(self) -> DataFrame:
        """(field, n_docs, avg_len): one row a field."""
        return self.kept_stats if self.kept_stats is not None else self.live_stats().groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len"))

    def keep_stats(self, most: int = 10_000) -> "Index":
        """Reads field_stats once, if there are not too many fields, for an index that does not change."""
        stats = self.field_stats()
        rows = stats.limit(most + 1).collect()
        if len(rows) <= most:
            self.kept_stats = stats.sparkSession.createDataFrame(rows, stats.schema)
        self.one_field = len(rows) <= 1
        return self

    def term_stats(self) -> DataFrame:
        """(field, term, df, cf)."""
        if self.terms is not None:
            return self.terms
        return self._live(self.postings).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
