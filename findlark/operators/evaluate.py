"""Retrieval quality, latency figures, and typed query workloads."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_at(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): of hits(query_id, doc_id, rank from 1) and qrels(query_id, doc_id, grade); all relevant documents are the denominator."""
    rel = qrels.where("grade > 0")
    found = hits.where(F.col("rank") <= k).join(rel, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("found"))
    return rel.groupBy("query_id").agg(F.count("*").alias("n")).join(found, "query_id", "left").select("query_id", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"))


def reciprocal_rank(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, rr): over the whole list of hits; 0 without a relevant one."""
    rel = qrels.where("grade > 0")
    first = hits.join(rel, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("r"))
    return rel.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("rr"))


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def ndcg_at(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg): gain 2^grade - 1; the ideal list takes all grades."""
    rel = qrels.where("grade > 0")
    dcg = hits.where(F.col("rank") <= k).join(rel, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(_gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    best = rel.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))).where(F.col("r") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(_gain(F.col("grade"), F.col("r"))).alias("ideal"))
    return ideal.join(dcg, "query_id", "left").select("query_id", (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def percentile(latencies: list[float], p: float) -> float:
    """The value at place int((n - 1) p) of the sorted list."""
    return sorted(latencies)[int((len(latencies) - 1) * p)] if latencies else 0.0


def measure(run: Callable[[object], object], queries: Iterable[object], warm_up: float = 0.1) -> dict:
    """Latency and throughput of run over queries, of which the first share only warms up."""
    queries = list(queries)
    for q in queries[: int(len(queries) * warm_up)]:
        run(q)
    times = []
    for q in queries:
        began = time.perf_counter()
        run(q)
        times.append(time.perf_counter() - began)
    total = sum(times)
    return {"p50": percentile(times, 0.5), "p95": percentile(times, 0.95), "p99": percentile(times, 0.99), "max": max(times, default=0.0), "mean": total / len(times) if times else 0.0, "qps": len(times) / total if total else 0.0}


def summary(runs: DataFrame) -> DataFrame:
    """Median, least and most of every metric over repeated runs(engine, metric, value)."""
    return runs.groupBy("engine", "metric").agg(F.percentile("value", 0.5).alias("median"), F.min("value").alias("least"), F.max("value").alias("most"))


# -- typed workloads: queries drawn from the index by document frequency ------------------------------------


def workload_terms(term_stats: DataFrame, n_docs: int, n: int, low: float = 0.001, high: float = 0.1) -> DataFrame:
    """(term, df): n terms on between low and high of the documents, by a hash of the term. The lower bound is rounded, half up, the upper one cut."""
    share = lambda x: Decimal(str(x)) * n_docs
    least, most = int(share(low).quantize(Decimal(1), ROUND_HALF_UP)), int(share(high))
    rows = term_stats.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df").between(max(2, least), max(2, most)))
    return rows.orderBy(F.md5("term"), "term").limit(n)


def _pairs(batches):
    """(phrase, df): neighbouring tokens of rows of tokens, once a row, summed up over rows that are read together."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        lists = b.column(0)
        lists = lists.filter(lists.is_valid())
        at, words = np.asarray(lists.offsets).astype(np.int64), lists.values
        lo = 0
        while lo < len(at) - 1:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PAIRS, "right")) - 1)
            n = int(at[hi] - at[lo])
            if n > 1:
                coded = words.slice(at[lo], n).dictionary_encode()
                code, size = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
                row = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                both = row[1:] == row[:-1]
                pair, row = (code[:-1] * size + code[1:])[both], row[1:][both]
                kept, place = np.unique(pair, return_inverse=True)
                rows = np.unique(place.astype(np.int64) * (hi - lo) + row) // (hi - lo)
                first, second = (coded.dictionary.take(pa.array(x)) for x in (kept // size, kept % size))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(first, second, " "), pa.array(np.bincount(rows, minlength=len(kept)).astype(np.int64))], names=["phrase", "df"])
            lo = hi


#: Tokens of neighbouring rows whose pairs are summed up together.
PAIRS = 1 << 20


def workload_bigrams(tokens: DataFrame, n: int, least: int = 2) -> DataFrame:
    """(phrase, df): n neighbouring token pairs of tokens(doc_id, tokens) that at least ``least`` documents have."""
    rows = tokens.select("tokens").mapInArrow(_pairs, "phrase string, df long").groupBy("phrase").agg(F.sum("df").alias("df")).where(F.col("df") >= least)
    return rows.orderBy(F.md5("phrase"), "phrase").limit(n)


def workload_prefixes(term_stats: DataFrame, n: int, length: int = 3) -> DataFrame:
    """(prefix, terms): n prefixes of terms that are longer."""
    rows = term_stats.where(F.char_length("term") > length).select("term").distinct().groupBy(F.substring("term", 1, length).alias("prefix")).agg(F.count("*").alias("terms"))
    return rows.orderBy(F.md5("prefix"), "prefix").limit(n)


def exact_answers(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade 1): documents of queries(query_id, kind and/or, terms array) by set algebra over the postings."""
    q = queries.select("query_id", "kind", F.size(F.array_distinct("terms")).alias("n"), F.explode(F.array_distinct("terms")).alias("term"))
    # A row for each term of the queries is broadcast; only postings that are asked for travel.
    got = postings.select("term", "doc_id").join(F.broadcast(q), "term").groupBy("query_id", "doc_id", "kind", "n").agg(F.count_distinct("term").alias("c"))
    return got.where("kind = 'or' or c = n").select("query_id", "doc_id", F.lit(1).alias("grade"))


def run_kind(engine, kind: str, text: str, k: int = 10):
    """One benchmark query by kind: text (plain), term, phrase, prefix or boolean (query string)."""
    from ..plans.ast import Phrase, Prefix, Term

    if kind == "text":
        return engine.search_plain_text(text, k)
    if kind == "boolean":
        return engine.search_documents(text, k)
    kinds = {"term": Term, "phrase": Phrase, "prefix": Prefix}
    if kind not in kinds:
        raise ValueError(f"unknown query kind {kind!r}")
    return engine.search(kinds[kind](text), k)


def cached(spark, path: str, version: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows from path/version, written there the first time: a workload is generated once."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/{version}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(f"{path}/{version}")
    return spark.read.parquet(f"{path}/{version}")
