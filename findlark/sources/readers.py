"""Document sources: XML dumps, tab-separated ranking sets, and generated corpora."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def abstracts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, url, abstract of an abstract dump (<doc> elements, plain or gzip); the id is the MD5 of title|url|abstract."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "url", "abstract")])
    rows = spark.read.format("xml").option("rowTag", "doc").schema(schema).load(path)
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "url", "abstract")]
    return rows.select(F.md5(F.concat_ws("|", *text)).alias("doc_id"), *[t.alias(c) for t, c in zip(text, ("title", "url", "abstract"))])


def wiki_pages(spark: SparkSession, path: str, prefix_title: bool = False, limit: int | None = None) -> DataFrame:
    """doc_id, title, text of a page dump (<page> elements; .xml, .gz or .bz2) without redirects and empty texts."""
    schema = T.StructType(
        [
            T.StructField("title", T.StringType()),
            T.StructField("id", T.StringType()),
            T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
            T.StructField("revision", T.StructType([T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_bytes", T.StringType())]))])),
        ]
    )
    rows = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path).where("redirect is null")
    text, title = F.trim(F.coalesce(F.col("revision.text._VALUE"), F.lit(""))), F.trim(F.coalesce(F.col("title"), F.lit("")))
    out = rows.select(F.trim("id").alias("doc_id"), title.alias("title"), text.alias("text")).where("text <> '' and doc_id <> ''")
    if prefix_title:
        out = out.withColumn("text", F.concat_ws("\n", "title", "text"))
    return out if limit is None else out.limit(limit)


def ranking_collection(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of a collection file (id, tab, text; plain or gzip)."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.instr("value", "\t") > 0).select(F.get(parts, F.lit(0)).alias("doc_id"), F.get(parts, F.lit(1)).alias("text"))


def ranking_queries(spark: SparkSession, path: str) -> DataFrame:
    return ranking_collection(spark, path).withColumnRenamed("doc_id", "query_id")


def ranking_judgements(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, grade of a judgement file (query, iteration, document, grade); grades above 0 only."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("query_id"), F.get(parts, F.lit(2)).alias("doc_id"), F.get(parts, F.lit(3)).try_cast("int").alias("grade"))
    return rows.where("grade > 0 and doc_id is not null")


def sample_documents(docs: DataFrame, n: int, forced: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """n documents chosen by a hash of (doc_id, seed), with all forced ids (doc_id) among them, however many those are."""
    by = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    if forced is None:
        return docs.orderBy(by, "doc_id").limit(n)
    forced = forced.select("doc_id").distinct()
    kept = docs.join(forced, "doc_id", "left_semi")
    rest = docs.join(forced, "doc_id", "left_anti").orderBy(by, "doc_id").limit(max(0, n - kept.count()))
    return kept.unionByName(rest)


def synthetic(spark: SparkSession, docs: int = 5000, queries: int = 500, words: int = 60, query_words: int = 3, vocabulary: int = 20_000, exponent: float = 1.07, seed: int = 0xC0FFEE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, judgements): Zipf words; a query takes words of one document, which is its answer."""
    weights = np.arange(1, vocabulary + 1, dtype=np.float64) ** -exponent
    edges = np.cumsum(weights) / weights.sum()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = []
            for i in b.column("id").to_pylist():
                r = np.random.default_rng([seed, i])
                texts.append(" ".join(f"w{k}" for k in np.searchsorted(edges, r.random(words)).tolist()))
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), pa.array(texts)], names=["doc_id", "text"])

    corpus = spark.range(docs).mapInArrow(run, "doc_id string, text string")
    pick = F.xxhash64("doc_id", F.lit(seed))
    asked = corpus.orderBy(pick, "doc_id").limit(queries)
    take = F.array_join(F.slice(F.array_sort(F.transform(F.array_distinct(F.split("text", " ")), lambda w: F.struct(F.xxhash64(w, F.col("doc_id")).alias("h"), w.alias("w")))), 1, query_words)["w"], " ")
    qs = asked.select(F.concat(F.lit("q"), "doc_id").alias("query_id"), take.alias("text"))
    return corpus, qs, asked.select(F.concat(F.lit("q"), "doc_id").alias("query_id"), "doc_id", F.lit(1).alias("grade"))
