"""Structured Streaming ingest: micro-batches of documents become postings files.

Each batch writes its own folder, named by its id, so a batch that runs again
after a failure replaces itself; an index over the folders is an ordinary read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.analysis import Analyzer, analyzer
from ..operators import index as ix
from ..operators.index import Index


def ingest(docs: DataFrame, path: str, checkpoint: str, analyzer_: Analyzer | str | None = None, **trigger) -> StreamingQuery:
    """Indexes a stream of (doc_id, field, value); a later batch's version of a document replaces earlier ones."""
    a = analyzer(analyzer_)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col("doc_id").cast("string").alias("doc_id"), "field", "value").withColumn("ver", F.lit(number).cast("long"))
        postings, stats = ix.build(ix.analyzed(rows, a))
        postings.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        stats.write.mode("overwrite").parquet(f"{path}/doc_stats/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def open_index(spark: SparkSession, path: str) -> Index:
    """The newest version of every document that was ingested."""
    postings = spark.read.schema(ix.POSTINGS).parquet(f"{path}/postings/*")
    stats = spark.read.schema(ix.DOC_STATS).parquet(f"{path}/doc_stats/*")
    each = stats.select("doc_id", "ver").distinct()
    newest = each.groupBy("doc_id").agg(F.max("ver").alias("last"))
    old = each.join(newest, "doc_id").where("ver < last").select("doc_id", "ver")
    return Index(postings, stats, old)
