"""From raw documents to packed training sequences.

Each stage is ``function(spark, docs, sf_dir) -> DataFrame``; its result is
written as Parquet and reread as the next stage's docs. All but the last return
the columns of documents, and any others, as they came.

Defined results: null, empty and letterless texts go in the first stage; of rows
that repeat one stays; a null doc_id is carried along; empty tables give empty
results; no column's name means anything but doc_id, text and lang (to learn from).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlark.llm import common, decontam, langid, packing, secrets, simjoin


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language stays in doubt (best language under one half)."""
    lang, score = (common.free(docs.columns, c) for c in ("lang_pred", "score"))
    known = langid.predict(docs, langid.train(docs), lang, score)
    return known.where((F.col(lang) != "und") & (F.col(score) >= 0.5)).drop(lang, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-gram Jaccard similarity stays."""
    return simjoin.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontam.clean(docs, common.load(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become ``[kind]``; no document goes."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.stage(spark, docs, sf_dir)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, hash order and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; their tables are written under the shared checkpoint folder."""
    common.checkpoints(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = common.load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
