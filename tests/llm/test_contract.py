"""The registered queries over whole small tables: columns, rows and invariants of their results."""

import duckdb
import pytest

import __spark_entry__
from findlark.llm import simjoin

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op2_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op5_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6_ngram_jaccard": ["doc_id", "n_shingles", "n_similar", "component_id"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op9_decontamination": ["doc_id", "item_id", "coverage", "word_start", "word_end", "changed_slots"],
    "op10_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "pipeline": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}
ROWS = {"op1_html_extraction": 50, "op9_decontamination": None, "op2_best_fit_packing": None, "pipeline": None, "op8_chat_format": None}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    assert df.columns == COLUMNS[name]
    n = df.count()
    assert n == ROWS.get(name, 200) if ROWS.get(name, 200) else n > 0


def test_similarity_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.execute(simjoin.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    got = simjoin.query(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()
