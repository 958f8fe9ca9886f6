"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from findlark.llm import chat, decontam, extraction, langid, ngramlm, packing, quality, secrets, simjoin, toxicity

LONG = "the quick brown fox jumps over it " * 12_000
TEXTS = [(1, "hello there my friend, how are you today?"), (2, None), (3, ""), (4, " \n\t "), (5, "12 34 !!"), (None, "hello there"), (7, LONG), (7, LONG), (8, "a\x00b c é 💥 日本語"), (9, "hello there my friend, how are you today?")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][k % 3], None if k % 2 else "s", None if t is None else len(t)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def clash(df):
    """Extra columns with the names of results."""
    for c in ("score", "lang_pred", "sequence_id", "offset", "spans", "n", "fp", "_key", "x", "y", "group", "label", "value"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "some benchmark question of a dozen words or so stands right here"), (2, None), (3, ""), (None, "x"), (5, "a b")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (7, 0, 1), (7, 1, 0), (8, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pieces": lambda d, b, l: packing.pack(packing.pieces(d), 20),
    "langid": lambda d, b, l: langid.predict(d.select("doc_id", "text"), langid.train(d)),
    "secrets": lambda d, b, l: secrets.scan(d),
    "redact": lambda d, b, l: secrets.redact(d),
    "quality": lambda d, b, l: quality.assess(d, quality.train(d, l)),
    "simjoin": lambda d, b, l: simjoin.join(d.select("doc_id", "text")),
    "one_of_each": lambda d, b, l: simjoin.one_of_each(d.select("doc_id", "text", "lang")),
    "toxicity": lambda d, b, l: toxicity.predict(d, toxicity.train(d, l)),
    "contaminated": lambda d, b, l: decontam.contaminated(d, b),
    "clean": lambda d, b, l: decontam.clean(d, b),
    "lm": lambda d, b, l: ngramlm.score(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_kind_of_row(docs, benchmark, labels, name):
    rows = OPERATORS[name](clash(docs), clash(benchmark), clash(labels)).collect()
    if name not in ("contaminated", "one_of_each", "pieces"):
        assert len(rows) == len(TEXTS)
    assert rows or name == "contaminated"


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, benchmark, labels, name):
    assert OPERATORS[name](docs.where("false"), benchmark.where("false"), labels.where("false")).collect() == []


def test_nothing_to_learn_from(docs, benchmark, labels):
    none = labels.where("false")
    assert {r["score"] for r in OPERATORS["toxicity"](docs, benchmark, none).collect()} == {0.5}
    assert OPERATORS["quality"](docs, benchmark, none).where("doc_id = 7").first()["base_failed"]
    assert {r["lang_pred"] for r in OPERATORS["langid"](docs.withColumn("lang", F.lit(None).cast("string")), benchmark, none).collect()} == {"und"}
    assert OPERATORS["contaminated"](docs, benchmark.where("false"), none).count() == 0


def test_stages_keep_columns(spark, docs, tmp_path):
    (tmp_path / "sf").mkdir()
    b = spark.createDataFrame([(1, "some benchmark question of a dozen words or so stands right here")], "item_id long, text string")
    b.write.parquet(str(tmp_path / "sf" / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    for df in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path / "sf"))
            assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes], name
            out.collect()
    out = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    # 2-5 have no letter; 9 repeats 1; the two rows 7 are one document; 8 stays.
    assert {r["doc_id"] for r in out} == {1, None, 7, 8}


CLASHES = ("score", "lang_pred", "sequence_id", "offset", "spans", "n", "fp", "_key", "x", "y", "group", "label", "value", "_other0", "xs", "lab", "n_shingles", "_lang_pred")


def test_clashing_columns_keep_their_values(spark, docs, benchmark, tmp_path):
    """Every column goes through every operator that hands columns on, and through every stage, as it came."""
    wide = docs
    for k, c in enumerate(CLASHES):
        wide = wide.withColumn(c, F.concat(F.lit(f"{k} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    values = lambda rows, columns: {(r["doc_id"], *(r[c] for c in columns)) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, str(tmp_path))
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert rows and values(rows, CLASHES) == {(r["doc_id"], *(f"{k} {'none' if r['doc_id'] is None else r['doc_id']}" for k in range(len(CLASHES)))) for r in rows}, name
    plain = {(r["doc_id"], r["n_shingles"], r["n_similar"], r["component_id"]) for r in simjoin.join(docs.select("doc_id", "text")).collect()}
    got = simjoin.join(wide)
    kept = [c for c in CLASHES if c not in ("group", "n_shingles")]
    rows = got.collect()
    assert {(r["doc_id"], r["n_shingles"], r["n_similar"], r["component_id"]) for r in rows} == plain
    assert values(rows, kept) == values(wide.collect(), kept)
    assert values(langid.predict(wide, langid.train(wide)).collect(), ["n", "_key"]) == values(wide.collect(), ["n", "_key"])
    assert len(packing.pack(packing.pieces(wide), 20).columns) == 7


def test_pages_and_chat_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "http://h.x/a", "<p>a"), (3, "http://h.x/a", "<p>a"), (None, "no url", "<" * 5000), (6, "http://h.x/b", "<div " * 2000 + "x")], "page_id long, url string, html string")
    rows = extraction.extract(pages.withColumn("text", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("x", F.lit(1))).collect()
    assert len(rows) == 6 and [r["text"] for r in rows if r["page_id"] == 3] == ["a", "a"] and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert extraction.extract(pages.where("false")).collect() == []
    conv = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (None, None, "user", "x"), (2, 1, "assistant", "y" * 50_000), (2, 0, "a<|text|>b", "<|end|>␛")], "conv_id long, turn long, role string, text string")
    rows = {r["conv_id"]: r for r in chat.read_back(*chat.tree(conv.withColumn("node", F.lit("clash")).withColumn("k", F.lit(1)))).collect()}
    assert rows[1]["n_turns"] == 2 and rows[None]["n_turns"] == 1 and rows[2]["loss_chars"] == 50_000
    assert chat.read_back(*chat.tree(conv.where("false"))).collect() == []
