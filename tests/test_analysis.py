import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findlark.functions import analysis as an
from findlark.functions import stemmers


@pytest.mark.parametrize(
    ("name", "text", "tokens"),
    [
        ("alnum", "Wikipedia: The Sans Souci Hotel was built in 1803.", "Wikipedia The Sans Souci Hotel was built in 1803"),
        ("english", "The Rosa hotel was in 1990", "rosa hotel 1990"),
        ("russian", "И машины были в 2024 году", "машин 2024 год"),
        ("multilingual", "The cars и машины were in 2024", "car машин 2024"),
        ("observability", "request not found 10.0.0.1 io.EOF checkout-api/v2", "request not found 10.0.0.1 10 0 1 io.eof io eof checkout-api/v2 checkout api v2"),
        ("default", "ΑΣ İx Ⅳ²a", "ασ ix a"),
    ],
)
def test_golden(name, text, tokens):
    assert an.ANALYZERS[name].tokens(text) == tokens.split()


def test_filters():
    assert an.min_length(3).python(["go", "api", "404", "x"]) == ["api", "404"]
    assert an.min_length(3).python(["go", "юю", "api", "ошибка"]) == ["api", "ошибка"]
    assert an.STOP_RUSSIAN.python(["и", "машины", "в", "2024"]) == ["машины", "2024"]
    assert an.STEM_RUSSIAN.python(["машины", "поездов", "2024"]) == ["машин", "поезд", "2024"]
    assert an.STEM_MULTILINGUAL.python(["cars", "машины", "abcдеф", "2024"]) == ["car", "машин", "abcдеф", "2024"]
    assert an.is_numeric("18446744073709551615") and an.is_numeric("0001") and not an.is_numeric("18446744073709551616") and not an.is_numeric("9" * 45)
    assert an.Analyzer(name="", filters=(None,)).name == "custom"
    assert len(an.ANALYZERS["default"].fingerprint) == 64
    with pytest.raises(ValueError):
        an.analyzer("none such")


@pytest.mark.parametrize(("word", "stem"), [("consigned", "consign"), ("knightly", "knight"), ("generously", "generous"), ("relational", "relat"), ("running", "run"), ("hopping", "hop"), ("hoping", "hope"), ("dying", "die"), ("happy", "happi"), ("agreed", "agre"), ("cries", "cri"), ("ties", "tie"), ("gas", "gas"), ("this", "this"), ("kiwis", "kiwi"), ("exceed", "exceed")])
def test_porter2(word, stem):
    assert stemmers.english(word) == stem


TEXTS = ["", None, "The Rosa hotel was in 1990", "a.b-c/d  x_y ΑΣ İ 10.0.0.1", "It's 007 and 18446744073709551616", "И машины, cars abcдеф!", " nb sp\tz", "💥 é̩ ²Ⅳ"]


@pytest.mark.parametrize("name", list(an.ANALYZERS))
def test_columns_equal_lists(spark, name):
    a = an.ANALYZERS[name]
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r["i"]: list(r["t"]) for r in rows.select("i", a.column(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    assert got == {i: a.tokens(t) for i, t in enumerate(TEXTS)}


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00", max_codepoint=0x4FF), max_size=40), min_size=1, max_size=200))
def test_default_property(spark, texts):
    a = an.ANALYZERS["default"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: list(r["t"]) for r in rows.select("i", a.column(F.col("text")).alias("t")).collect()}
    assert [w for w in got.values()] and all([x.lower() for x in got[i]] == [x.lower() for x in a.tokens(t)] for i, t in enumerate(texts))


def test_clean(spark):
    rows = spark.createDataFrame([(" a\nb\x07<c>. ",)], "t string")
    assert rows.select(an.clean_text(F.col("t"))).first()[0] == "a bc."


def test_lower_case_leaves_tokens_as_they_were(spark):
    texts = [f"{c} A{c}B Σ{c} {c}Σ" for c in map(chr, [*range(1, 0x700), *range(0x1E00, 0x2200), *range(0x2C00, 0x2E00), *range(0xA640, 0xA800), *range(0x10400, 0x10500)])]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    each = F.transform(F.regexp_extract_all("t", F.lit(an.ALNUM), F.lit(0)), lambda x: F.lower(F.translate(x, "Σİ", "σi")))
    assert rows.where(each != an.ANALYZERS["default"].column(F.col("t"))).count() == 0


def test_stop_words_are_looked_up_in_a_set(spark):
    rows = spark.createDataFrame([("the и abc the2 theи",)], "t string")
    for name in ("english", "russian", "multilingual"):
        df = rows.select(an.ANALYZERS[name].column(F.col("t")).alias("x"))
        assert "array_contains" not in df._jdf.queryExecution().optimizedPlan().toString()
