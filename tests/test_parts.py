import gzip

import pytest

from findlark.functions.analysis import ANALYZERS
from findlark.operators import evaluate as ev
from findlark.operators import filters as fl
from findlark.operators import highlight as hl
from findlark.operators.stats import SearchStats
from findlark.sources import readers

A = ANALYZERS["default"]


def test_highlight():
    show = lambda text, q, **s: hl.fragments(text, hl.wanted(q, A), A, hl.Style(**s))
    got = show("The doe foundation was founded by doe himself.", "doe")
    assert got == [("The <mark>doe</mark> foundation was founded by <mark>doe</mark> himself.", 2)]
    assert "<mark>gamma</mark>" not in show("beta gamma", "beta -gamma")[0][0]
    assert show("doe doecare x", "doe*")[0] == ("<mark>doe</mark> <mark>doecare</mark> x", 2)
    only = hl.fragments("alpha beta", hl.wanted("title:beta alpha", A, "body"), A)
    assert only == [("<mark>alpha</mark> beta", 1)]
    assert show('an "oops', '"oops')[0][1] == 1 and show("", "a") == [] and show("text", "none") == []
    long = ("word " * 100) + "needle " + ("word " * 100) + "needle needle " + ("é " * 100)
    got = show(long, "needle", fragments=1, size=40)
    assert len(got) == 1 and got[0][1] == 2 and got[0][0].startswith("... ") and got[0][0].endswith(" ...")


@pytest.mark.parametrize("kind", ["bloom", "cuckoo", "ribbon"])
def test_filters(kind):
    keys = [f"k{i}" for i in range(3000)]
    f = fl.make_filter(kind, len(keys))
    assert all(f.add(k) for k in keys) and f.add(keys[0])
    if hasattr(f, "build"):
        assert f.contains("anything")
        with pytest.raises(ValueError):
            f.serialize()
        f.build()
    back = fl.load_filter(f.serialize())
    assert all(f.contains(k) and back.contains(k) for k in keys)
    assert sum(back.contains(f"other{i}") for i in range(3000)) < 90
    raw = bytearray(f.serialize())
    raw[40] ^= 1
    with pytest.raises(ValueError):
        fl.load_filter(bytes(raw))


def test_filter_limits():
    assert fl.make_filter("none", 1) is None
    with pytest.raises(ValueError):
        fl.make_filter("x", 1)
    with pytest.raises(ValueError):
        fl.load_filter(b"????xxxxxxxxxxxx")
    small = fl.Cuckoo(1)
    assert not all([small.add(str(i)) for i in range(100)]) and small.contains("0")
    with pytest.raises(ValueError):
        fl.Ribbon(40 << 20)
    with pytest.raises(fl.NotSolvable):
        r = fl.Ribbon(10)
        r.n = 1
        r.build_with_retries([f"x{i}" for i in range(200)], 2)


def test_metrics(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1)], "query_id int, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (1, "d", 1), (2, "y", 1), (1, "a", 0)], "query_id int, doc_id string, grade int")
    assert {r[0]: r[1] for r in ev.recall_at(hits, qrels, 2).collect()} == {1: pytest.approx(1 / 3), 2: 0}
    assert {r[0]: r[1] for r in ev.reciprocal_rank(hits, qrels).collect()} == {1: 0.5, 2: 0}
    import math

    dcg, ideal = 1 / math.log2(3) + 3 / 2, 3 + 1 / math.log2(3) + 1 / 2
    assert {r[0]: r[1] for r in ev.ndcg_at(hits, qrels, 10).collect()} == {1: pytest.approx(dcg / ideal), 2: 0}
    assert ev.percentile([5, 1, 3], 0.5) == 3 and ev.percentile([], 0.5) == 0
    assert ev.measure(lambda q: q, [1, 2, 3])["qps"] > 0
    runs = spark.createDataFrame([("e", "p50", 1.0), ("e", "p50", 3.0), ("e", "p50", 2.0)], "engine string, metric string, value double")
    assert tuple(ev.summary(runs).first())[2:] == (2.0, 1.0, 3.0)


def test_search_stats():
    s = SearchStats(2)
    s.observe("secret", "term", 0.5, 0)
    s.observe("b", "term", 1.5, 3)
    s.observe("c", "phrase", 0.1, 0, error="bad")
    assert (s.total, s.errors, s.zero, s.by["term"]["longest"]) == (3, 1, 1, 1.5)
    assert [e.strategy for e in s.recent()] == ["phrase", "term"] and len(s.recent()[0].query_hash) == 16


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "a.xml.gz", "wt") as f:
        f.write("<feed><doc><title>T</title><url>u</url><abstract>A b</abstract></doc></feed>")
    r = readers.abstracts(spark, str(tmp_path / "a.xml.gz")).first()
    assert (r["title"], r["doc_id"]) == ("T", __import__("hashlib").md5(b"T|u|A b").hexdigest())
    (tmp_path / "w.xml").write_text('<mediawiki><page><title>P</title><id>1</id><revision><text xml:space="preserve"> body </text></revision></page><page><title>R</title><id>2</id><redirect title="P"/><revision><text>x</text></revision></page></mediawiki>')
    assert [tuple(r) for r in readers.wiki_pages(spark, str(tmp_path / "w.xml"), True).collect()] == [("1", "P", "P\nbody")]
    (tmp_path / "c.tsv").write_text("1\tone\ttext\n2\ttwo\nbad\n")
    assert [tuple(r) for r in readers.ranking_collection(spark, str(tmp_path / "c.tsv")).collect()] == [("1", "one\ttext"), ("2", "two")]
    (tmp_path / "q.tsv").write_text("7 0 1 1\n7 0 2 0\n")
    assert [tuple(r) for r in readers.ranking_judgements(spark, str(tmp_path / "q.tsv")).collect()] == [("7", "1", 1)]
    docs = spark.range(50).selectExpr("cast(id as string) doc_id", "'x' text")
    got = readers.sample_documents(docs, 5, spark.createDataFrame([("3",), ("4",)], "doc_id string"))
    assert got.count() == 5 and {"3", "4"} <= {r["doc_id"] for r in got.collect()}
    d, q, j = readers.synthetic(spark, docs=20, queries=4, words=10)
    assert (d.count(), q.count(), j.count()) == (20, 4, 4) and q.first()["text"]


def test_distributed_bloom(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) k").repartition(7)
    f = fl.bloom_of(keys, 5000)
    one = fl.Bloom(5000)
    for i in range(5000):
        one.add(f"k{i}")
    assert (f.bits == one.bits).all() and f.contains("k77")


def test_cached_workload(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    assert [ev.cached(spark, str(tmp_path), "v1", make).count() for _ in range(2)] == [3, 3] and len(calls) == 1


@pytest.mark.parametrize("kind", ["cuckoo", "ribbon"])
def test_sharded_filter(spark, monkeypatch, kind):
    monkeypatch.setattr(fl, "SHARD", 500)
    f = fl.sharded(kind, spark.range(5000).selectExpr("concat('k', id) k").repartition(7), 5000)
    back = fl.load_filter(f.serialize())
    assert len(f.parts) == 10 and all(f.contains(f"k{i}") and back.contains(f"k{i}") for i in range(5000))
    assert sum(back.contains(f"other{i}") for i in range(3000)) < 90
    assert not any(hasattr(p, "keys") for p in f.parts)  # what is shipped has no keys in it
    none = fl.sharded(kind, spark.createDataFrame([], "k string"), 0)
    assert not none.contains("k") and not fl.load_filter(none.serialize()).contains("k")


def test_workload_bounds_are_those_of_sql(spark):
    import duckdb

    rows = [("_default", f"t{k}", k, k) for k in range(1, 9)]
    stats = spark.createDataFrame(rows, "field string, term string, df long, cf long")
    for n in (2500, 3499, 3500, 4600, 40):
        low, high = duckdb.connect().execute(f"select greatest(2, (0.001 * n)::int), greatest(2, floor(0.1 * n)::int) from (select {n}::bigint as n)").fetchall()[0]
        assert {r["df"] for r in ev.workload_terms(stats, n, 100).collect()} == {k for k in range(1, 9) if low <= k <= high}


def test_bigrams(spark, monkeypatch):
    import random

    monkeypatch.setattr(ev, "PAIRS", 50)
    r = random.Random(1)
    docs = [[r.choice("abcd") for _ in range(r.choice([0, 1, 2, 9, 70]))] for _ in range(80)]
    want = {}
    for d in docs:
        for p in {f"{a} {b}" for a, b in zip(d, d[1:])}:
            want[p] = want.get(p, 0) + 1
    got = ev.workload_bigrams(spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(99, None)], "doc_id int, tokens array<string>"), 100, 3)
    assert {x["phrase"]: x["df"] for x in got.collect()} == {p: n for p, n in want.items() if n >= 3}


def test_exact_answers_send_only_what_is_asked(spark):
    rows = [("f", "a", "1"), ("g", "a", "1"), ("f", "b", "1"), ("f", "a", "2"), ("f", "c", "3")]
    postings = spark.createDataFrame(rows, "field string, term string, doc_id string")
    q = spark.createDataFrame([("x", "and", ["a", "b"]), ("y", "or", ["b", "c", "c"])], "query_id string, kind string, terms array<string>")
    got = ev.exact_answers(postings, q)
    assert sorted((r["query_id"], r["doc_id"], r["grade"]) for r in got.collect()) == [("x", "1", 1), ("y", "1", 1), ("y", "3", 1)]
    shown = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in shown[shown.index("Join") :].split("Generate")[0]
