import random

import pytest
from pyspark.sql import functions as F

from findlark.engine import Engine, ReadOnlyError
from findlark.operators import index as ix
from findlark.operators.index import Index
from findlark.operators.scoring import BM25, TFIDF, RankProfile
from findlark.operators.stats import SearchStats
from findlark.plans.ast import MUST, NOT, SHOULD, Boolean, FieldClause, Phrase, Prefix, QueryError, Term, must, must_not, should
from findlark.sources import store


def engine(spark, docs: dict, scorer=None, **options) -> Engine:
    """docs: id -> text or {field: text}."""
    rows = [(i, f, v) for i, d in docs.items() for f, v in (d.items() if isinstance(d, dict) else [("_default", d)])]
    return Engine(spark, scorer=scorer, **options).index_documents(spark.createDataFrame(rows, "doc_id string, field string, value string"))


def hits(result) -> list[tuple]:
    return [(r["doc_id"], r["unique_matches"], r["total_matches"]) for r in result.rows()]


def ids(result) -> list[str]:
    return [h[0] for h in hits(result)]


def test_sort_limit_and_ties(spark):
    e = engine(spark, {"a": "alpha alpha alpha beta", "b": "alpha", "c": "beta beta beta beta beta", "z": "token token", "y": "token token"})
    r = e.search_documents("alpha beta", 2)
    assert ids(r) == ["a", "c"] and r.total() == 3
    assert ids(e.search_plain_text("token")) == ["y", "z"]
    assert ids(e.search_plain_text("missing")) == [] and ids(e.search_documents("")) == []


def test_fields(spark):
    e = engine(spark, {"1": {"title": "alpha", "body": "alpha alpha"}, "2": {"body": "alpha"}})
    assert hits(e.search_documents("alpha")) == [("1", 1, 3), ("2", 1, 1)]
    assert ids(e.search_field("title", "alpha")) == ["1"] and ids(e.search_fields(["none", "body"], "alpha")) == ["1", "2"]
    assert ids(e.search_documents("title:alpha")) == ["1"] and ids(e.search_field("body", "title:alpha")) == []
    assert e.fields() == ["body", "title"]
    with pytest.raises(QueryError):
        engine(spark, {"1": {"title": "x"}}, multi_field=False)
    with pytest.raises(QueryError):
        engine(spark, {"": "x"})


def test_keys_per_token(spark):
    from pyspark.sql import functions as F

    def keys(t):
        return [t, t[0]]

    e = engine(spark, {"1": "alpha ant", "2": "apple"}, keys=keys, key_column=lambda c: F.array(c, F.substring(c, 1, 1)))
    assert hits(e.search_plain_text("alpha")) == [("1", 1, 3), ("2", 1, 1)]


def test_phrases(spark):
    e = engine(spark, {"a": "james doe gave a speech", "b": "doe speech today james was there", "c": "james doe said james doe again", "d": "x x x"})
    assert hits(e.search_documents('"james doe"')) == [("c", 1, 2), ("a", 1, 1)]
    assert hits(e.search_phrase("x x")) == [("d", 1, 2)] and hits(e.search_phrase("speech")) == [("a", 1, 1), ("b", 1, 1)]
    assert ids(e.search_phrase("")) == []


def test_near(spark):
    e = engine(spark, {"a": "james hussein doe", "b": "doe james", "c": "james speech today now doe", "d": "james doe james x doe"})
    assert hits(e.search_phrase_near("james doe", 1)) == [("d", 1, 2), ("a", 1, 1)]
    assert hits(e.search_phrase_near("james doe", 0)) == [("d", 1, 1)]
    e = engine(spark, {"a": "james x doe speech", "b": "james x y doe speech", "c": "james doe x speech", "d": "speech james x doe", "e": "james x doe speech james doe x speech"})
    assert hits(e.search_phrase_near("james doe speech", 1)) == [("e", 1, 2), ("a", 1, 1), ("c", 1, 1)]
    with pytest.raises(QueryError):
        e.search_phrase_near("a b", -1)


def test_prefix(spark):
    e = engine(spark, {"1": "bar barge bark", "2": "foo"})
    assert hits(e.search_documents("bar*")) == [("1", 1, 3)] and ids(e.search(Prefix(""))) == [] and ids(e.search(Prefix("BAR"))) == []


def test_accounting(spark):
    e = engine(spark, {"1": "foo bar baz x y"})
    assert hits(e.search_documents("foo-bar")) == [("1", 2, 2)]
    assert hits(e.search_documents("foo-bar baz")) == [("1", 2, 3)]
    assert hits(e.search_documents('foo-bar "x y"')) == [("1", 3, 3)]
    assert hits(e.search_documents("foo foo")) == [("1", 2, 2)]
    assert hits(e.search_documents("+foo-bar baz-x")) == [("1", 3, 4)]


def test_boolean(spark):
    e = engine(spark, {"a": "alpha beta", "b": "alpha beta delta", "c": "alpha", "d": "delta"}, TFIDF())
    r = e.search_documents("+alpha +beta delta")
    assert ids(r) == ["b", "a"] and r.diagnostics.strategy == "bool_and_fast"
    assert ids(e.search_documents("-alpha")) == [] and ids(e.search_documents("delta -alpha")) == ["d"]
    assert sorted(ids(e.search_documents("+(beta delta) -c"))) == ["a", "b", "d"]
    assert ids(e.search(Boolean((must(None), should(Term("beta")), must_not(Term("delta")))))) == ["a"]
    assert ids(e.search(None)) == []
    assert ids(e.search_documents("+alpha +none")) == []
    with pytest.raises(QueryError):
        e.search_field_clauses([FieldClause(MUST, "_default", " ")])
    got = e.search_field_clauses([FieldClause(MUST, "_default", "alpha"), FieldClause(SHOULD, "_default", "beta"), FieldClause(NOT, "_default", "delta")])
    assert ids(got) == ["a", "c"] and ids(e.search_field_clauses([])) == []


def test_scores(spark):
    e = engine(spark, {"1": "a a b", "2": "a c c c c", "3": ""}, BM25())
    import math

    n, df, avg = 3, 2, 8 / 3
    one = math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg))
    r = e.search_plain_text("a").rows()
    assert r[0]["doc_id"] == "1" and abs(r[0]["score"] - one) < 1e-9
    x = e.explain("a b", "1").collect()
    assert [(c["term"], c["tf"], c["df"], c["n_docs"]) for c in x] == [("a", 2, 2, 3), ("b", 1, 1, 3)]
    assert e.explain("zzz", "1").count() == 0 and e.explain("a", "none").count() == 0
    with pytest.raises(QueryError):
        e.explain("a", "")
    assert e.search_documents('"a a"').rows()[0]["score"] > 0


def test_profile(spark):
    docs = {"1": {"t": "w"}, "2": {"u": "w"}}
    assert ids(engine(spark, docs, RankProfile(BM25(), {"u": 5.0}, {"term": 0.0})).search_plain_text("w")) == ["2", "1"]
    zero = engine(spark, docs, RankProfile(BM25(), {"u": 0.0})).search_plain_text("w").rows()
    assert [(r["doc_id"], r["score"] > 0) for r in zero] == [("1", True), ("2", False)]
    assert engine(spark, docs, RankProfile(None)).search_plain_text("w").rows()[0]["score"] == 0


def test_changes(spark):
    called = []
    e = engine(spark, {"a": "x y", "b": "x", "c": "x z z z"}, BM25(), compaction_limit=0.3, on_compaction=called.append)
    assert e.delete(["a", "none"]) == 1 and len(called) == 1
    assert set(ids(e.search_documents("x"))) == {"b", "c"} and ids(e.search_documents('"x y"')) == [] and ids(e.search_documents("y*")) == []
    s = e.index.field_stats().first()
    assert (s["n_docs"], s["avg_len"]) == (2, 2.5)
    e.update(spark.createDataFrame([("b", "y y")], "doc_id string, text string"))
    assert hits(e.search_documents("y")) == [("b", 1, 2)] and len(called) == 2
    assert e.compaction_stats() == {"assigned": 4, "tombstoned": 2, "load": 0.5} and e.needs_compaction()
    e.compact()
    assert e.compaction_stats()["tombstoned"] == 0 and hits(e.search_documents("y")) == [("b", 1, 2)]
    e.index_documents(spark.createDataFrame([("b", "y")], "doc_id string, text string"))
    assert hits(e.search_documents("y"))[0] == ("b", 1, 2 if e.version == 0 else 3)


def test_property_against_sets(spark):
    r = random.Random(7)
    words = [f"t{i:03d}" for i in range(30)]
    docs = {f"d{i}": " ".join(r.sample(words, r.randint(1, 10))) for i in range(200)}
    e = engine(spark, docs, BM25()).persist()
    for _ in range(3):
        a, b = r.sample(words, 2)
        has = lambda w: {i for i, t in docs.items() if w in t.split()}
        assert set(ids(e.search_documents(f"+{a} +{b}"))) == has(a) & has(b)
        assert set(ids(e.search_documents(f"{a} {b}"))) == has(a) | has(b)
        assert ids(e.search_documents(f"{a} {b}", 5)) == ids(e.search_documents(f"{a} {b}"))[:5]
        assert set(ids(e.search_documents(f"+{a} -{b}"))) == has(a) - has(b)


def test_batch_equals_single(spark):
    e = engine(spark, {"1": "a b", "2": "a a", "3": "b c"}, BM25(), score_digits=6)
    q = spark.createDataFrame([(1, "a b"), (2, "c c"), (3, None), (4, "zzz")], "query_id int, text string")
    got = {}
    for r in e.search_many(q, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["unique_matches"], r["total_matches"], r["score"]))
    one = lambda t: [(r["doc_id"], r["unique_matches"], r["total_matches"], r["score"]) for r in e.search_plain_text(t, 2).rows()]
    assert got == {1: one("a b"), 2: one("c c")}


def test_postings_push_down(spark, tmp_path):
    from findlark.sources import store

    e = engine(spark, {"1": "foo bar", "2": "foo"}, BM25())
    store.save_segment(e, str(tmp_path / "s"))
    s = store.load(spark, str(tmp_path / "s"), scorer=BM25())
    plan = s.search_documents("foo bar*").results._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "StringStartsWith(term,bar)" in plan and "positions" not in plan.split("== Physical Plan ==")[1].split("ReadSchema")[1].split(">")[0]
    with pytest.raises(ReadOnlyError):
        s.delete(["1"])
    with pytest.raises(ReadOnlyError):
        s.index_documents(spark.createDataFrame([("9", "x")], "doc_id string, text string"))


def test_storage(spark, tmp_path):
    from findlark.operators.filters import make_filter
    from findlark.sources import store

    e = engine(spark, {"a": {"title": "x y"}, "b": {"title": "x"}}, BM25(), filter=make_filter("cuckoo", 100))
    e.delete(["b"])
    path = str(tmp_path / "snap")
    store.save_snapshot(e, path)
    store.save_snapshot(e, path)  # over the old one
    s = store.load(spark, path, scorer=BM25())
    assert ids(s.search_documents("x")) == ["a"] and s.filter.contains("y") and s.fields() == ["title"]
    s.update(spark.createDataFrame([("a", "title", "z")], "doc_id string, field string, value string"))
    assert ids(s.search_documents("z")) == ["a"] and ids(s.search_documents("y")) == []
    with pytest.raises(store.StoreError):
        store.load(spark, path, analyzer="english")
    with pytest.raises(store.StoreError):
        store.load(spark, path, expect_fingerprint="0")
    with pytest.raises(store.StoreError):
        store.load(spark, str(tmp_path / "none"))
    (tmp_path / "snap" / "manifest.json").write_text("{")
    with pytest.raises(store.StoreError):
        store.load(spark, path)
    with pytest.raises(ValueError):
        store.register_codec("bloom", lambda f: b"", lambda b: None)
    assert ix.POSTINGS


def test_stream(spark, tmp_path):
    from findlark.streaming.ingest import ingest, open_index

    schema = "doc_id string, field string, value string"
    for n, rows in enumerate([[("1", "t", "a b"), ("2", "t", "a")], [("1", "t", "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    e = Engine(spark, index=open_index(spark, str(tmp_path / "ix")))
    assert ids(e.search_documents("a")) == ["2"] and ids(e.search_documents("c")) == ["1"]


def test_config(spark):
    from findlark.config import EngineConfig

    assert EngineConfig(field_weights={"t": 2.0}).engine(spark).scorer.fields == {"t": 2.0}
    for bad in ({"analyzer": "x"}, {"index": "x"}, {"scorer": "x"}, {"filter": "x"}, {"b": 2.0}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    assert Phrase("a").near is None


def test_kinds_and_diagnostics(spark):
    from findlark.operators.evaluate import run_kind

    e = engine(spark, {"1": "foo bar", "2": "foo"}, BM25())
    assert [ids(run_kind(e, k, t)) for k, t in (("text", "foo"), ("term", "bar"), ("phrase", "foo bar"), ("prefix", "ba"), ("boolean", "+foo -bar"))] == [["2", "1"], ["1"], ["1"], ["1"], ["2"]]
    with pytest.raises(ValueError):
        run_kind(e, "x", "y")
    d = e.search_documents('foo "foo bar"', 1).diagnose()
    assert (d["strategy"], d["matched"], d["returned"]) == ("bool_fallback", 2, 1) and "or_fast_non_term_clause" in d["skip_reasons"]
    r = e.search_documents("foo bar", 1)
    assert r.total() == 2 and r.total(compat=True) == 1


def test_statistics_see_results_and_errors(spark):
    stats = SearchStats()
    e = engine(spark, {"1": "alpha beta", "2": "alpha"}, stats=stats)
    assert len(e.search_documents("alpha").rows()) == 2 and e.search_documents("gamma").rows() == []
    with pytest.raises(QueryError):
        e.search_documents('"open')
    assert (stats.total, stats.errors, stats.zero) == (3, 1, 1)
    assert stats.by["term"]["count"] == 2 and stats.by["term"]["returned"] == 2 and stats.by["term"]["seconds"] > 0
    assert [x.returned for x in stats.recent()] == [0, 0, 2] and stats.recent()[0].error


def test_segments_are_checked(spark, tmp_path):
    e = engine(spark, {str(k): f"alpha beta{k % 7} gamma" for k in range(50)})
    path = str(tmp_path / "s")
    store.save_segment(e, path)
    assert store.verify(spark, path) == [] and store.load(spark, path, check=True).sealed
    part = next((tmp_path / "s").glob("*/postings/part-*"))
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    (part.parent / f".{part.name}.crc").unlink()  # the local file system's own
    assert store.verify(spark, path) == [f"postings/{part.name}"]
    with pytest.raises(store.StoreError, match="damaged"):
        store.load(spark, path, check=True)
    rows = [("f", "b", "1", 0), ("f", "a", "1", 0), ("f", "c", "1", 0), ("f", "c", "1", 0), ("f", "", "1", 0)]
    wrong = spark.createDataFrame(rows, "field string, term string, doc_id string, ver long").coalesce(1)
    assert store.faults(wrong) == {"empty": 1, "disorder": 2, "twice": 1}
    twice = Index(e.index.postings.union(e.index.postings), e.index.doc_stats)
    e.index = twice
    with pytest.raises(store.StoreError, match="twice"):
        store.save_segment(e, str(tmp_path / "t"))


def test_order_is_checked_by_file(spark, tmp_path):
    """A task reads several files, the largest first: that is no disorder."""
    schema, path = "field string, term string, doc_id string, ver long", str(tmp_path / "p")
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    row = lambda k: ("f", f"t{k:05d}", "1", 0)
    write([row(k) for k in range(10)])
    write([row(k) for k in range(10, 3000)])
    read = lambda: spark.read.parquet(path).coalesce(1)
    assert store.faults(read(), F.col("_metadata.file_name")) == {}
    write([row(2999), row(3001)])
    assert store.faults(read(), F.col("_metadata.file_name")) == {"twice": 1}
    write([row(5), row(6)])
    assert store.faults(read(), F.col("_metadata.file_name"))["disorder"] == 1


def test_segment_of_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PART", 500)
    e = engine(spark, {str(k): f"alpha beta{k % 97} gamma {'delta ' * (k % 3)}" for k in range(300)}, BM25())
    store.save_segment(e, str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("*/postings/part-*"))) > 3
    assert hits(store.load(spark, str(tmp_path / "s"), scorer=BM25()).search_documents("beta7 delta")) == hits(e.search_documents("beta7 delta"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_indexing_has_no_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ix, "CHUNK", 40)
    r = random.Random(3)
    docs = {f"d{i}": " ".join(r.choice("abcdefg") * r.randint(1, 2) for _ in range(r.choice([0, 1, 5, 30, 90]))) for i in range(60)}
    e = engine(spark, docs)
    assert "Exchange" not in plan(e.index.postings) and "Exchange" not in plan(e.index.doc_stats)
    want = {(w, i): [k for k, x in enumerate(t.split()) if x == w] for i, t in docs.items() for w in set(t.split())}
    got = e.index.postings.collect()
    assert {(x["term"], x["doc_id"]): x["positions"] for x in got} == want and len(got) == len(want)
    assert all(x["tf"] == len(x["positions"]) and x["dl"] == len(docs[x["doc_id"]].split()) for x in got)
    assert {x["doc_id"]: x["dl"] for x in e.index.doc_stats.collect()} == {i: len(t.split()) for i, t in docs.items()}
    e.update(spark.createDataFrame([("d1", "zz"), ("d2", "zz yy zz")], "doc_id string, text string"))
    assert "Exchange" not in plan(e.index.postings) and hits(e.search_plain_text("zz")) == [("d2", 1, 2), ("d1", 1, 1)]


def test_repeated_rows_add_up(spark):
    rows = [("1", "f", "a b"), ("1", "f", "b a a"), ("1", "g", "a"), ("2", "f", None), (None, "f", "a")]
    e = Engine(spark).index_documents(spark.createDataFrame(rows, "doc_id string, field string, value string"), check=False)
    got = {(x["field"], x["term"], x["doc_id"]): (x["tf"], x["positions"], x["dl"]) for x in e.index.postings.collect()}
    assert got == {("f", "a", "1"): (3, [0, 1, 2], 3), ("f", "b", "1"): (2, [0, 1], 3), ("g", "a", "1"): (1, [0], 1), ("f", "a", None): (1, [0], 1)}
    assert {(x["field"], x["doc_id"]): x["dl"] for x in e.index.doc_stats.collect()} == {("f", "1"): 3, ("g", "1"): 1, ("f", "2"): 0, ("f", None): 1}


def test_selected_terms_reach_the_tokens(spark):
    e = engine(spark, {"1": "a b a", "2": "", "3": "b c"}, BM25())
    shown = e.index.live_postings(F.col("term").isin("a", "c"))._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("regexp_extract_all") == 1 and shown.index("Aggregate") < shown.index("Filter") < shown.index("Generate")
    e.delete(["3"])
    e.update(spark.createDataFrame([("2", "a a")], "doc_id string, text string"))
    want = e.index.live_postings().where("term = 'a'")
    got = e.index.live_postings(F.col("term") == "a")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() == 2


def test_batch_counts_tokens_once(spark, tmp_path):
    """Each token of a query meets a document once, whatever its fields: no distinct count has to travel."""
    e = engine(spark, {"1": {"t": "a b", "u": "a a"}, "2": {"u": "b"}}, BM25(), score_digits=6)
    q = spark.createDataFrame([(1, "a b a"), (2, "b")], "query_id int, text string")
    got = e.search_many(q, 5)
    assert "distinct" not in plan(got)
    assert sorted((r["query_id"], r["doc_id"], r["unique_matches"], r["total_matches"]) for r in got.collect()) == [(1, "1", 3, 7), (1, "2", 1, 1), (2, "1", 1, 1), (2, "2", 1, 1)]
    one = engine(spark, {"1": "a b", "2": "a a"}, BM25(), score_digits=6)
    store.save_segment(one, str(tmp_path / "s"))
    sealed = store.load(spark, str(tmp_path / "s"), scorer=BM25(), score_digits=6)
    assert sealed.index.one_field and sorted(map(tuple, sealed.search_many(q, 5).collect())) == sorted(map(tuple, one.search_many(q, 5).collect()))
