"""Registered queries of the search engine over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import analysis as an
from .operators import evaluate as ev
from .operators import highlight as hl
from .operators import index as ix
from .operators.filters import bloom_of, sharded
from .operators.stats import SearchStats
from .operators.scoring import BM25, TFIDF, RankProfile
from .plans.ast import MUST, NOT, SHOULD, Boolean, FieldClause, Phrase, Prefix, QueryError, Term, must, must_not, should

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, scorer=None, **options) -> Engine:
    """An engine over documents.text."""
    return Engine(spark, scorer=scorer, score_digits=DIGITS, **options).index_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), check=False)


#: By session and table, where its sealed index is.
_BUILT: dict[tuple[str, str], str] = {}


def built(spark: SparkSession, sf_dir: str, scorer=None) -> Engine:
    """An engine over the sealed index of documents.text, which is built and written once a session."""
    from .sources import store

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        path = _folder(spark)
        store.save_segment(documents(spark, sf_dir), path)
        _BUILT[key] = path
    return store.load(spark, _BUILT[key], scorer=scorer, score_digits=DIGITS)


def parts(spark: SparkSession, sf_dir: str, scorer=None) -> Engine:
    """An engine over three fields of part."""
    rows = ix.long_form(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])
    return Engine(spark, scorer=scorer, score_digits=DIGITS).index_documents(rows, check=False)


# -- SQL parts ---------------------------------------------------------------------------------------------

RUN = r"[\p{L}\p{Nd}]+"
TOK = rf"""tok AS (SELECT doc_id::VARCHAR AS doc_id, lower(unnest(l)) AS term, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '{RUN}') AS l FROM documents)),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT d.doc_id::VARCHAR AS doc_id, count(t.term) AS dl FROM documents d LEFT JOIN tok t ON t.doc_id = d.doc_id::VARCHAR GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS al FROM dl)"""
FIELD_TOK = rf"""src AS (SELECT p_partkey::VARCHAR AS doc_id, unnest(['p_name', 'p_brand', 'p_type']) AS field, unnest([p_name, p_brand, p_type]) AS value FROM part),
tok AS (SELECT doc_id, field, lower(unnest(l)) AS term, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, field, regexp_extract_all(value, '{RUN}') AS l FROM src)),
post AS (SELECT field, term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT field, doc_id, count(*) AS dl FROM tok GROUP BY ALL),
st AS (SELECT field, count(*) AS n, avg(dl) AS al FROM dl GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL)"""
BM = "ln(1 + exp(ln(n - df + 0.5) - ln(df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))"
TI = "tf * greatest(0, ln(n / df))"


def terms_sql(clauses: list[tuple[int, int, str]], score: str = BM) -> str:
    """CTE sc(clause, token, doc_id, tf, s) of (clause, token, term)."""
    values = ", ".join(f"({c}, {t}, '{w}')" for c, t, w in clauses)
    return f"""q(clause, token, term) AS (VALUES {values}),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
sc AS (SELECT clause, token, doc_id, tf, {score} AS s FROM q JOIN post USING (term) JOIN dfs USING (term) JOIN dl USING (doc_id) CROSS JOIN st)"""


OUT = "doc_id, unique_matches::BIGINT AS unique_matches, total_matches::BIGINT AS total_matches, score::DOUBLE AS score"


def top(rows: str, k: int) -> str:
    limit = f" LIMIT {k}" if k else ""
    return f"SELECT {OUT} FROM ({rows}) ORDER BY score DESC, unique_matches DESC, total_matches DESC, doc_id{limit}"


FLAT = f"SELECT doc_id, count(DISTINCT token) AS unique_matches, sum(tf) AS total_matches, round(sum(s), {DIGITS}) AS score FROM sc GROUP BY doc_id"


def clauses_sql(having: str, once: str = "true") -> str:
    """Documents by clause; occur is a column of c. once: which clauses count one match each."""
    return f"""SELECT doc_id, sum(CASE WHEN {once} THEN 1 ELSE u END) FILTER (WHERE occur <> 'not') AS unique_matches, sum(t) FILTER (WHERE occur <> 'not') AS total_matches,
  round(sum(s) FILTER (WHERE occur <> 'not'), {DIGITS}) AS score FROM c GROUP BY doc_id HAVING {having}"""


def by_clause(occur: dict[int, str]) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in occur.items())
    return f"c AS (SELECT doc_id, clause, CASE clause {cases} END AS occur, count(DISTINCT token) AS u, sum(tf) AS t, sum(s) AS s FROM sc GROUP BY ALL)"


def strings(tokens) -> str:
    return f"array_to_string({tokens}, ' ')"


# -- index and analysis --------------------------------------------------------------------------------------


@query("index_postings", f"WITH {TOK} SELECT '_default' AS field, term, doc_id, count(*)::BIGINT AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok GROUP BY ALL")
def index_postings(spark, sf):
    return documents(spark, sf).index.postings.select("field", "term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("index_doc_stats", f"WITH {TOK} SELECT '_default' AS field, doc_id, dl::BIGINT AS dl FROM dl")
def index_doc_stats(spark, sf):
    return documents(spark, sf).index.doc_stats.select("field", "doc_id", "dl")


@query("index_field_stats", f"WITH {FIELD_TOK} SELECT field, n::BIGINT AS n_docs, round(al, 6) AS avg_len FROM st")
def index_field_stats(spark, sf):
    return parts(spark, sf).index.field_stats().select("field", "n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("index_term_stats", f"WITH {TOK} SELECT '_default' AS field, term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term")
def index_term_stats(spark, sf):
    return documents(spark, sf).index.term_stats()


def _tokens(spark, sf, a: an.Analyzer, of: str = "documents", id_: str = "doc_id", text: str = "text") -> DataFrame:
    t = table(spark, sf, of).select(F.col(id_).alias("id"), a.column(F.col(text)).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


_LIST = f"SELECT doc_id AS id, list_transform(regexp_extract_all(text, '{RUN}'), lambda x: lower(x)) AS t FROM documents"
_SHOWN = "SELECT id, len(t)::BIGINT AS n, array_to_string(t, ' ') AS tokens FROM"


@query("tokenize_default", f"{_SHOWN} ({_LIST})")
def tokenize_default(spark, sf):
    return _tokens(spark, sf, an.ANALYZERS["default"])


@query("tokenize_min_length", f"{_SHOWN} (SELECT id, list_filter(t, lambda x: length(x) >= 3 OR regexp_full_match(x, '[0-9]+')) AS t FROM ({_LIST}))")
def tokenize_min_length(spark, sf):
    return _tokens(spark, sf, an.Analyzer("m", "1", an.ALNUM_TOKENIZER, (an.LOWERCASE, an.min_length(3))))


@query(
    "tokenize_unique",
    f"""WITH x AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM ({_LIST})), f AS (SELECT id, w, min(p) AS p FROM x GROUP BY ALL)
SELECT d.doc_id AS id, count(w)::BIGINT AS n, coalesce(string_agg(w, ' ' ORDER BY p), '') AS tokens FROM documents d LEFT JOIN f ON f.id = d.doc_id GROUP BY d.doc_id""",
)
def tokenize_unique(spark, sf):
    return _tokens(spark, sf, an.Analyzer("u", "1", an.ALNUM_TOKENIZER, (an.LOWERCASE, an.UNIQUE)))


_TRIM = r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$"


@query(
    "tokenize_observability",
    rf"""WITH w AS (SELECT event_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM (SELECT event_id, string_split_regex(props, '[\s\p{{Z}}]+') AS l FROM events)),
k AS (SELECT event_id, i, regexp_replace(raw, '{_TRIM}', '', 'g') AS a FROM w),
p AS (SELECT event_id, i, CASE WHEN regexp_matches(a, '[^\p{{L}}\p{{Nd}}]') THEN list_concat([a], regexp_extract_all(a, '{RUN}')) ELSE regexp_extract_all(a, '{RUN}') END AS l FROM k WHERE a <> ''),
t AS (SELECT event_id, i, lower(unnest(l)) AS x, generate_subscripts(l, 1) AS j FROM p),
f AS (SELECT event_id, x, min(i * 1000 + j) AS o FROM t WHERE length(x) >= 2 OR regexp_full_match(x, '[0-9]+') GROUP BY ALL)
SELECT e.event_id AS id, count(x)::BIGINT AS n, coalesce(string_agg(x, ' ' ORDER BY o), '') AS tokens FROM events e LEFT JOIN f USING (event_id) GROUP BY e.event_id""",
)
def tokenize_observability(spark, sf):
    return _tokens(spark, sf, an.ANALYZERS["observability"], "events", "event_id", "props")


_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(an.stopwords.ENGLISH)) + "]"


@query("stop_words_english", f"{_SHOWN} (SELECT id, list_filter(t, lambda x: NOT list_contains({_STOP}, x)) AS t FROM ({_LIST}))")
def stop_words_english(spark, sf):
    return _tokens(spark, sf, an.Analyzer("s", "1", an.ALNUM_TOKENIZER, (an.LOWERCASE, an.STOP_ENGLISH)))


@query("stem_english")
def stem_english(spark, sf):
    return _tokens(spark, sf, an.ANALYZERS["english"])


@query("stem_russian")
def stem_russian(spark, sf):
    rows = spark.createDataFrame([(1, "И машины были в 2024 году"), (2, "Поездов и машин"), (3, None)], "id long, text string")
    t = rows.select("id", an.ANALYZERS["russian"].column(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("multilingual")
def multilingual(spark, sf):
    return _tokens(spark, sf, an.ANALYZERS["multilingual"])


@query("clean_text", r"SELECT doc_id AS id, trim(regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '[^\p{L}\p{N}\p{P}\p{Z}]', '', 'g')) AS text FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), an.clean_text(F.col("text")).alias("text"))


# -- terms and fields ------------------------------------------------------------------------------------------


@query("term_search", f"WITH {TOK}, {terms_sql([(0, 0, 'oror')])} {top(FLAT, 0)}")
def term_search(spark, sf):
    return built(spark, sf, BM25()).search(Term("OROR")).results


@query("plain_text_search", f"WITH {TOK}, {terms_sql([(0, 0, 'oror'), (0, 1, 'atshsh'), (0, 2, 'oror')])} {top(FLAT, 0)}")
def plain_text_search(spark, sf):
    return built(spark, sf, BM25()).search_plain_text("+oror -atshsh oror").results


def _field_sql(where: str, terms: list[str], score: str = BM, weight: str = "1") -> str:
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""q(token, term) AS (VALUES {values}),
sc AS (SELECT field, token, doc_id, tf, {weight} * {score} AS s FROM q JOIN post USING (term) JOIN dfs USING (field, term) JOIN dl USING (field, doc_id) JOIN st USING (field) WHERE {where})"""


@query("field_search", f"WITH {FIELD_TOK}, {_field_sql("field = 'p_name'", ['red', 'ring'])} {top(FLAT, 0)}")
def field_search(spark, sf):
    return parts(spark, sf, BM25()).search_field("p_name", "red ring").results


@query("fields_search", f"WITH {FIELD_TOK}, {_field_sql("field IN ('p_name', 'p_type')", ['red', 'economy'])} {top(FLAT, 25)}")
def fields_search(spark, sf):
    return parts(spark, sf, BM25()).search_fields(["p_name", "p_type"], "red economy", 25).results


@query(
    "field_clauses",
    f"""WITH {FIELD_TOK}, e(clause, occur, field, term) AS (VALUES (0, 'must', 'p_name', 'red'), (1, 'should', 'p_type', 'economy'), (2, 'not', 'p_name', 'ring')),
c AS (SELECT doc_id, clause, occur, 1 AS u, sum(tf) AS t, sum({BM}) AS s FROM e JOIN post USING (field, term) JOIN dfs USING (field, term) JOIN dl USING (field, doc_id) JOIN st USING (field) GROUP BY ALL)
{top(clauses_sql("count(*) FILTER (WHERE occur = 'must') = 1 AND count(*) FILTER (WHERE occur = 'not') = 0"), 0)}""",
)
def field_clauses(spark, sf):
    return parts(spark, sf, BM25()).search_field_clauses([FieldClause(MUST, "p_name", "red"), FieldClause(SHOULD, "p_type", "economy"), FieldClause(NOT, "p_name", "ring")]).results


# -- boolean ---------------------------------------------------------------------------------------------------


def _bool(name: str, text: str, clauses: list[tuple[int, int, str]], occur: dict[int, str], having: str, once: str = "true", k: int = 0):
    sql = f"WITH {TOK}, {terms_sql(clauses)}, {by_clause(occur)} {top(clauses_sql(having, once), k)}"

    @query(name, sql)
    def run(spark, sf):
        return built(spark, sf, BM25()).search_documents(text, k).results

    return run


_MUST2 = "count(*) FILTER (WHERE occur = 'must') = 2"
_bool("bool_and", "+the +erin", [(0, 0, "the"), (1, 0, "erin")], {0: "must", 1: "must"}, _MUST2)
_bool("bool_or", "oror atshsh oror", [(0, 0, "oror"), (1, 0, "atshsh"), (2, 0, "oror")], {0: "should", 1: "should", 2: "should"}, "true")
_bool("bool_not", "+the -of", [(0, 0, "the"), (1, 0, "of")], {0: "must", 1: "not"}, "count(*) FILTER (WHERE occur = 'must') = 1 AND count(*) FILTER (WHERE occur = 'not') = 0")
_bool("bool_should_boost", "+erin +thin oror the", [(0, 0, "erin"), (1, 0, "thin"), (2, 0, "oror"), (3, 0, "the")], {0: "must", 1: "must", 2: "should", 3: "should"}, _MUST2, "occur = 'must'")
_bool("bool_multi_token_accounting", "erin-thin oror", [(0, 0, "erin"), (0, 1, "thin"), (1, 0, "oror")], {0: "should", 1: "should"}, "true", "true")


@query(
    "bool_nested",
    f"""WITH {TOK}, {terms_sql([(0, 0, "erin"), (1, 0, "oror"), (2, 0, "atshsh"), (3, 0, "of")])},
g AS (SELECT doc_id, count(DISTINCT clause) AS u, sum(tf) AS t, sum(s) AS s FROM sc WHERE clause IN (1, 2) GROUP BY ALL),
c AS (SELECT doc_id, 0 AS clause, 'must' AS occur, 1 AS u, tf AS t, s FROM sc WHERE clause = 0 UNION ALL SELECT doc_id, 1, 'must', u, t, s FROM g UNION ALL SELECT doc_id, 2, 'not', 1, tf, s FROM sc WHERE clause = 3)
{top(clauses_sql(_MUST2 + " AND count(*) FILTER (WHERE occur = 'not') = 0", "false"), 0)}""",
)
def bool_nested(spark, sf):
    return built(spark, sf, BM25()).search_documents("+erin +(oror atshsh) -of").results


# -- phrases and prefixes --------------------------------------------------------------------------------------


def _phrase_scored(ph: str) -> str:
    """Result of ph(doc_id, tf): df is the number of documents with the phrase."""
    return f"""{ph}, sc AS (SELECT doc_id, 0 AS token, tf, {BM} AS s FROM ph JOIN dl USING (doc_id) CROSS JOIN st CROSS JOIN (SELECT count(*) AS df FROM ph))"""


_OF_THE = "ph AS (SELECT a.doc_id, count(*) AS tf FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY ALL)"


@query("phrase_exact", f"WITH {TOK}, {_phrase_scored(_OF_THE)} {top(FLAT, 0)}")
def phrase_exact(spark, sf):
    return built(spark, sf, BM25()).search_documents('"of the"').results


_NEAR = """n1 AS (SELECT a.doc_id, a.pos AS s, min(b.pos) AS p FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos > a.pos AND b.pos <= a.pos + 1 + {g} WHERE a.term = '{a}' AND b.term = '{b}' GROUP BY ALL)"""


@query("phrase_near_1", f"WITH {TOK}, {_NEAR.format(g=1, a='the', b='erin')}, {_phrase_scored('ph AS (SELECT doc_id, count(*) AS tf FROM n1 GROUP BY ALL)')} {top(FLAT, 0)}")
def phrase_near_1(spark, sf):
    return built(spark, sf, BM25()).search_phrase_near("the erin", 1).results


@query(
    "phrase_near_3tok",
    f"WITH {TOK}, {_NEAR.format(g=4, a='the', b='of')}, n2 AS (SELECT n1.doc_id, s, min(c.pos) AS p FROM n1 JOIN tok c ON c.doc_id = n1.doc_id AND c.pos > n1.p AND c.pos <= n1.p + 5 WHERE c.term = 'the' GROUP BY ALL), {_phrase_scored('ph AS (SELECT doc_id, count(*) AS tf FROM n2 GROUP BY ALL)')} {top(FLAT, 20)}",
)
def phrase_near_3tok(spark, sf):
    return built(spark, sf, BM25()).search_phrase_near("the of the", 4, 20).results


@query(
    "phrase_multi_field",
    f"""WITH {FIELD_TOK}, ph AS (SELECT a.field, a.doc_id, count(*) AS tf FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.field = a.field AND b.pos = a.pos + 1 WHERE a.term = 'red' AND b.term = 'widget' GROUP BY ALL)
SELECT doc_id, 1::BIGINT AS unique_matches, sum(tf)::BIGINT AS total_matches, 0::DOUBLE AS score FROM ph GROUP BY doc_id""",
)
def phrase_multi_field(spark, sf):
    return parts(spark, sf).search_phrase("red widget").results


@query("phrase_single_token", f"WITH {TOK}, {terms_sql([(0, 0, 'oror')])} {top(FLAT, 0)}")
def phrase_single_token(spark, sf):
    return built(spark, sf, BM25()).search_phrase("Oror!").results


_PRE = "ph AS (SELECT doc_id, sum(tf) AS tf FROM post WHERE starts_with(term, 'oro') GROUP BY ALL)"


@query("prefix_search", f"WITH {TOK}, {_phrase_scored(_PRE)} {top(FLAT, 0)}")
def prefix_search(spark, sf):
    return built(spark, sf, BM25()).search_documents("oro*").results


@query(
    "prefix_must",
    f"""WITH {TOK}, {_phrase_scored(_PRE)}, d2 AS (SELECT count(*) AS df FROM post WHERE term = 'the'), t2 AS (SELECT doc_id, tf, {BM} AS s FROM post JOIN dl USING (doc_id) CROSS JOIN st CROSS JOIN d2 WHERE term = 'the'),
c AS (SELECT doc_id, 'must' AS occur, 1 AS u, tf AS t, s FROM sc UNION ALL SELECT doc_id, 'must', 1, tf, s FROM t2) {top(clauses_sql(_MUST2, "false"), 0)}""",
)
def prefix_must(spark, sf):
    return built(spark, sf, BM25()).search(Boolean((must(Prefix("oro")), must(Term("the"))))).results


@query(
    "bool_fallback_mixed",
    f"""WITH {TOK}, {_OF_THE}, x AS (SELECT doc_id, tf, {BM} AS s FROM ph JOIN dl USING (doc_id) CROSS JOIN st CROSS JOIN (SELECT count(*) AS df FROM ph)), {terms_sql([(0, 0, "erin"), (0, 1, "thin")])},
c AS (SELECT doc_id, 'should' AS occur, 1 AS u, tf AS t, s FROM x UNION ALL SELECT doc_id, 'should', count(DISTINCT token), sum(tf), sum(s) FROM sc GROUP BY doc_id) {top(clauses_sql("true", "false"), 50)}""",
)
def bool_fallback_mixed(spark, sf):
    return built(spark, sf, BM25()).search(Boolean((should(Phrase("of the")), should(Term("erin-thin")))), 50).results


@query("bool_must_not_only", "SELECT ''::VARCHAR AS doc_id, 0::BIGINT AS unique_matches, 0::BIGINT AS total_matches, 0::DOUBLE AS score WHERE false")
def bool_must_not_only(spark, sf):
    return built(spark, sf, BM25()).search(Boolean((must_not(Term("the")),))).results


# -- ranking ---------------------------------------------------------------------------------------------------

_THREE = [(0, 0, "erin"), (1, 0, "oror"), (2, 0, "the")]
_SHOULD = by_clause({0: "should", 1: "should", 2: "should"})


@query("bm25_topk", f"WITH {TOK}, {terms_sql(_THREE)}, {_SHOULD} {top(clauses_sql('true'), 10)}")
def bm25_topk(spark, sf):
    return built(spark, sf, BM25()).search_documents("erin oror the", 10).results


@query("tfidf_topk", f"WITH {TOK}, {terms_sql(_THREE, TI)}, {_SHOULD} {top(clauses_sql('true'), 10)}")
def tfidf_topk(spark, sf):
    return built(spark, sf, TFIDF()).search_documents("erin oror the", 10).results


@query("no_scorer_topk", f"WITH {TOK}, {terms_sql(_THREE, '0.0')}, {_SHOULD} {top(clauses_sql('true'), 10)}")
def no_scorer_topk(spark, sf):
    return built(spark, sf).search_documents("erin oror the", 10).results


@query("rank_profile_topk", f"WITH {FIELD_TOK}, {_field_sql('true', ['red', 'economy'], BM, "CASE field WHEN 'p_name' THEN 3 WHEN 'p_type' THEN 0 ELSE 1 END * 2")} {top(FLAT, 15)}")
def rank_profile_topk(spark, sf):
    profile = RankProfile(BM25(), {"p_name": 3.0, "p_type": 0.0}, {"term": 2.0})
    return parts(spark, sf, profile).search(Term("red economy"), 15).results


@query(
    "explain_doc",
    f"""WITH {FIELD_TOK}, q(term) AS (VALUES ('red'), ('economy'))
SELECT field, term, 'term' AS query_type, tf::BIGINT AS tf, df::BIGINT AS df, dl::BIGINT AS dl, n::BIGINT AS n_docs, round(al, 6) AS avg_len, round({BM}, 6) AS score
FROM q JOIN post USING (term) JOIN dfs USING (field, term) JOIN dl USING (field, doc_id) JOIN st USING (field) WHERE doc_id = '1'""",
)
def explain_doc(spark, sf):
    e = parts(spark, sf, BM25()).explain("red economy", "1")
    return e.select("field", "term", "query_type", "tf", "df", "dl", "n_docs", F.round("avg_len", 6).alias("avg_len"), F.round("score", 6).alias("score"))


@query("total_results", f"WITH {TOK} SELECT count(DISTINCT doc_id)::BIGINT AS total FROM post WHERE term IN ('erin', 'oror', 'the')")
def total_results(spark, sf):
    return built(spark, sf, BM25()).search_documents("erin oror the", 10).matches.agg(F.count("*").alias("total"))


_BATCH = rf"""qt AS (SELECT item_id AS query_id, lower(unnest(l)) AS term, generate_subscripts(l, 1) AS token FROM (SELECT item_id, regexp_extract_all(text, '{RUN}') AS l FROM benchmark)),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
b AS (SELECT query_id, doc_id, count(DISTINCT token) AS unique_matches, sum(tf) AS total_matches, round(sum({BM}), {DIGITS}) AS score FROM qt JOIN post USING (term) JOIN dfs USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unique_matches DESC, total_matches DESC, doc_id) AS rank FROM b QUALIFY rank <= 10)"""


def _hits(spark, sf):
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return built(spark, sf, BM25()).search_many(queries, 10)


@query("batch_topk", f"WITH {TOK}, {_BATCH} SELECT query_id, rank::INT AS rank, {OUT} FROM hits")
def batch_topk(spark, sf):
    return _hits(spark, sf).select("query_id", "rank", "doc_id", "unique_matches", "total_matches", "score")


# -- changes and storage ---------------------------------------------------------------------------------------


def _without(condition: str) -> str:
    return TOK.replace("FROM documents)", f"FROM documents WHERE {condition})").replace("FROM documents d LEFT", f"FROM (SELECT * FROM documents WHERE {condition}) d LEFT")


@query("delete_then_search", f"WITH {_without('doc_id % 3 <> 0')}, {terms_sql(_THREE)}, {_SHOULD} {top(clauses_sql('true'), 0)}")
def delete_then_search(spark, sf):
    e = documents(spark, sf, BM25())
    e.delete(table(spark, sf, "documents").where("doc_id % 3 = 0").select("doc_id"))
    return e.search_documents("erin oror the").results


_UPDATED = TOK.replace("regexp_extract_all(text,", "regexp_extract_all(CASE WHEN doc_id % 5 = 0 THEN 'oror oror the' ELSE text END,")


@query("update_then_search", f"WITH {_UPDATED}, {terms_sql(_THREE)}, {_SHOULD} {top(clauses_sql('true'), 0)}")
def update_then_search(spark, sf):
    e = documents(spark, sf, BM25())
    e.update(table(spark, sf, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit("oror oror the").alias("text")))
    return e.search_documents("erin oror the").results


@query("compaction_stats", "SELECT count(*)::BIGINT AS assigned, count(*) FILTER (WHERE doc_id % 4 = 0)::BIGINT AS tombstoned, round(count(*) FILTER (WHERE doc_id % 4 = 0) / count(*), 6) AS load FROM documents")
def compaction_stats(spark, sf):
    e = documents(spark, sf)
    e.delete(table(spark, sf, "documents").where("doc_id % 4 = 0").select("doc_id"))
    s = e.compaction_stats()
    return spark.createDataFrame([(s["assigned"], s["tombstoned"], round(s["load"], 6))], "assigned long, tombstoned long, load double")


def _folder(spark: SparkSession) -> str:
    """A new folder beneath the shared one that the session names; only a local session may use one of its own."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="findlark-")
    return f"{base}/{uuid.uuid4().hex}"


def _stored(spark, sf, save) -> DataFrame:
    from .sources import store

    e = documents(spark, sf, BM25())
    e.delete(table(spark, sf, "documents").where("doc_id % 3 = 0").select("doc_id"))
    path = _folder(spark)
    getattr(store, save)(e, path)
    return store.load(spark, path, scorer=BM25(), score_digits=DIGITS).search_documents("erin oror the").results


@query("snapshot_roundtrip", ORACLES["delete_then_search"])
def snapshot_roundtrip(spark, sf):
    return _stored(spark, sf, "save_snapshot")


@query("segment_roundtrip", ORACLES["delete_then_search"])
def segment_roundtrip(spark, sf):
    return _stored(spark, sf, "save_segment")


@query("stream_ingest", ORACLES["index_doc_stats"])
def stream_ingest(spark, sf):
    from .streaming.ingest import ingest, open_index

    base = _folder(spark)
    source = table(spark, sf, "documents").select("doc_id", F.lit("_default").alias("field"), F.col("text").alias("value"))
    source.write.parquet(f"{base}/in")
    ingest(spark.readStream.schema(source.schema).parquet(f"{base}/in"), f"{base}/index", f"{base}/state").awaitTermination()
    return open_index(spark, f"{base}/index").live_stats().select("field", "doc_id", "dl")


@query("highlight_fragments")
def highlight_fragments(spark, sf):
    a = an.ANALYZERS["default"]
    want = hl.wanted('oror "of the" erin* -atshsh', a)
    return table(spark, sf, "documents").select("doc_id", F.explode(hl.highlight_column(F.col("text"), want, a)).alias("f")).select("doc_id", F.col("f.text").alias("fragment"), F.col("f.matches").cast("long").alias("matches"))


# -- evaluation ------------------------------------------------------------------------------------------------

_QRELS = "qrels AS (SELECT item_id AS query_id, l.doc_id::VARCHAR AS doc_id, quality + 1 AS grade FROM benchmark JOIN labels l ON l.doc_id % 40 = item_id)"


def _qrels(spark, sf):
    b, l = table(spark, sf, "benchmark"), table(spark, sf, "labels")
    return l.withColumn("item_id", F.col("doc_id") % 40).join(b, "item_id").select(F.col("item_id").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), (F.col("quality") + 1).alias("grade"))


@query("eval_recall", f"WITH {TOK}, {_BATCH}, {_QRELS} SELECT q.query_id, round(count(h.doc_id) / count(*), 6) AS recall FROM qrels q LEFT JOIN hits h USING (query_id, doc_id) GROUP BY ALL")
def eval_recall(spark, sf):
    return ev.recall_at(_hits(spark, sf), _qrels(spark, sf), 10).select("query_id", F.round("recall", 6).alias("recall"))


@query("eval_mrr", f"WITH {TOK}, {_BATCH}, {_QRELS} SELECT q.query_id, round(coalesce(1 / min(h.rank), 0), 6) AS rr FROM qrels q LEFT JOIN hits h USING (query_id, doc_id) GROUP BY ALL")
def eval_mrr(spark, sf):
    return ev.reciprocal_rank(_hits(spark, sf), _qrels(spark, sf)).select("query_id", F.round("rr", 6).alias("rr"))


@query(
    "eval_ndcg",
    f"""WITH {TOK}, {_BATCH}, {_QRELS}, d AS (SELECT q.query_id, sum((2 ^ grade - 1) / log2(h.rank + 1)) AS dcg FROM qrels q JOIN hits h USING (query_id, doc_id) GROUP BY ALL),
i AS (SELECT query_id, sum((2 ^ grade - 1) / log2(r + 1)) AS ideal FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS r FROM qrels) WHERE r <= 10 GROUP BY ALL)
SELECT query_id, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM i LEFT JOIN d USING (query_id)""",
)
def eval_ndcg(spark, sf):
    return ev.ndcg_at(_hits(spark, sf), _qrels(spark, sf), 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("typed_workload_terms", f"WITH {TOK} SELECT term, count(*)::BIGINT AS df FROM post GROUP BY term HAVING count(*) BETWEEN greatest(2, (SELECT (0.001 * n)::INT FROM st)) AND greatest(2, (SELECT floor(0.1 * n)::INT FROM st)) ORDER BY md5(term), term LIMIT 200")
def typed_workload_terms(spark, sf):
    n = table(spark, sf, "documents").count()
    return ev.workload_terms(built(spark, sf).index.term_stats(), n, 200)


@query(
    "typed_workload_bigrams",
    f"WITH {TOK}, g AS (SELECT DISTINCT a.doc_id, a.term || ' ' || b.term AS phrase FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1) SELECT phrase, count(*)::BIGINT AS df FROM g GROUP BY phrase HAVING count(*) >= 3 ORDER BY md5(phrase), phrase LIMIT 200",
)
def typed_workload_bigrams(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", an.ANALYZERS["default"].column(F.col("text")).alias("tokens"))
    return ev.workload_bigrams(t, 200, 3)


@query("typed_workload_prefixes", f"WITH {TOK} SELECT substr(term, 1, 3) AS prefix, count(*)::BIGINT AS terms FROM (SELECT DISTINCT term FROM post WHERE length(term) > 3) GROUP BY prefix ORDER BY md5(prefix), prefix LIMIT 200")
def typed_workload_prefixes(spark, sf):
    return ev.workload_prefixes(built(spark, sf).index.term_stats(), 200)


@query(
    "exact_answers",
    f"""WITH {TOK} SELECT 'and' AS query_id, doc_id, 1 AS grade FROM post WHERE term IN ('the', 'erin') GROUP BY doc_id HAVING count(*) = 2
UNION ALL SELECT 'or', doc_id, 1 FROM post WHERE term IN ('oror', 'atshsh') GROUP BY doc_id""",
)
def exact_answers(spark, sf):
    q = spark.createDataFrame([("and", "and", ["the", "erin"]), ("or", "or", ["oror", "atshsh"])], "query_id string, kind string, terms array<string>")
    return ev.exact_answers(documents(spark, sf).index.postings, q)


_ASKED = {
    "erin": ("term", "SELECT count(*) AS n FROM post WHERE term = 'erin'"),
    "zzqx": ("term", "SELECT count(*) AS n FROM post WHERE term = 'zzqx'"),
    '"of the"': ("phrase", "SELECT count(DISTINCT a.doc_id) AS n FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'"),
    "oro*": ("prefix", "SELECT count(DISTINCT doc_id) AS n FROM post WHERE term LIKE 'oro%'"),
    "+erin +the": ("bool_and_fast", "SELECT count(*) AS n FROM (SELECT doc_id FROM post WHERE term IN ('erin', 'the') GROUP BY doc_id HAVING count(*) = 2)"),
    "+erin +zzqx": ("bool_and_fast", "SELECT 0 AS n"),
    '"oops': ("", "SELECT 0 AS n"),
}


@query("search_stats", f"WITH {TOK}, asked AS (" + " UNION ALL ".join(f"SELECT '{kind}' AS strategy, n FROM ({sql})" for kind, sql in _ASKED.values()) + ") SELECT strategy, count(*)::BIGINT AS n, sum(n)::BIGINT AS returned, (count(*) FILTER (WHERE n = 0 AND strategy <> ''))::BIGINT AS empty, (count(*) FILTER (WHERE strategy = ''))::BIGINT AS errors FROM asked GROUP BY strategy")
def search_stats(spark, sf):
    """What the statistics of an engine have after a few searches, one of which cannot be read."""
    e = built(spark, sf, BM25())
    e.stats = SearchStats()
    for text in _ASKED:
        try:
            e.search_documents(text).rows()
        except QueryError:
            pass
    rows = [(k, v["count"], v["returned"], v["zero"], v["errors"]) for k, v in e.stats.by.items()]
    return spark.createDataFrame(rows, "strategy string, n long, returned long, empty long, errors long")


def _membership(kind: str):
    @query(f"filter_membership_{kind}", f"WITH {TOK} SELECT count(DISTINCT term)::BIGINT AS keys, 0::BIGINT AS missed FROM post")
    def run(spark, sf):
        terms = documents(spark, sf).index.postings.select("term").distinct().persist()
        n = terms.count()
        f = bloom_of(terms, n) if kind == "bloom" else sharded(kind, terms, n)
        shipped = spark.sparkContext.broadcast(f)

        def check(batches):
            import pyarrow as pa

            for b in batches:
                missed = sum(not shipped.value.contains(k) for k in b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([missed])], names=["keys", "missed"])

        return terms.mapInArrow(check, "keys long, missed long").agg(F.sum("keys").alias("keys"), F.sum("missed").alias("missed"))

    return run


for _kind in ("bloom", "cuckoo", "ribbon"):
    _membership(_kind)


@query("synthetic_corpus")
def synthetic_corpus(spark, sf):
    from .sources.readers import synthetic

    docs, queries, qrels = synthetic(spark, docs=200, queries=20)
    return queries.join(qrels, "query_id").join(docs.select("doc_id", F.col("text").alias("document")), "doc_id").select("query_id", "doc_id", "text", F.size(F.split("document", " ")).cast("long").alias("words"))
