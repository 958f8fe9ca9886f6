"""The search engine: a mutable collection of documents with fields, and everything one can ask of it."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.analysis import Analyzer, analyzer
from .operators import highlight as hl
from .operators import index as ix
from .operators.index import Index
from .operators.scoring import Scorer, parts
from .operators.stats import Diagnostics, SearchStats
from .plans.ast import DEFAULT_FIELD, FieldClause, Phrase, Query, QueryError, Term, bind
from .plans.compiler import Compiler, clause_query, ranked, skip_reasons, strategy
from .plans.parser import parse


class ReadOnlyError(RuntimeError):
    """A sealed segment cannot be changed."""


@dataclass
class SearchResult:
    """results: the ranked top rows; matches: all of them, unordered (total() counts them)."""

    results: DataFrame
    matches: DataFrame
    diagnostics: Diagnostics
    limit: int = 0
    observe: Callable[[float, int, str], None] | None = None

    def total(self, compat: bool = False) -> int:
        """Matching documents before the limit. compat: what an engine that prunes an optional-terms query to the top k would say."""
        n = self.matches.count()
        return min(n, self.limit) if compat and self.limit > 0 and self.diagnostics.strategy == "bool_or_topk" else n

    def rows(self):
        """Runs the query; the engine's statistics get its time and how many documents it returned, or its error."""
        began = time.perf_counter()
        try:
            got = self.results.collect()
        except Exception as e:
            if self.observe:
                self.observe(time.perf_counter() - began, 0, str(e) or type(e).__name__)
            raise
        if self.observe:
            self.observe(time.perf_counter() - began, len(got), "")
        return got

    def diagnose(self) -> dict:
        """Runs the query once and tells what it did: strategy, why term-only paths did not apply, matching and returned documents, seconds."""
        from pyspark.sql import Observation

        seen = Observation()
        began = time.perf_counter()
        n = self.matches.observe(seen, F.count(F.lit(1)).alias("matched"), F.max("score").alias("best")).groupBy().agg(F.count(F.lit(1))).first()[0]
        d = self.diagnostics
        returned = min(n, self.limit) if self.limit > 0 else n
        return {"strategy": d.strategy, "skip_reasons": list(d.skip_reasons), "matched": seen.get["matched"], "best": seen.get["best"], "returned": returned, "plan_seconds": d.plan_seconds, "run_seconds": time.perf_counter() - began}


@dataclass
class Engine:
    """scorer: None ranks by match counts. key_column and keys: a key generator as a column function and on a token. multi_field: False rejects any field but the unnamed one."""

    spark: SparkSession
    analyzer: Analyzer | str | None = None
    scorer: Scorer | None = None
    multi_field: bool = True
    field_analyzers: dict[str, Analyzer] = field(default_factory=dict)
    keys: Callable[[str], list[str]] | None = None
    key_column: Callable | None = None
    filter: object | None = None
    compaction_limit: float = 0.0
    on_compaction: Callable[["Engine"], None] | None = None
    stats: SearchStats | None = None
    index: Index | None = None
    version: int = 0
    sealed: bool = False
    score_digits: int | None = None

    def __post_init__(self):
        self.analyzer = analyzer(self.analyzer)
        if self.index is None:
            make = lambda ddl: self.spark.createDataFrame([], ddl)
            self.index = Index(make(ix.POSTINGS), make(ix.DOC_STATS))
        self.indexed = self.version  # the newest version that rows of the index may have

    # -- collection -----------------------------------------------------------------------------------------

    def _rows(self, docs: DataFrame) -> DataFrame:
        if "field" not in docs.columns:
            default = "text" if "text" in docs.columns else "value"
            docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(DEFAULT_FIELD).alias("field"), F.col(default).alias("value"))
        return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "field", "value")

    def index_documents(self, docs: DataFrame, check: bool = True) -> "Engine":
        """Adds documents (doc_id, text) or (doc_id, field, value). check: looks for empty ids and, with one field, other names before anything is added."""
        if self.sealed:
            raise ReadOnlyError("the index is sealed")
        rows = self._rows(docs)
        if check:
            bad = rows.agg(F.count_if((F.coalesce("doc_id", F.lit("")) == "")).alias("ids"), F.count_if(F.col("field") != DEFAULT_FIELD).alias("named")).first()
            if bad["ids"]:
                raise QueryError("a document has no id")
            if not self.multi_field and bad["named"]:
                raise QueryError("this engine has one unnamed field")
        rows = rows.withColumn("ver", F.lit(self.version).cast("long"))
        tokens = ix.analyzed(rows, (self.analyzer, self.field_analyzers) if self.field_analyzers else self.analyzer)
        postings, doc_stats = ix.build(tokens, self.key_column)
        asked = ix.asked(tokens, self.key_column)
        old = self.index
        if self.version == 0 and old.postings.isEmpty() and old.doc_stats.isEmpty():
            new = Index(postings, doc_stats, old.tombstones, old.positional, asked=asked)
        elif self.version > self.indexed:  # no row has this version yet
            new = Index(old.postings.unionByName(postings), old.doc_stats.unionByName(doc_stats), old.tombstones, old.positional, asked=(old.postings if old.asked is None else old.asked).unionByName(asked))
        else:  # indexing an id again adds to it; its length is replaced
            both = old.postings.unionByName(postings)
            both = both.groupBy("field", "term", "doc_id", "ver").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.max("dl").alias("dl"))
            stats = old.doc_stats.withColumn("o", F.lit(0)).unionByName(doc_stats.withColumn("o", F.lit(1))).groupBy("field", "doc_id", "ver").agg(F.max_by("dl", "o").alias("dl"))
            new = Index(both.select(postings.columns), stats.select(doc_stats.columns), old.tombstones, old.positional)
        self.index, self.indexed = new, self.version
        if self.filter is not None:
            self._fill_filter(postings)
        return self

    def _fill_filter(self, postings: DataFrame) -> None:
        for r in postings.select("term").distinct().toLocalIterator():
            if not self.filter.add(r["term"]):
                raise RuntimeError("the membership filter is full")

    def build_filter(self) -> None:
        if hasattr(self.filter, "build"):
            self.filter.build()

    def delete(self, ids: DataFrame | list[str]) -> int:
        """Deletes documents; how many there were."""
        if self.sealed:
            raise ReadOnlyError("the index is sealed")
        n = self._bury(ids)
        self._compaction_check()
        return n

    def _bury(self, ids: DataFrame | list[str]) -> int:
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(str(i),) for i in ids], "doc_id string")
        ids = ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        gone = self.index.live_stats().select("doc_id", "ver").distinct().join(ids, "doc_id", "left_semi").select("doc_id", "ver")
        old = self.index.tombstones
        self.index = Index(self.index.postings, self.index.doc_stats, gone if old is None else old.unionByName(gone), self.index.positional, asked=self.index.asked)
        return gone.count()

    def update(self, docs: DataFrame) -> None:
        """Deletes and indexes again: the old version stays buried until compaction."""
        if self.sealed:
            raise ReadOnlyError("the index is sealed")
        rows = self._rows(docs)
        self._bury(rows.select("doc_id"))
        self.version += 1
        self.index_documents(rows)
        self._compaction_check()

    def compaction_stats(self) -> dict:
        assigned = self.index.doc_stats.select("doc_id", "ver").distinct().count()
        dead = 0 if self.index.tombstones is None else self.index.tombstones.distinct().count()
        return {"assigned": assigned, "tombstoned": dead, "load": dead / assigned if assigned else 0.0}

    def needs_compaction(self) -> bool:
        if not 0 < self.compaction_limit <= 1:
            return False
        return self.compaction_stats()["load"] >= self.compaction_limit

    def _compaction_check(self) -> None:
        if self.on_compaction and self.needs_compaction():
            self.on_compaction(self)

    def compact(self) -> "Engine":
        """Drops what deleted versions left behind."""
        i = self.index
        self.index = Index(i.live_postings(), i.live_stats(), None, i.positional)
        return self

    def persist(self) -> "Engine":
        """Keeps the index in memory and on disk between queries."""
        i = self.index
        self.index = Index(i.postings.persist(), i.doc_stats.persist(), None if i.tombstones is None else i.tombstones.persist(), i.positional)
        return self

    def fields(self) -> list[str]:
        return sorted(r["field"] for r in self.index.doc_stats.select("field").distinct().collect())

    # -- search ---------------------------------------------------------------------------------------------

    def compiler(self, scope: list[str] | None = None) -> Compiler:
        return Compiler(self.spark, self.index, self.analyzer, self.scorer, scope, self.keys, self.filter.contains if self.filter is not None else None)

    def search(self, q: Query | None, k: int = 0, scope: list[str] | None = None) -> SearchResult:
        """Documents of a query object, best first; k <= 0 gives all."""
        began = time.perf_counter()
        name = strategy(q, k > 0, self.scorer is not None)
        matches = self.compiler(scope).node(q)
        out = ranked(matches, k, self.scorer is not None, self.score_digits)
        seconds = time.perf_counter() - began
        reasons = tuple(skip_reasons(q))
        observe = None
        if self.stats is not None:
            observe = lambda s, returned, error: self.stats.observe(repr(q), name, seconds + s, returned, error, reasons)
        return SearchResult(out, matches, Diagnostics(name, reasons, seconds), k, observe)

    def _parse(self, text: str) -> Query | None:
        """A query string; what cannot be read is an error of the statistics as well."""
        try:
            return parse(text)
        except Exception as e:
            if self.stats is not None:
                self.stats.observe(text, "", 0.0, 0, str(e) or type(e).__name__)
            raise

    def _default(self, q: Query, field_: str | None = None) -> Query:
        return bind(q, field_ if field_ is not None else "" if self.multi_field else DEFAULT_FIELD)

    def search_documents(self, text: str, k: int = 0) -> SearchResult:
        """A query string."""
        return self.search(self._default(self._parse(text)), k)

    def search_plain_text(self, text: str, k: int = 0) -> SearchResult:
        """A text without query syntax: its tokens are alternatives."""
        return self.search(self._default(Term(text)), k)

    def search_field(self, name: str, text: str, k: int = 0) -> SearchResult:
        return self.search(self._parse(text), k, [name])

    def search_fields(self, names: list[str], text: str, k: int = 0) -> SearchResult:
        return self.search(self._parse(text), k, names)

    def search_phrase(self, text: str, k: int = 0, fields: list[str] | None = None) -> SearchResult:
        return self.search(Phrase(text), k, fields)

    def search_phrase_near(self, text: str, distance: int, k: int = 0, fields: list[str] | None = None) -> SearchResult:
        return self.search(Phrase(text, near=distance), k, fields)

    def search_field_clauses(self, clauses: list[FieldClause], k: int = 0) -> SearchResult:
        return self.search(clause_query(clauses, parse) if clauses else None, k)

    def search_many(self, queries: DataFrame, k: int) -> DataFrame:
        """The first k documents of every row of queries(query_id, text), as plain text.

        One job for the whole batch: tokens of the queries join the postings,
        scores add up by (query, document), and a group limit cuts each partition
        to k rows a query before the ranking shuffle.
        """
        from pyspark.sql import Window

        tokens = queries.select("query_id", F.posexplode(self.analyzer.column(F.coalesce(F.col("text"), F.lit("")))).alias("token", "term"))
        vocabulary = tokens.select("term").distinct()
        live = self.index.live_postings().select("field", "term", "doc_id", "tf", "dl").join(vocabulary, "term", "left_semi")
        if self.scorer is not None:
            stored = self.index.terms
            df = live.groupBy("field", "term").agg(F.count("*").alias("df")) if stored is None else stored.select("field", "term", "df")
            live = live.join(df, ["field", "term"]).join(F.broadcast(self.index.field_stats()), "field")  # a row a field
            live = live.withColumn("query_type", F.lit("term"))
            live = live.select("term", "doc_id", "tf", parts(self.scorer)["score"].alias("score"))
        else:
            live = live.select("term", "doc_id", "tf", F.lit(0.0).alias("score"))
        if not self.index.one_field:  # a document once a term, so that each token of a query meets it once
            live = live.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.sum("score").alias("score"))
        rows = tokens.join(live, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("unique_matches"), F.sum("tf").alias("total_matches"), F.sum("score").alias("score"))
        if self.score_digits is not None:
            rows = rows.withColumn("score", F.round("score", self.score_digits))
        by = ([F.desc("score")] if self.scorer is not None else []) + [F.desc("unique_matches"), F.desc("total_matches"), F.asc("doc_id")]
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= k)

    def explain(self, query: str | Query, doc_id: str) -> DataFrame:
        """Contributions to one document's score: by field, query type, term and score. Empty if it does not match or there is no scorer."""
        if not doc_id:
            raise QueryError("no document id")
        q = self._default(parse(query)) if isinstance(query, str) else query
        c = self.compiler()
        hit = c.node(q).where(F.col("doc_id") == doc_id).select("doc_id")
        names = ["field", "term", "query_type", "tf", "df", "dl", "n_docs", "avg_len", "base", "field_weight", "type_weight", "score"]
        out = None
        for rows in c.contributions:
            part = rows.where(F.col("doc_id") == doc_id).select("doc_id", *names)
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], "field string, term string, query_type string, tf long, df long, dl long, n_docs long, avg_len double, base double, field_weight double, type_weight double, score double")
        return out.join(F.broadcast(hit), "doc_id", "left_semi").select(*names).orderBy("field", "query_type", "term", F.desc("score"))

    def highlight(self, text: str, query: str, style: hl.Style = hl.Style(), field_: str | None = None) -> list[tuple[str, int]]:
        return hl.fragments(text, hl.wanted(query, self.analyzer, field_), self.analyzer, style)

    def highlight_plain_text(self, text: str, query: str, style: hl.Style = hl.Style()) -> list[tuple[str, int]]:
        return hl.fragments(text, hl.plain(query, self.analyzer), self.analyzer, style)
