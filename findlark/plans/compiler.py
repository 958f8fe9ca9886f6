"""Query objects to DataFrames.

Every node becomes ``(doc_id, unique_matches, total_matches, score)``. Leaves
select their postings by pushed-down conditions on field and term; what they are
joined with (the query's own terms, their document frequencies, the statistics
of the fields) has a row for each term or field of the query, so those joins are
broadcasts whatever the index's size. Boolean queries are one aggregate over the
tagged union of their clauses, not a chain of joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer
from ..operators.index import Index
from ..operators.scoring import Scorer, parts
from .ast import MUST, NOT, SHOULD, Boolean, Clause, Phrase, Prefix, Query, QueryError, Term

RESULT = "doc_id string, unique_matches long, total_matches long, score double"
CONTRIBUTION = "doc_id string, clause int, token int, field string, term string, query_type string, tf long, df long, dl long, n_docs long, avg_len double, base double, field_weight double, type_weight double, score double"


def strategy(q: Query | None, limited: bool = False, scored: bool = True) -> str:
    """Name of the plan kind of a query, for diagnostics."""
    if q is None:
        return "empty"
    if not isinstance(q, Boolean):
        return {Term: "term", Phrase: "phrase", Prefix: "prefix"}[type(q)]
    musts, shoulds, _ = split(q)
    if musts and all(isinstance(x, Term) for x in musts):
        return "bool_and_fast"
    if not musts and shoulds and all(isinstance(x, Term) for x in shoulds):
        return "bool_or_topk" if limited and scored else "bool_or_fast"
    return "bool_fallback"


def skip_reasons(q: Query | None) -> list[str]:
    """Why the term-only paths do not apply."""
    if not isinstance(q, Boolean):
        return []
    musts, shoulds, _ = split(q)
    out = []
    if not musts:
        out.append("and_fast_no_must_terms")
    elif not all(isinstance(x, Term) for x in musts):
        out.append("and_fast_non_term_clause")
    if musts:
        out.append("or_fast_has_must_clause")
    elif not shoulds:
        out.append("or_fast_no_should_terms")
    elif not all(isinstance(x, Term) for x in shoulds):
        out.append("or_fast_non_term_clause")
    return out


def split(q: Boolean) -> tuple[list[Query], list[Query], list[Query]]:
    by = {MUST: [], SHOULD: [], NOT: []}
    for c in q.clauses:
        if c.query is not None:
            by[c.occur].append(c.query)
    return by[MUST], by[SHOULD], by[NOT]


@dataclass
class Compiler:
    """scope: the only fields a query may see (None: all). keys: token -> index keys."""

    spark: SparkSession
    index: Index
    analyzer: Analyzer
    scorer: Scorer | None = None
    scope: list[str] | None = None
    keys: Callable[[str], list[str]] | None = None
    member: Callable[[str], bool] | None = None
    contributions: list[DataFrame] = field(default_factory=list)

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], RESULT)

    def _fields(self, own: str) -> Column | None:
        """Condition on field, or None if nothing can match."""
        scope = None if self.scope is None else [f for f in dict.fromkeys(self.scope) if f]
        if own:
            return None if scope is not None and own not in scope else F.col("field") == own
        if scope is None:
            return F.lit(True)
        return F.col("field").isin(scope) if scope else None

    def _keys(self, token: str) -> list[str]:
        own = list(dict.fromkeys(self.keys(token))) if self.keys else [token]
        return [k for k in own if self.member is None or self.member(k)]

    def _scored(self, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """rows(doc_id, clause, token, field, term, query_type, tf, dl) with df, statistics and score. keys: the terms of rows, if stored statistics may serve."""
        if self.scorer is None:
            return rows.withColumn("score", F.lit(0.0))
        if keys is not None and self.index.terms is not None:
            df, by = self.index.terms.where(F.col("term").isin(keys)).select("field", F.col("term").alias("key"), "df"), ["field", "key"]
        else:
            by = ["field", "clause", "token", "key"]
            df = rows.groupBy(*by).agg(F.count("*").alias("df"))
        # Either way df has a row for each term of the query and field.
        rows = rows.join(F.broadcast(df), by).join(F.broadcast(self.index.field_stats()), "field")
        p = parts(self.scorer)
        return rows.select("*", *[c.alias(n) for n, c in p.items()])

    # -- leaves: one row for each matching expansion -------------------------------------------------------

    def term_rows(self, terms: list[Term]) -> DataFrame | None:
        """Expansions of several term clauses from one selection of postings."""
        wanted, conditions = [], []
        for clause, t in enumerate(terms):
            where = self._fields(t.field)
            if where is None:
                continue
            own = [(clause, i, tok, key) for i, tok in enumerate(self.analyzer.tokens(t.text)) for key in self._keys(tok)]
            if own:
                wanted += [(*w, t.field) for w in own]
                conditions.append(where & F.col("term").isin(sorted({w[3] for w in own})))
        if not wanted:
            return None
        where = conditions[0]
        for c in conditions[1:]:
            where = where | c
        q = self.spark.createDataFrame(wanted, "clause int, token int, label string, key string, own string")
        live = self.index.live_postings(where).select("field", F.col("term").alias("key"), "doc_id", "tf", "dl")
        rows = live.join(F.broadcast(q), "key").where("own = '' or own = field").select("doc_id", "clause", "token", "field", F.col("label").alias("term"), "key", F.lit("term").alias("query_type"), "tf", "dl")
        return self._scored(rows, sorted({w[3] for w in wanted}))

    def phrase_rows(self, q: Phrase, clause: int = 0) -> DataFrame | None:
        tokens = self.analyzer.tokens(q.text)
        where = self._fields(q.field)
        keys = [self._keys(t) for t in tokens]
        if where is None or not tokens or not all(keys):
            return None
        flat = sorted({k for ks in keys for k in ks})
        live = self.index.live_postings(where & F.col("term").isin(flat))
        if self.index.positional is not None:
            live = live.where(F.col("field").isin(sorted(self.index.positional)))
        # The positions of each token, side by side: a group has a row for each of the phrase's keys at most.
        pos = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("term").isin(ks), F.col("positions")))))).alias(f"p{i}") for i, ks in enumerate(keys)]
        rows = live.groupBy("field", "doc_id", "ver").agg(*pos, F.max("dl").alias("dl"))
        n = len(tokens)
        if q.near is None:
            start = F.col("p0")
            for i in range(1, n):
                start = F.array_intersect(start, _back(F.col(f"p{i}"), i))
            count = F.size(start)
        else:
            gap = q.near + 1

            def follow(at: Column, i: int) -> Column:
                nxt = F.array_min(F.filter(F.col(f"p{i}"), lambda y: y > at))
                return F.when(nxt <= at + gap, nxt)

            def chain(s: Column) -> Column:
                for i in range(1, n):
                    s = follow(s, i)
                return s.isNotNull()

            count = F.size(F.filter(F.col("p0"), chain))
        label = " ".join(tokens)
        rows = rows.select("doc_id", F.lit(clause).alias("clause"), F.lit(0).alias("token"), "field", F.lit(label).alias("term"), F.lit(label).alias("key"), F.lit("phrase").alias("query_type"), count.cast("long").alias("tf"), "dl").where("tf > 0")
        return self._scored(rows)

    def prefix_rows(self, q: Prefix, clause: int = 0) -> DataFrame | None:
        where = self._fields(q.field)
        if where is None or not q.text:
            return None
        live = self.index.live_postings(where & F.col("term").startswith(q.text))
        rows = live.groupBy("field", "doc_id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
        label = q.text + "*"
        return self._scored(rows.select("doc_id", F.lit(clause).alias("clause"), F.lit(0).alias("token"), "field", F.lit(label).alias("term"), F.lit(label).alias("key"), F.lit("prefix").alias("query_type"), "tf", "dl"))

    # -- nodes ----------------------------------------------------------------------------------------------

    def _fold(self, rows: DataFrame | None, keep: bool) -> DataFrame:
        if rows is None:
            return self.empty()
        if keep and self.scorer is not None:
            self.contributions.append(rows)
        return rows.groupBy("doc_id").agg(F.count_distinct("token").alias("unique_matches"), F.sum("tf").alias("total_matches"), F.sum("score").alias("score"))

    def node(self, q: Query | None, keep: bool = True) -> DataFrame:
        """Result rows of a query. keep: its expansions belong in an explanation."""
        if q is None:
            return self.empty()
        if isinstance(q, Phrase) and len(self.analyzer.tokens(q.text)) == 1:
            q = Term(q.text, q.field)
        if isinstance(q, Term):
            return self._fold(self.term_rows([q]), keep)
        if isinstance(q, Phrase):
            return self._fold(self.phrase_rows(q), keep)
        if isinstance(q, Prefix):
            return self._fold(self.prefix_rows(q), keep)
        if isinstance(q, Boolean):
            return self.boolean(q, keep)
        raise QueryError(f"unknown query {q!r}")

    def _tagged(self, q: Query, clause: int, occur: str, once: bool, keep: bool) -> DataFrame:
        r = self.node(q, keep and occur != NOT)
        unique = F.lit(1).cast("long") if once else F.col("unique_matches")
        return r.select("doc_id", F.lit(clause).alias("clause"), F.lit(occur).alias("occur"), unique.alias("u"), F.col("total_matches").alias("t"), F.col("score").alias("s"))

    def boolean(self, q: Boolean, keep: bool = True) -> DataFrame:
        """Clauses of terms alone count once in an all-term AND or OR; elsewhere a term clause counts each of its tokens."""
        musts, shoulds, nots = split(q)
        if not musts and not shoulds:
            return self.empty()
        and_terms = bool(musts) and all(isinstance(x, Term) for x in musts)
        or_terms = not musts and all(isinstance(x, Term) for x in shoulds)
        order = [(x, MUST) for x in musts] + [(x, SHOULD) for x in shoulds] + [(x, NOT) for x in nots]
        if all(isinstance(x, Term) for x, _ in order):
            rows = self._term_clauses(order, and_terms, or_terms, keep)
        else:
            rows = None
            for i, (x, occur) in enumerate(order):
                once = isinstance(x, Term) and ((and_terms and occur == MUST) or (or_terms and occur == SHOULD))
                part = self._tagged(x, i, occur, once, keep)
                rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.empty()
        counted = F.col("occur") != NOT
        out = rows.groupBy("doc_id").agg(
            F.count_if(F.col("occur") == MUST).alias("musts"),
            F.count_if(F.col("occur") == NOT).alias("nots"),
            F.sum(F.when(counted, F.col("u"))).alias("unique_matches"),
            F.sum(F.when(counted, F.col("t"))).alias("total_matches"),
            F.sum(F.when(counted, F.col("s"))).alias("score"),
        )
        return out.where((F.col("musts") == len(musts)) & (F.col("nots") == 0)).where("unique_matches is not null").select("doc_id", "unique_matches", "total_matches", "score")

    def _term_clauses(self, order: list[tuple[Term, str]], and_terms: bool, or_terms: bool, keep: bool) -> DataFrame | None:
        rows = self.term_rows([x for x, _ in order])
        if rows is None:
            return None
        by = {i: occur for i, (_, occur) in enumerate(order)}
        occur = F.element_at(F.create_map(*[F.lit(v) for kv in by.items() for v in kv]), F.col("clause"))
        rows = rows.withColumn("occur", occur)
        if keep and self.scorer is not None:
            self.contributions.append(rows.where(F.col("occur") != NOT).drop("occur"))
        once = (F.lit(and_terms) & (F.col("occur") == MUST)) | (F.lit(or_terms) & (F.col("occur") == SHOULD))
        per = rows.groupBy("doc_id", "clause", "occur").agg(F.count_distinct("token").alias("u"), F.sum("tf").alias("t"), F.sum("score").alias("s"))
        return per.withColumn("u", F.when(once, F.lit(1).cast("long")).otherwise(F.col("u")))


def _back(positions: Column, n: int) -> Column:
    return F.transform(positions, lambda x: x - n)


def ranked(rows: DataFrame, k: int, scored: bool, digits: int | None = None) -> DataFrame:
    """The first k rows by score, unique and total matches and doc_id (k <= 0: all, in order)."""
    if digits is not None:
        rows = rows.withColumn("score", F.round("score", digits))
    by = ([F.desc("score")] if scored else []) + [F.desc("unique_matches"), F.desc("total_matches"), F.asc("doc_id")]
    rows = rows.orderBy(*by)
    return rows.limit(k) if k > 0 else rows


def clause_query(clauses: list, parse) -> Boolean:
    """A Boolean of (occur, field, query string) clauses."""
    from .ast import bind

    out = []
    for c in clauses:
        if not c.text.strip():
            raise QueryError("a clause is blank")
        out.append(Clause(c.occur, bind(parse(c.text), c.field)))
    return Boolean(tuple(out))
