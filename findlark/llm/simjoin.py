"""Operator 6: n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of hashes of its word 5-grams. Two link when 100 times
the intersection is at least 80 times the union. The steps:

1. ``sets``: every document's set size and fingerprint; equal sets form one
   class, which stands for all its copies from here on.
2. Prefixes. Under one order of all shingles, two linked sets share l shingles
   among their first n - ceil(0.8 n) + l. A count of prefix shingles finds the
   frequent ones (shared passages, licence lines); the order puts them last, by
   count, so a prefix holds them only where a document is little else. Such a
   document's prefix is lengthened by its estimated candidate cost, and a pair
   needs as many more common prefix shingles before it is verified.
3. Candidates: shingles with equal lists of classes become one weighted list; an
   equi-join on the list with a size filter, then a sum for each pair, which
   must reach what the overlap needs within the prefixes. No group is collected;
   lists are ordinary join keys that adaptive execution can split.
4. Verification: candidate pairs are cut into cells of at most 2 x ``block``
   classes around the smallest neighbour, the sets of just the classes needed
   (a Bloom filter of bounded size keeps the rest at home) go once to each
   cell, and a cell returns link weights and a spanning forest, never pairs.
5. Components by alternating large-star and small-star rounds.

The order only decides cost: whatever the counts say, all links are found.

Defined results: documents with fewer than 5 words have their whole word
sequence as one shingle; null, empty and word-free texts have none and link
with nothing; repeated rows (even with one doc_id) are documents of their own.
Fingerprints and shingles are 64-bit hashes; a false merge needs a collision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

K, PERCENT = 5, 80
#: Prefix shingles in more classes than this count as frequent; so many of them at most, the most frequent, are told to the executors.
FREQUENT, FREQUENT_MOST = 8, 1 << 20
BLOOM_MOST = 1 << 27  # bits


def least_overlap(n: np.ndarray) -> np.ndarray:
    """ceil(0.8 n): what a set of n shingles shares with any linked set, at least."""
    return -(-n * PERCENT // 100)


class Sets:
    """Shingle sets of a chunk of texts: ascending hashes x of each text (row), n of each and where they start."""

    def __init__(self, texts: pa.Array):
        w = common.Words(texts)
        h = common.word_hashes(pc.ascii_lower(w.vocab))
        x, at = w.windows(h, K)
        row = w.row[at]
        few = np.flatnonzero((w.count > 0) & (w.count < K))
        if len(few):
            own = np.zeros(len(few), np.uint64)
            for j in range(K - 1):
                ok = w.count[few] > j
                own[ok] += h[w.ids[w.start[few[ok]] + j]] * common.MULT[40 + j]
            x, row = np.concatenate([x, common.mix(own)]), np.concatenate([row, few])
            o = np.argsort(row, kind="stable")
            x, row = x[o], row[o]
        n = np.bincount(row, minlength=w.n)
        end = np.cumsum(n)
        for a, b in zip((end - n).tolist(), end.tolist()):
            if b - a > 1:
                x[a:b].sort()
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
        self.x, self.row = x[new], row[new]
        self.n = np.bincount(self.row, minlength=w.n).astype(np.int64)
        self.start = np.cumsum(self.n) - self.n
        s = np.zeros(w.n, np.uint64)
        np.add.at(s, self.row, common.mix(self.x + np.uint64(1)))
        self.fp = common.mix(s + self.n.astype(np.uint64)).view(np.int64)


def sets(docs: DataFrame) -> DataFrame:
    """docs without text, with n and fp."""
    names = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in common.chunks(batches):
            s = Sets(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s.n, pa.int32()), pa.array(s.fp)], names=[*names, "n", "fp"])

    return docs.mapInArrow(run, schema)


@dataclass
class Frequent:
    """Frequent shingles, ascending, with their counts."""

    x: np.ndarray
    count: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        if not len(self.x):
            return np.zeros(len(x), np.int64)
        if not hasattr(self, "near"):
            self.near = np.zeros(1 << 22, bool)
            self.near[self.x >> np.uint64(42)] = True
        out = np.zeros(len(x), np.int64)
        some = np.flatnonzero(self.near[x >> np.uint64(42)])
        at = np.minimum(np.searchsorted(self.x, x[some]), len(self.x) - 1)
        out[some] = np.where(self.x[at] == x[some], self.count[at], 0)
        return out


def prefixes(docs: DataFrame, frequent: Frequent | None) -> DataFrame:
    """(x, fp, n, l) of every prefix shingle, once for a class in a partition; without ``frequent`` plain prefixes in hash order, x alone."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(frequent)

    def run(batches):
        seen: set[int] = set()
        known = shipped.value
        for b in common.chunks(batches):
            s = Sets(b.column("text"))
            own = []
            for i, f in enumerate(s.fp.tolist()):
                if s.n[i] and f not in seen:
                    seen.add(f)
                    own.append(i)
            own = np.array(own, dtype=np.int64)
            n, need = s.n[own], least_overlap(s.n[own])
            if known is None:
                p = n - need + 1
                at = np.repeat(s.start[own] - (np.cumsum(p) - p), p) + np.arange(p.sum())
                yield pa.RecordBatch.from_arrays([pa.array(s.x[at].view(np.int64))], names=["x"])
                continue
            c = known.of(s.x)
            x = s.x.copy()
            heavy = common.distinct(s.row[c > 0])
            for i in heavy.tolist():
                a, e = s.start[i], s.start[i] + s.n[i]
                o = np.lexsort((s.x[a:e], c[a:e]))
                x[a:e], c[a:e] = s.x[a:e][o], c[a:e][o]
            # Estimated cost: other classes that frequent shingles of the plain prefix lead to.
            total = np.concatenate([[0], np.cumsum(c)])
            cost = total[s.start[own] + n - need + 1] - total[s.start[own]]
            l = 1 + np.minimum(3, np.floor(np.log2(1 + cost / 96)).astype(np.int64))
            l = np.maximum(1, np.minimum(l, need))
            p = n - need + l
            at = np.repeat(s.start[own] - (np.cumsum(p) - p), p) + np.arange(p.sum())
            yield pa.RecordBatch.from_arrays([pa.array(x[at].view(np.int64)), pa.array(np.repeat(s.fp[own], p)), pa.array(np.repeat(n, p), pa.int32()), pa.array(np.repeat(l, p), pa.int8())], names=["x", "fp", "n", "l"])

    return docs.select("text").mapInArrow(run, "x long" if frequent is None else "x long, fp long, n int, l byte")


def frequent(docs: DataFrame) -> Frequent:
    rows = prefixes(docs, None).groupBy("x").agg(F.count("*").alias("c")).where(F.col("c") > FREQUENT).orderBy(F.desc("c"), "x").limit(FREQUENT_MOST).toArrow()
    x, c = np.asarray(rows.column("x")).view(np.uint64), np.asarray(rows.column("c"))
    o = np.argsort(x)
    return Frequent(x[o].copy(), c[o].copy())


def candidates(docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of class fingerprints, a < b, that may link."""
    # The conditions hold anyway; without them the optimizer infers them for one of the two uses below, and what should
    # be one exchange becomes two.
    index = prefixes(docs, frequent(docs)).where("x is not null and fp is not null").repartition("x")
    # Shingles that stand in the same classes (those of a shared passage, or of a family of copies) are one list with a
    # weight: it meets itself once, not once a shingle. Equal list fingerprints by chance could only add candidates.
    # Both uses read all columns, so they share one exchange; sums of 30 bits cannot overflow.
    part = lambda k: F.sum(F.shiftrightunsigned(F.xxhash64("fp", "n", "l", F.lit(k)), 34))
    lists = index.groupBy("x").agg(F.count("*").alias("m"), part(0).alias("h"), part(1).alias("h2")).where("m > 1")
    rows = index.join(lists, "x").dropDuplicates(["x", "fp"]).groupBy("h", "h2", "m", "fp").agg(F.count("*").alias("w"), F.min("n").alias("n"), F.min("l").alias("l"))
    a = rows.select("h", "h2", "m", "w", F.col("fp").alias("a"), F.col("n").alias("na"), F.col("l").alias("la"))
    b = rows.select("h", "h2", "m", F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("l").alias("lb"))
    pairs = a.join(b, ["h", "h2", "m"]).where("a < b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    # Of the prefix that ends first in the order, every common shingle is counted; what can follow is at most the rest of that set.
    rest = F.greatest(*(F.ceil(F.col(f"n{k}") * PERCENT / F.lit(100)) - F.col(f"l{k}") for k in "ab"))
    need = F.greatest(F.least("la", "lb"), F.ceil((F.col("na") + F.col("nb")) * PERCENT / F.lit(100 + PERCENT)) - rest).cast("int")
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("c"), F.min(need).alias("need")).where("c >= need").select("a", "b")


def _bloom_slots(fp: np.ndarray, bits: int) -> list[np.ndarray]:
    x = fp.view(np.uint64)
    return [common.mix(x * common.MULT[50 + j] + np.uint64(j)) % np.uint64(bits) for j in range(3)]


def bloom(spark: SparkSession, fps: DataFrame, n: int) -> np.ndarray:
    """Bits (bool) of a Bloom filter over fps(fp); at most BLOOM_MOST, whatever n is."""
    bits = 1 << min(BLOOM_MOST.bit_length() - 1, max(13, (16 * n).bit_length()))

    def run(batches):
        for b in batches:
            s = common.distinct(np.concatenate(_bloom_slots(np.asarray(b.column(0)), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((s >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (s & np.uint64(63))).view(np.int64))], names=["w", "m"])

    t = fps.select("fp").mapInArrow(run, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[np.asarray(t.column("w"))] = np.asarray(t.column("m")).view(np.uint64)
    return words


def wanted_sets(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """(fp, xs) of the classes that pass the Bloom filter, once in a partition."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        seen: set[int] = set()
        w = shipped.value
        for b in common.chunks(batches):
            s = Sets(b.column("text"))
            ok = s.n > 0
            for slot in _bloom_slots(s.fp, 64 * len(w)):
                ok &= (w[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            own = []
            for i in np.flatnonzero(ok).tolist():
                f = int(s.fp[i])
                if f not in seen:
                    seen.add(f)
                    own.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(s.fp[own]), pa.array([s.x[s.start[i] : s.start[i] + s.n[i]].tobytes() for i in own], pa.binary())], names=["fp", "xs"])

    return docs.select("text").mapInArrow(run, "fp long, xs binary")


def _verify(left: pa.Table, right: pa.Table) -> pa.Table:
    """A cell: left has its sets (fp, xs, size), right its pairs (a, b). Link weight and cell root of each linked class."""
    fps, first = np.unique(np.asarray(left.column("fp")), return_index=True)
    raw = left.column("xs").take(pa.array(first)).to_pylist()
    x = [np.frombuffer(r, dtype=np.uint64) for r in raw]
    size = np.asarray(left.column("size"))[first]
    # Shingles as small numbers: sums over a flag array beat sorted merges.
    flat = np.unique(np.concatenate(x), return_inverse=True)[1] if x else np.empty(0, np.int64)
    cut = np.cumsum([0, *map(len, x)])
    ids = [flat[s:e] for s, e in zip(cut, cut[1:])]
    a, b = np.searchsorted(fps, np.asarray(right.column("a"))), np.searchsorted(fps, np.asarray(right.column("b")))
    o = np.argsort(a, kind="stable")
    a, b = a[o].tolist(), b[o].tolist()
    flag, last = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool), -1
    weight, links, root = np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64), list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a, b):
        if i != last:
            if last >= 0:
                flag[ids[last]] = False
            flag[ids[i]] = True
            last = i
        both = int(np.count_nonzero(flag[ids[j]]))
        if 100 * both >= PERCENT * (len(ids[i]) + len(ids[j]) - both):
            weight[i] += size[j]
            weight[j] += size[i]
            links[i] += 1
            links[j] += 1
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    on = np.flatnonzero(links > 0)
    return pa.table({"fp": fps[on], "weight": weight[on], "links": links[on], "root": fps[[find(i) for i in on.tolist()]]})


def links(docs: DataFrame, classes: DataFrame, block: int = 256) -> DataFrame:
    """(fp, weight, links, root): for a class in a cell, how many documents and classes it links with there, and a class it is connected with."""
    spark = docs.sparkSession
    pairs = candidates(docs).checkpoint()
    n = pairs.count()
    both = pairs.union(pairs.select("b", "a"))
    nodes = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("fp"), F.least("a", "m").alias("lab"))
    # Classes around one label are split into blocks by hash; a pair belongs to the cell of its two blocks under the label of a.
    lab = nodes.select(F.col("fp").alias("a"), "lab")
    many = lab.groupBy("lab").agg((F.floor(F.count("*") / block) + 1).cast("int").alias("k"))
    cells = pairs.join(lab, "a").join(many, "lab")
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(9)), F.col("k")).cast("int")
    cells = cells.select("lab", F.least(part("a"), part("b")).alias("i"), F.greatest(part("a"), part("b")).alias("j"), "a", "b").checkpoint()
    members = cells.select("lab", "i", "j", F.explode(F.array("a", "b")).alias("fp")).distinct()
    filter_ = bloom(spark, nodes.select("fp"), 2 * n)
    found = wanted_sets(docs, filter_).repartition("fp").dropDuplicates(["fp"])
    given = members.join(found, "fp").join(classes.select("fp", "size"), "fp")
    key = ["lab", "i", "j"]
    to = cells.select(F.col("lab").alias("lab2"), F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("a"), F.col("b"))
    return given.select(*key, "fp", "xs", "size").groupBy(key).cogroup(to.groupBy("lab2", "i2", "j2")).applyInArrow(_verify, "fp long, weight long, links long, root long")


def components(edges: DataFrame, small: int = 1 << 20) -> DataFrame:
    """(fp, comp): the smallest member of each connected component of edges(u, v), for every node that has an edge to another.

    Up to ``small`` edges (16 MB) a union-find on the driver does it; beyond that
    large-star and small-star rounds do, logarithmically many, each written to
    the checkpoint folder. Both give the same rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    spark = edges.sparkSession
    edges = edges.checkpoint()
    if edges.count() <= small:
        t = edges.toArrow()
        u, v = np.asarray(t.column("u")), np.asarray(t.column("v"))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = np.arange(len(nodes))
        a, b = at[: len(u)], at[len(u) :]
        while True:
            m = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], m)
            np.minimum.at(new, label[b], m)
            new = new[new]
            if (new == label).all():
                break
            label = new
        return spark.createDataFrame(pa.table({"fp": nodes, "comp": nodes[label] if len(nodes) else nodes}))
    while True:
        before = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("u <> m").select("u", "m")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct().checkpoint()
        if before == edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first():
            ends = edges.select(F.col("u").alias("fp"), F.col("v").alias("comp"))
            return ends.union(ends.select("comp", "comp").distinct())  # a star has no edge from its centre to itself


def join(docs: DataFrame, block: int = 256) -> DataFrame:
    """Every document of docs(doc_id, text, ...): its other columns, n_shingles, n_similar, component_id, class_id (smallest doc_id with the same set) and group (a number for each component, null for empty sets); input columns of those names are replaced."""
    other = [c for c in docs.columns if c not in ("doc_id", "text", "n_shingles", "n_similar", "component_id", "class_id", "group")]
    docs = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"_other{k}") for k, c in enumerate(other)))
    common.small_batches(docs.sparkSession)
    common.checkpoints(docs.sparkSession)
    each = sets(docs).checkpoint()
    texts = docs.select("text")
    classes = each.where("n > 0").groupBy("fp").agg(F.count("*").alias("size"), F.min("doc_id").alias("class_id")).checkpoint()
    found = links(texts, classes, block).checkpoint()
    comp = components(found.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    weight = found.groupBy("fp").agg(F.sum("weight").alias("weight"))
    linked = weight.join(comp, "fp").join(classes, "fp")
    ids = linked.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    linked = linked.join(ids, "comp").select("fp", "weight", "component_id", "comp")
    table = classes.join(linked, "fp", "left").select("fp", "class_id", (F.col("size") - 1 + F.coalesce("weight", F.lit(0))).alias("n_similar"), F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("comp", "fp").alias("group"))
    empty = F.col("n") == 0
    return each.join(table, "fp", "left").select(
        "doc_id",
        *(F.col(f"_other{k}").alias(c) for k, c in enumerate(other)),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(empty, F.lit(0)).otherwise(F.col("n_similar")).cast("long").alias("n_similar"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "group",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked documents: the smallest doc_id (null last), of rows that repeat it one. Texts without words all stay.

    The rows to drop are joined back by a hash of (doc_id, text); columns of any name stay as they are.
    """
    key, own = F.xxhash64(F.col("doc_id"), F.col("text")), common.free(docs.columns, "_key")
    of = join(docs.select("doc_id", "text", key.alias("_key"))).where("n_shingles > 0").select("doc_id", "_key", "group").checkpoint()
    first = of.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_key"))["_key"].alias("stay"))
    drop = of.join(first, "group").where("_key <> stay").select("_key").distinct()
    left = docs.withColumn(own, key).join(drop.withColumnRenamed("_key", own), own, "left_anti")
    again = of.groupBy("_key").count().where("count > 1").select("_key")
    again = again.join(first, again["_key"] == first["stay"]).select(F.col("_key").alias(own))
    if not again.isEmpty():  # whole rows that repeat
        left = left.join(again, own, "left_anti").unionByName(left.join(again, own, "left_semi").dropDuplicates([own]))
    return left.drop(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.load(spark, sf_dir, "documents").select("doc_id", "text")).drop("class_id", "group")


#: All pairs over the exact shingle sets; fine for the small tables of the SQL check.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
h AS MATERIALIZED (SELECT doc_id, hash(g) AS g FROM s),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT count(*) FROM e WHERE e.a = d.doc_id)::BIGINT AS n_similar, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""
