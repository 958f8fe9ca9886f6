"""Operator 8: chat formatting as a prefix tree.

A turn is written ``<|turn|>role<|text|>text<|end|>`` with control strings in
role and text escaped reversibly, and tokenized in three parts (before, text,
after), so the loss mask - the assistant's text - falls on token borders.
Conversations with equal initial turns share the tree nodes of those turns, at
any depth: a node's key is the hash of its parent's key and its turn (with the
role's length, so no two turns look alike). Each node is encoded once.

Nodes are ordered depth-first by a range sort on (root, path, depth), where a
path names only the nodes that have siblings, so that it stays short however
deep a conversation goes; offsets are running sums inside each sorted partition
plus the partitions' totals, so no tree has to fit a task, however many
conversations begin alike. A node has its tokens once, its offset in the tree's
sequence, the position of its first token in a conversation (its ancestors'
tokens) and the merged intervals of its ancestors, to which it may attend
besides itself.

``read_back`` goes the other way by the layout alone: the tree's sequence and
loss mask are cut into pages by offset, and a conversation is what its last
node's intervals cut out of them.

Defined results: rows of a conversation go by turn, then role and text (nulls
first); null text is empty, null role the empty role; repeated rows are turns of
their own; a null conv_id is one conversation. A conversation is read in a
stream, one turn at a time.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESC = "␛"
CONTROL = re.compile(r"(?=<\||</?s>|\[/?INST\]|<</?SYS>>)(.)", re.I | re.S)
LOSS_ROLE = "assistant"


def escape(s: str) -> str:
    """Doubles the escape sign and puts ESC + "." behind the first sign of every control string."""
    return CONTROL.sub(r"\1" + ESC + ".", s.replace(ESC, ESC + ESC))


def unescape(s: str) -> str:
    return re.sub(ESC + "(.)", lambda m: ESC if m.group(1) == ESC else "", s, flags=re.S)


@lru_cache(maxsize=2)
def tokenizer(path: str | None):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True  # strings of special tokens are ordinary text
    return t


@lru_cache(maxsize=2)
def id_type(path: str | None) -> str:
    """Two bytes hold the ids of a vocabulary of up to 65,536."""
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<i4"


def encode(parts: list[str], path: str | None = None) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch_fast(parts, add_special_tokens=False)]


def _batch(ddl: str, columns) -> pa.RecordBatch:
    """Columns of Python values as a batch of a simple DDL schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*(x.split() for x in ddl.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, t in zip(columns, types)], names=list(names))


CHAIN_DDL = "conv_id long, k long, node binary, parent binary, root binary, role string, text string"
NODE_DDL = "node binary, parent binary, root binary, depth long, length long, loss_from long, loss_to long, ids binary"
STEP_DDL = "conv_id long, k long, node binary, root binary, path binary, position long, length long"


def chain(conversations: DataFrame) -> DataFrame:
    """Every turn with its node, its parent (of a first turn: zeros) and its first turn's node."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        first, conv, k, node, root = True, None, 0, bytes(16), b""
        for b in common.chunks(batches, most=1 << 20):
            out = [[] for _ in range(5)]
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if first or c != conv:
                    first, conv, k, node = False, c, 0, bytes(16)
                parent, said = node, role.encode()
                node = xxhash.xxh3_128_digest(parent + len(said).to_bytes(8, "big") + said + text.encode())
                root = root if k else node
                for column, v in zip(out, (c, k, node, parent, root)):
                    column.append(v)
                k += 1
            yield _batch(CHAIN_DDL, [*out, b.column("role"), b.column("text")])

    return rows.mapInArrow(run, CHAIN_DDL)


def encoded(each: DataFrame, path: str | None = None) -> DataFrame:
    """The distinct nodes of chain with their tokens (little-endian, id_type)."""

    def run(batches):
        end, kind, heads = encode([END], path)[0], id_type(path), {}
        for b in common.chunks(batches, most=1 << 20):
            roles = b.column("role").to_pylist()
            new = [r for r in dict.fromkeys(roles) if r not in heads]
            heads.update(zip(new, encode([TURN + escape(r) + TEXT for r in new], path)))
            out = [[] for _ in range(4)]
            for role, t in zip(roles, encode([escape(t) for t in b.column("text").to_pylist()], path)):
                h = heads[role]
                loss = (len(h), len(h) + len(t)) if role == LOSS_ROLE else (0, 0)
                for column, v in zip(out, (len(h) + len(t) + len(end), *loss, np.array(h + t + end, kind).tobytes())):
                    column.append(v)
            if len(heads) > 10_000:
                heads.clear()
            yield _batch(NODE_DDL, [*(b.column(x) for x in ("node", "parent", "root", "depth")), *out])

    return each.select("node", "parent", "root", F.col("k").alias("depth"), "role", "text").dropDuplicates(["node"]).mapInArrow(run, NODE_DDL)


def steps(each: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every turn with its node's path (of the nodes from the root to it that have siblings), position and length."""
    forks = nodes.where("depth > 0").groupBy("parent").agg(F.count("*").alias("n")).where("n > 1").select("parent", F.lit(True).alias("fork"))
    known = nodes.select("node", "parent", "length").join(forks, "parent", "left").select("node", "length", F.coalesce("fork", F.lit(False)).alias("fork"))
    rows = each.select("conv_id", "k", "node", "root").join(known, "node").repartition("conv_id").sortWithinPartitions("conv_id", "k")

    def run(batches):
        first, conv, way, position = True, None, b"", 0
        for b in batches:
            ways, positions = [], []
            for c, node, fork, n in zip(*(b.column(x).to_pylist() for x in ("conv_id", "node", "fork", "length"))):
                if first or c != conv:
                    first, conv, way, position = False, c, b"", 0
                way += node[:8] if fork else b""
                ways.append(way)
                positions.append(position)
                position += n
            yield _batch(STEP_DDL, [*(b.column(x) for x in ("conv_id", "k", "node", "root")), ways, positions, b.column("length")])

    return rows.mapInArrow(run, STEP_DDL)


def layout(each: DataFrame) -> DataFrame:
    """(node, offset): where each distinct node of steps stands in its tree's depth-first sequence."""
    nodes = each.select("node", "root", "path", "k", "length").dropDuplicates(["node"])
    nodes = nodes.repartitionByRange(F.col("root"), F.col("path"), F.col("k")).sortWithinPartitions("root", "path", "k")

    def run(batches):
        pid, root, at = TaskContext.get().partitionId(), None, 0
        for b in batches:
            offsets = []
            for r, n in zip(b.column("root").to_pylist(), b.column("length").to_pylist()):
                if r != root:
                    root, at = r, 0
                offsets.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("root"), b.column("length"), pa.array([pid] * b.num_rows, pa.int32()), pa.array(offsets, pa.int64())], names=["node", "root", "length", "pid", "local"])

    local = nodes.mapInArrow(run, "node binary, root binary, length long, pid int, local long").checkpoint()
    totals = local.groupBy("root", "pid").agg(F.sum("length").alias("total"))
    before = Window.partitionBy("root").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition at most
    base = totals.select(F.col("root").alias("r"), F.col("pid").alias("p"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return local.join(base, (F.col("root") == F.col("r")) & (F.col("pid") == F.col("p"))).select("node", (F.col("base") + F.col("local")).alias("offset"))


def tree(conversations: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths). nodes: node, parent, root, depth, offset, position, length, loss_from, loss_to, ids, attends (start, end of its ancestors' intervals, merged); paths: conv_id, k, node."""
    common.small_batches(conversations.sparkSession)
    common.checkpoints(conversations.sparkSession)
    each = chain(conversations).checkpoint()
    nodes = encoded(each, path).checkpoint()
    way = steps(each, nodes).checkpoint()
    rows = way.select("conv_id", "k", "node", "position", "length").join(layout(way), "node").repartition("conv_id").sortWithinPartitions("conv_id", "k")

    def run(batches):
        first, conv, spans = True, None, []
        for b in batches:
            got = []
            for c, start, n in zip(*(b.column(x).to_pylist() for x in ("conv_id", "offset", "length"))):
                if first or c != conv:
                    first, conv, spans = False, c, []
                got.append([{"start": s, "end": e} for s, e in spans])
                if spans and spans[-1][1] == start:
                    spans[-1] = (spans[-1][0], start + n)
                else:
                    spans.append((start, start + n))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("node", "offset", "position")), pa.array(got, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["node", "offset", "position", "attends"])

    seen = rows.mapInArrow(run, "node binary, offset long, position long, attends array<struct<start: long, end: long>>").dropDuplicates(["node"])
    return nodes.join(seen, "node"), each.select("conv_id", "k", "node")


READ_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def pages(nodes: DataFrame, page: int, wide: int) -> DataFrame:
    """(root, page, ids, mask): the trees' sequences, laid out by offset and cut every ``page`` tokens, and their loss masks (a byte a token)."""

    def run(batches):
        ddl = "root binary, page long, at long, ids binary, mask binary"
        for b in batches:
            out = []
            for root, offset, n, lf, lt, ids in zip(*(b.column(x).to_pylist() for x in ("root", "offset", "length", "loss_from", "loss_to", "ids"))):
                mask, at = bytes(lf) + b"\1" * (lt - lf) + bytes(n - lt), 0
                while at < n:
                    number, place = divmod(offset + at, page)
                    m = min(page - place, n - at)
                    out.append((root, number, place, ids[wide * at : wide * (at + m)], mask[at : at + m]))
                    at += m
            yield _batch(ddl, zip(*out) if out else [[]] * 5)

    parts = nodes.select("root", "offset", "length", "loss_from", "loss_to", "ids").mapInArrow(run, "root binary, page long, at long, ids binary, mask binary")
    whole = parts.groupBy("root", "page").agg(F.array_sort(F.collect_list(F.struct("at", "ids", "mask"))).alias("p"))  # a page's tokens at most
    joined = lambda c: F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x[c]))
    return whole.select("root", "page", joined("ids").alias("ids"), joined("mask").alias("mask"))


def read_back(nodes: DataFrame, paths: DataFrame, path: str | None = None, page: int = 4096) -> DataFrame:
    """Each conversation, cut out of the trees' sequences by its last node's intervals: digests of its turns and of the text under the loss mask."""
    wide = int(id_type(path)[-1])
    leaves = paths.groupBy("conv_id").agg(F.max_by("node", "k").alias("node"))
    leaves = leaves.join(nodes.select("node", "root", "offset", "length", "position", "attends"), "node")
    own = F.array(F.struct(F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end")))
    spans = leaves.select("conv_id", "root", (F.col("position") + F.col("length")).alias("total"), F.posexplode(F.concat("attends", own)).alias("i", "span"))
    spans = spans.select("conv_id", "root", "total", "i", "span.*", F.explode(F.sequence(F.expr(f"span.start div {page}"), F.expr(f"(span.end - 1) div {page}"))).alias("page"))
    a, e = F.greatest("start", F.col("page") * page) - F.col("page") * page, F.least("end", (F.col("page") + 1) * page) - F.col("page") * page
    spans = spans.select("conv_id", "root", "total", "i", "page", a.cast("int").alias("a"), (e - a).cast("int").alias("n"))
    cut = spans.join(pages(nodes, page, wide), ["root", "page"])
    cut = cut.select("conv_id", "total", "i", "page", F.substring("ids", F.col("a") * wide + 1, F.col("n") * wide).alias("ids"), F.substring("mask", F.col("a") + 1, F.col("n")).alias("mask"))
    rows = cut.repartition("conv_id").sortWithinPartitions("conv_id", "i", "page")
    form = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)

    def run(batches):
        decode, kind = tokenizer(path).decode, id_type(path)

        def done(conv, total, ids, mask):
            ids, mask = np.frombuffer(b"".join(ids), kind), np.frombuffer(b"".join(mask), np.int8)
            if len(ids) != total:
                raise ValueError(f"conversation {conv}: its intervals have {len(ids)} tokens, its positions say {total}")
            written = decode(ids.tolist(), skip_special_tokens=False)
            said, text, chars, n, at = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for m in form.finditer(written):
                if m.start() != at:
                    break
                at, n = m.end(), n + 1
                said.update("{}\n{}\n".format(*map(unescape, m.groups())).encode())
            if at != len(written):
                raise ValueError(f"conversation {conv}: no turn at sign {at}")
            edge = np.flatnonzero(np.diff(mask, prepend=0, append=0)).tolist()
            for s, e in zip(edge[::2], edge[1::2]):
                loss = unescape(decode(ids[s:e].tolist(), skip_special_tokens=False))
                chars += len(loss)
                text.update(loss.encode())
            return conv, n, said.hexdigest(), chars, text.hexdigest(), len(written)

        state = None
        for b in batches:
            out = []
            for c, total, ids, mask in zip(*(b.column(x).to_pylist() for x in ("conv_id", "total", "ids", "mask"))):
                if state is None or c != state[0]:
                    if state:
                        out.append(done(*state))
                    state = (c, total, [], [])
                state[2].append(ids)
                state[3].append(mask)
            if out:
                yield _batch(READ_DDL, zip(*out))
        if state:
            yield _batch(READ_DDL, zip(done(*state)))

    return rows.mapInArrow(run, READ_DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = common.load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(*tree(rows))


#: Digests and lengths follow from the turns and the template alone.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (
  SELECT *, length(text) + 2 * len(regexp_extract_all(lower(text), '<[|]|</?s>|\[/?inst\]|<</?sys>>')) + length(text) - length(replace(text, '␛', '')) AS written FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(written + length(role) + length('<|turn|><|text|><|end|>'))::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""
