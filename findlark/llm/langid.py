"""Operator 3: language identification by segmentation-marginalised unigrams.

A word (run of letters, lower-cased, with the vocabulary's word mark in front)
can be cut into pieces of a fixed public subword vocabulary in many ways. Its
probability in a language is the sum over all cuts of the product of that
language's piece probabilities, found by the forward algorithm; the piece
probabilities are learned by expectation maximisation over (word, count) lists.

Training reads a bounded sample (about ``per_lang`` documents of each language,
chosen by a hash of doc_id) and learns from all words of it.
Scoring is one narrow pass: words are dictionary-encoded by Arrow, the forward
algorithm runs in numpy over distinct words grouped by length, and the model (a
table of pieces x languages) is broadcast: its size is that of the vocabulary.

Defined results: null text or text without a letter is ``und`` with score 0; so
is everything when there is nothing to learn from. A null doc_id counts as held
out. Ties go to the first language in byte order. Equal texts get equal results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x100000001B3F)
LONG = 40  # longer words are summed in logarithms


def vocabulary(path: str | None = None) -> list[str]:
    """Lower-case letter pieces of the public subword vocabulary, with or without the word mark."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in pieces if p == MARK or LETTERS.fullmatch(p.removeprefix(MARK)))


def codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), n).astype(np.uint64)


class Pieces:
    """Piece number of every substring of words: by length, a sorted array of hashes."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)  # its number stands for an unknown character
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append(i)
        for n, ids in by.items():
            h = self.hash(codes([pieces[i] for i in ids], n), 1)[n][:, 0]
            order = np.argsort(h)
            self.tables[n] = (h[order], np.array(ids, np.int32)[order])
        self.longest = max(by, default=1)

    @staticmethod
    def hash(c: np.ndarray, wide: int | None = None) -> dict[int, np.ndarray]:
        """By length, the hash of the substring at each start."""
        out, n = {}, c.shape[1]
        h = np.zeros_like(c)
        for k in range(1, n + 1):
            h = h[:, : n - k + 1] * BASE + (c[:, k - 1 :] + np.uint64(7)) * common.MULT[3]
            out[k] = common.mix(h)
        return out

    def ids(self, c: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the piece number at each start; size + 1: no piece."""
        out, n = {}, c.shape[1]
        h = np.zeros_like(c)
        for k in range(1, min(self.longest, n) + 1):
            h = h[:, : n - k + 1] * BASE + (c[:, k - 1 :] + np.uint64(7)) * common.MULT[3]
            none = self.size + (k > 1)
            if k not in self.tables:
                if k == 1:
                    out[k] = np.full(h.shape, none, np.int32)
                continue
            keys, ids = self.tables[k]
            x = common.mix(h)
            at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            out[k] = np.where(keys[at] == x, ids[at], np.int32(none))
        return out


def forward(ids: dict[int, np.ndarray], n: int, p: np.ndarray) -> list[np.ndarray]:
    """alpha[j][word, language]: probability of the first j characters."""
    alpha = [np.ones((len(ids[1]), p.shape[1]))]
    for j in range(1, n + 1):
        acc = np.zeros_like(alpha[0])
        for k, x in ids.items():
            if k <= j:
                acc += alpha[j - k] * p[x[:, j - k]]
        alpha.append(acc)
    return alpha


def log_forward(ids: dict[int, np.ndarray], n: int, logp: np.ndarray, keep: bool = False):
    """As forward, in logarithms: that of the whole word, or (keep) all of them."""
    longest, alpha = max(ids), [np.zeros((len(ids[1]), logp.shape[1]))]
    for j in range(1, n + 1):
        acc = None
        for k, x in ids.items():
            if k <= j:
                t = alpha[-k] + logp[x[:, j - k]]
                acc = t if acc is None else np.logaddexp(acc, t)
        alpha = [*alpha, acc] if keep else [*alpha[-longest:], acc]
    return alpha if keep else alpha[-1]


def expected(ids: dict[int, np.ndarray], n: int, p: np.ndarray):
    """(piece numbers, probability that the word is cut there) of every substring, words of n characters."""
    if n <= LONG:
        alpha = forward(ids, n, p)
        beta = [np.ones_like(alpha[0]) for _ in range(n + 1)]
        for j in range(n - 1, -1, -1):
            beta[j] = sum(beta[j + k] * p[x[:, j]] for k, x in ids.items() if j + k <= n)
        total = np.maximum(alpha[n], 1e-300)
        for k, x in ids.items():
            for i in range(n - k + 1):
                yield x[:, i], alpha[i] * p[x[:, i]] * beta[i + k] / total
        return
    logp = np.log(np.maximum(p, 1e-300))
    alpha = log_forward(ids, n, logp, keep=True)
    beta = [np.zeros_like(alpha[0]) for _ in range(n + 1)]
    for j in range(n - 1, -1, -1):
        beta[j] = np.logaddexp.reduce([beta[j + k] + logp[x[:, j]] for k, x in ids.items() if j + k <= n])
    for k, x in ids.items():
        for i in range(n - k + 1):
            yield x[:, i], np.exp(alpha[i] + logp[x[:, i]] + beta[i + k] - alpha[n])


@dataclass
class Model:
    langs: list[str]
    pieces: Pieces
    p: np.ndarray  # (pieces + 2, languages); the last row is no piece

    def log_words(self, words: list[str]) -> np.ndarray:
        """log P(word | language) of distinct words."""
        out = np.zeros((len(words), len(self.langs)))
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, own in by.items():
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                ids = self.pieces.ids(codes([words[i] for i in part], n))
                if n <= LONG:
                    out[part] = np.log(forward(ids, n, self.p)[n])
                else:
                    out[part] = log_forward(ids, n, np.log(np.maximum(self.p, 1e-300)))
        return out


def learn(counts: list[tuple[str, str, int]], pieces: list[str], rounds: int = 4, floor: float = 0.02) -> Model:
    """EM over (language, word, count)."""
    langs = sorted({x for x, _, _ in counts})
    table = Pieces(pieces)
    words = sorted({w for _, w, _ in counts})
    index, lang_no = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(langs)}
    c = np.zeros((len(words), len(langs)))
    for lang, w, k in counts:
        c[index[w], lang_no[lang]] += k
    groups, by = [], {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, own in by.items():
        for a in range(0, len(own), 20_000):
            part = own[a : a + 20_000]
            groups.append((n, c[part], table.ids(codes([words[i] for i in part], n))))

    def normal(e: np.ndarray) -> np.ndarray:
        p = (e + floor) / (e + floor).sum(axis=0)
        return np.vstack([p, np.zeros((1, len(langs)))])

    e = np.zeros((table.size + 1, len(langs)))
    for n, own, ids in groups:  # begin with how often each piece occurs anywhere
        for x in ids.values():
            for z in range(len(langs)):
                e[:, z] += np.bincount(x.ravel(), weights=np.repeat(own[:, z], x.shape[1]), minlength=table.size + 2)[:-1]
    p = normal(e)
    for _ in range(rounds):
        e = np.zeros_like(e)
        for n, own, ids in groups:
            for x, w in expected(ids, n, p):
                w = w * own
                for z in range(len(langs)):
                    e[:, z] += np.bincount(x, weights=w[:, z], minlength=table.size + 2)[:-1]
        p = normal(e)
    return Model(langs, table, p)


def _marked(vocab: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct marked letter runs of vocabulary words; pairs (vocabulary entry, run)."""
    index: dict[str, int] = {}
    a, b = [], []
    for i, w in enumerate(pc.utf8_lower(vocab).to_pylist()):
        for run in (w,) if w.isalpha() else LETTERS.findall(w):
            a.append(i)
            b.append(index.setdefault(MARK + run, len(index)))
    return list(index), np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def held_out(doc_id, mod: int, rest: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over docs(lang, text), added up in each partition's chunks first."""

    def run(batches):
        for b in common.chunks(batches):
            for lang in pc.unique(b.column("lang")).to_pylist():
                w = common.Words(b.filter(pc.equal(b.column("lang"), lang)).column("text"))
                runs, x, y = _marked(w.vocab)
                n = np.bincount(y, weights=np.bincount(w.ids, minlength=len(w.vocab))[x], minlength=len(runs)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(runs), pa.string()), "word": pa.array(runs, pa.string()), "n": n})

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, per_lang: int = 3000) -> Model | None:
    """Learns from a bounded hash sample of docs(doc_id, text, lang) rows that have text and lang; None if there are none."""
    known = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id"), 4, 2))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, per_lang / n))])
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    counts = word_counts(sample).toArrow()
    return learn(list(zip(*(counts.column(c).to_pylist() for c in ("lang", "word", "n")))), vocabulary()) if counts.num_rows else None


SCHEMA = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def scores(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    w = common.Words(texts)
    runs, x, y = _marked(w.vocab)
    if model is None or not runs:
        return ["und"] * len(texts), np.zeros(len(texts))
    logs = model.log_words(runs)
    per = np.column_stack([np.bincount(x, weights=logs[y, z], minlength=len(w.vocab)) for z in range(logs.shape[1])])
    size = np.bincount(x, minlength=len(w.vocab))
    n = np.bincount(w.row, weights=size[w.ids], minlength=len(texts))
    total = np.column_stack([np.bincount(w.row, weights=per[w.ids, z], minlength=len(texts)) for z in range(logs.shape[1])])
    best = total.argmax(axis=1)
    # Independent words overstate the evidence: at most 30 words' worth counts.
    z = total / np.maximum(n, 1)[:, None] * np.minimum(n, 30)[:, None]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    sure = (z / z.sum(axis=1, keepdims=True))[np.arange(len(best)), best]
    return [model.langs[k] if m else "und" for k, m in zip(best.tolist(), (n > 0).tolist())], np.where(n > 0, sure, 0.0)


def predict(docs: DataFrame, model: Model | None, lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """docs with the language and its score under the names given; input columns of those names are replaced."""
    common.small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(lang_as, score_as)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())])

    def run(batches):
        for b in common.chunks(batches):
            lang, score = scores(shipped.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*b.schema.names, lang_as, score_as])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    model = train(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
