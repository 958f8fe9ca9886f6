"""Operator 9: benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of punctuation; numbers in digits or words (a
run of number words is one), units after a number (joined to it or not), and
names become typed placeholders. A capitalised word inside a sentence is a name;
one that begins a sentence may be, so texts are read both ways, each with windows
and slots of its own. Windows of ``window`` such template tokens are hash-joined with
the windows of the benchmark items, so a question with other numbers or names
still meets its origin. A window counts only if its slots are consistent:
along one alignment, equal slot values of the item must be equal in the
document, and different ones different. An item is found in a document when the
consistent windows cover at least ``least`` of its tokens.

Items that differ in slot values alone are one family: its template is looked up once,
for its first text, and a document has one row for it, with the member that fits best
(fewest changed slots, then most covered, then the smallest item_id) and the number of items it
stands for; ``families`` has the membership. A window that more than ``common`` families (or, of
words as they stand, texts) have is a preamble of the benchmark and no evidence; the
tokens that only such windows cover do not count for an item, unless it has no others.

The item windows are a sorted hash table on the executors. It is built from
blocks of at most ``block_items`` items and ``block_chars`` characters, or of one item that is longer; a larger
benchmark takes one pass over the documents for each block, which is written to the checkpoint
folder before the next block is broadcast and the last one removed. Documents are never shuffled.

Defined results: null, empty and word-free texts match nothing; template windows with
fewer than ``literals`` plain words are no evidence and go on to either side until they have
as many (items with fewer in all are found as they stand); words as they stand are compared too, so case alone hides nothing; an item shorter than a
window must be there as a whole (its template, if it has 5 tokens and two plain words at least), one of less than three words must be all of the text;
repeated rows of documents give repeated results; equal items are one family, as are equal texts with different ids; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ngramlm import _powers

_ONES = "one two three four five six seven eight nine".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Number words and their digits, which stand for their value; of the large ones the word itself does.
NUMBERS = {w: str(k) for k, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
NUMBERS |= {t: str(10 * k + 20) for k, t in enumerate(_TENS)} | {t + o: str(10 * k + 21 + j) for k, t in enumerate(_TENS) for j, o in enumerate(_ONES)}
NUMBERS |= {w: w for w in "hundred thousand million billion trillion".split()}
UNITS = frozenset("mm cm m km in ft mi kg g mg lb oz l ml s sec min h hr hour hours day days week weeks month months year years percent usd eur dollars euros mph kmh w kw v hz mb gb tb c f k meters metres kilometers kilometres miles grams kilograms liters litres seconds minutes".split())
NUMBER, NAME, UNIT = 1, 2, 3
#: Readings of a text: words as they are; capitalised words inside a sentence as names; those that begin one, too.
AS_IS, INSIDE, ALL = 0, 1, 2
SLOT = np.array([0, 0x1234567, 0x89ABCDE, 0xF012345], dtype=np.uint64)


class Template:
    """Template tokens of a chunk: text of each (row), its place among the text's words, hash, placeholder type (0: plain) and the value in a slot."""

    def __init__(self, texts: pa.Array):
        w = common.Words(texts)
        low = pc.utf8_lower(w.vocab)
        bare = pc.if_else(pc.match_substring_regex(low, "^[a-zà-ÿ]+$"), low, pc.replace_substring_regex(low, r"[^\p{L}\p{N}]+", ""))
        enc = bare.dictionary_encode()
        words = enc.dictionary.to_pylist()
        to = np.asarray(enc.indices)
        # A number and a unit in one word are two.
        units: dict[str, int] = {}
        first, second = np.arange(len(words)), np.full(len(words), -1)
        joined = np.asarray(pc.match_substring_regex(enc.dictionary, r"^[0-9]+[a-z]{1,10}$"), dtype=bool)
        at_of = {x: i for i, x in enumerate(words)}
        for i in np.flatnonzero(joined).tolist():
            number = words[i].rstrip("abcdefghijklmnopqrstuvwxyz")
            unit = words[i][len(number) :]
            if unit in UNITS:
                for k, x in ((first, number), (second, unit)):
                    if x not in at_of:
                        at_of[x] = len(words)
                        words.append(x)
                    k[i] = at_of[x]
        kind = np.zeros(len(words), np.int8)
        kind[np.asarray(pc.match_substring_regex(pa.array(words, pa.string()), r"^\p{N}"), dtype=bool)] = NUMBER
        spelled = np.zeros(len(words), bool)
        meant = list(words)
        for i, x in enumerate(words):
            if len(x) < 13 and not kind[i]:
                if x in NUMBERS:
                    kind[i], spelled[i], meant[i] = NUMBER, True, NUMBERS[x]
                elif x in UNITS:
                    kind[i] = UNIT
        value = common.word_hashes(pa.array(meant, pa.string())) if words else np.empty(0, np.uint64)
        capital = np.asarray(pc.match_substring_regex(w.vocab, r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}"), dtype=bool)
        stop = np.asarray(pc.match_substring_regex(w.vocab, r"[.!?:;|][^\p{L}\p{N}]*$"), dtype=bool)
        there = np.array([bool(x) for x in words], dtype=bool)[to] if words else np.empty(0, bool)
        keep = there[w.ids]
        ids, row = w.ids[keep], w.row[keep]
        word = (np.arange(len(w.ids)) - w.start[w.row])[keep]
        # word: the vocabulary word that a token is of; x: the word that it is
        x = to[ids]
        if (second[x] >= 0).any():
            n = 1 + (second[x] >= 0)
            other = np.zeros(int(n.sum()), bool)
            other[np.cumsum(n)[n == 2] - 1] = True
            ids, row, word, x = (np.repeat(v, n) for v in (ids, row, word, x))
            x = np.where(other, second[x], first[x])
        else:
            other = np.zeros(len(x), bool)
        values = value[x]
        if len(x):  # a run of number words is one number
            more = np.concatenate([[False], spelled[x][1:] & spelled[x][:-1] & (row[1:] == row[:-1])])
            if more.any():
                head = np.flatnonzero(~more)
                place = np.arange(len(x)) - head[np.cumsum(~more) - 1]
                values = np.where(place == 0, values, common.mix(values) * common.MULT[np.minimum(place, 63)])
                values = np.add.reduceat(values, head)
                ends = np.append(head[1:], len(x)) - 1
                last_word = ids[ends]
                ids, row, word, x, other = ids[head], row[head], word[head], x[head], other[head]
            else:
                last_word = ids
        else:
            last_word = ids
        self.row, self.word = row, word
        self.count = np.bincount(self.row, minlength=w.n).astype(np.int64)
        self.start = np.cumsum(self.count) - self.count
        k = kind[x]
        same = np.concatenate([[False], self.row[1:] == self.row[:-1]]) if len(ids) else np.empty(0, bool)
        before = np.concatenate([[0], k[:-1]]) if len(ids) else k
        stopped = np.concatenate([[True], stop[last_word][:-1]]) if len(ids) else same
        k = np.where((k == UNIT) & ~((before == NUMBER) & same), 0, k)
        name = (k == 0) & capital[ids] & ~other
        self.kinds = {INSIDE: np.where(name & same & ~stopped, NAME, k), ALL: np.where(name, NAME, k)}
        self.value = values

    def windows(self, size: int, literals: int, reading: int, extend: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first token and length of each window: of the template, where it has enough plain words, or of the words as they are (AS_IS), in whatever case. extend: template windows with too few plain words go on, to either side, until they have enough."""
        m = len(self.value) - size + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        ok = self.row[:m] == self.row[size - 1 :]
        h, few = self.value, np.empty(0, np.int64)
        if reading != AS_IS:
            kind = self.kinds[reading]
            h = np.where(kind > 0, SLOT[kind], h)
            plain = np.concatenate([[0], np.cumsum(kind == 0)])
            n = plain[size:] - plain[:m]
            if extend:
                few = np.flatnonzero(ok & (n < literals))
            ok &= (n >= (literals if extend else 2 if size >= 5 else size)) & (n < size)
        acc = np.full(m, np.uint64(reading))
        for j in range(size):
            acc += h[j : j + m] * common.MULT[j]
        at = np.flatnonzero(ok)
        x, length = common.mix(acc[at]), np.full(len(at), size)
        if len(few):
            end = np.searchsorted(plain, plain[few] + literals)  # one past the last plain word needed
            on = end <= len(self.value)
            a, e = few[on], end[on]
            want = plain[few + size] - literals
            start = np.searchsorted(plain, want, side="right") - 1
            on = want >= 0
            a, e = np.concatenate([a, start[on]]), np.concatenate([e, few[on] + size])
            on = self.row[a] == self.row[e - 1]
            a, e = np.divmod(common.distinct(a[on] * (len(plain) + 1) + e[on]), len(plain) + 1)
            up, down = _powers(1 << max(16, len(plain).bit_length()))
            total = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)])])
            own = (total[e] - total[a]) * down[a] + common.MULT[63] * (e - a).astype(np.uint64) + np.uint64(reading)
            x, at, length = np.concatenate([x, common.mix(own)]), np.concatenate([at, a]), np.concatenate([length, e - a])
        return x, at, length


def family_keys(t: Template) -> np.ndarray:
    """Equal for texts with equal templates (capitalised words as names) whose slots are equal in the same places."""
    out = np.zeros(len(t.count), np.uint64)
    kinds = t.kinds[ALL]
    for i, (a, n) in enumerate(zip(t.start.tolist(), t.count.tolist())):
        k, v = kinds[a : a + n], t.value[a : a + n]
        slot = k > 0
        first = np.unique(v[slot], return_index=True)
        alike = np.zeros(n, np.uint64)
        alike[slot] = first[1][np.searchsorted(first[0], v[slot])].astype(np.uint64)
        x = np.where(slot, SLOT[k] + alike, v)
        out[i] = xxhash.xxh64_intdigest(x.tobytes())
    return out


def families(benchmark: DataFrame) -> DataFrame:
    """(item_id, first_item): the smallest item of the family of each item that has words."""

    def run(batches):
        for b in common.chunks(batches):
            t = Template(b.column("text"))
            on = np.flatnonzero(t.count)
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(on)), pa.array(family_keys(t)[on].view(np.int64))], names=["item_id", "family"])

    keyed = benchmark.select("item_id", "text").mapInArrow(run, "item_id long, family long")
    return keyed.join(keyed.groupBy("family").agg(F.min("item_id").alias("first_item")), "family").select("item_id", "first_item")


@dataclass
class Index:
    window: int
    literals: int
    least: float
    item_ids: list[int | None]  # of each text the smallest
    family: np.ndarray
    items: np.ndarray  # how many items the family of each text has
    own: list[np.ndarray]  # by text: which tokens count
    size: np.ndarray  # of each text
    kinds: dict[int, list[np.ndarray]]  # by reading
    values: list[np.ndarray]
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by size and reading: sorted hashes, text, place, filter

    @staticmethod
    def build(item_ids: list[int | None], texts: list[str | None], window: int, literals: int, least: float, common_: int = 50) -> "Index":
        ids_of: dict[str, list] = {}
        for i, x in zip(item_ids, texts):
            if x is not None:
                ids_of.setdefault(x, []).append(i)
        order = sorted(ids_of, key=lambda x: min((i is None, i or 0) for i in ids_of[x]))
        t = Template(pa.array(order, pa.string()))
        part = lambda a: np.split(a, t.start[1:]) if len(t.start) else []
        family = np.unique(family_keys(t), return_inverse=True)[1] if order else np.empty(0, np.int64)
        items = np.bincount(family, weights=[len(ids_of[x]) for x in order]).astype(np.int64)[family] if order else family
        first = np.zeros(len(order), bool)
        first[np.unique(family, return_index=True)[1]] = True
        sizes = sorted({min(window, int(n)) for n in t.count if n})
        raw, own = {}, np.zeros(len(t.value) + 1, np.int64)
        for size, reading in ((s, y) for s in sizes for y in (AS_IS, INSIDE, ALL)):
            h, at, length = t.windows(size, literals, reading, size == window)
            row = t.row[at] if len(at) else np.empty(0, np.int64)
            on = np.minimum(t.count, window)[row] == size
            h, at, length, row = h[on], at[on], length[on], row[on]
            # By window, in how many families (texts, for words as they are) it is.
            who = row if reading == AS_IS else family[row]
            pairs = np.unique(np.stack([h, who.astype(np.uint64)]), axis=1) if len(h) else np.empty((2, 0), np.uint64)
            known, often = np.unique(pairs[0], return_counts=True)
            rare = often[np.searchsorted(known, h)] <= common_ if len(h) else np.empty(0, bool)
            raw[size, reading] = h, at, length, row, rare
            np.add.at(own, at[rare], 1)
            np.add.at(own, (at + length)[rare], -1)
        own = np.cumsum(own)[:-1] > 0
        some = np.zeros(len(order), bool)
        some[t.row[own]] = True
        own |= ~some[t.row] if len(own) else own  # texts all of whose windows are common keep them
        tables = {}
        for (size, reading), (h, at, _, row, rare) in raw.items():
            on = (rare | ~some[row]) & (first[row] | (reading == AS_IS))
            h, at, row = h[on], at[on], row[on]
            o = np.argsort(h, kind="stable")
            h, at, row = h[o], at[o], row[o]
            seen = np.zeros(1 << 20, bool)
            seen[h >> np.uint64(44)] = True
            tables[size, reading] = (h, row, at - t.start[row], seen)
        ids = [min(ids_of[x], key=lambda i: (i is None, i or 0)) for x in order]
        return Index(window, literals, least, ids, family, items, part(own), t.count, {y: part(k) for y, k in t.kinds.items()}, part(t.value), tables)

    def find(self, texts: pa.Array) -> list[tuple[int, int, float, int, int, int]]:
        """(text, member, share of its tokens that count, first and end word in the text, changed slots) of each family found."""
        t = Template(texts)
        hits: dict[tuple[int, int, int, int], list[tuple[int, int]]] = {}
        for (size, reading), (keys, items, places, seen) in self.tables.items():
            h, at, length = t.windows(size, self.literals, reading, size == self.window)
            near = seen[h >> np.uint64(44)]
            if size < 3:
                near &= t.count[t.row[at]] == size
            h, at, length = h[near], at[near], length[near]
            a, b = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
            some = np.flatnonzero(b > a)
            for x, y, p, n in zip(a[some].tolist(), b[some].tolist(), at[some].tolist(), length[some].tolist()):
                r = int(t.row[p])
                for z in range(x, y):
                    q = int(places[z])
                    for own in (INSIDE, ALL) if reading == AS_IS else (reading,):
                        hits.setdefault((r, int(items[z]), p - int(t.start[r]) - q, own), []).append((q, n))
        got: dict[tuple[int, int], list] = {}
        for (r, item, shift, reading), found in hits.items():
            kinds, values = self.kinds[reading][item], self.values[item]
            base = int(t.start[r]) + shift
            # Slots of all windows of this alignment: which values of the item meet which of the document.
            places = sorted({j for q, size in found for j in range(q, q + size) if kinds[j]})
            slots = {j: ((int(kinds[j]), int(values[j])), (int(kinds[j]), int(t.value[base + j]))) for j in places}
            there: dict = {}
            back: dict = {}
            for v, d in slots.values():
                there.setdefault(v, set()).add(d)
                back.setdefault(d, set()).add(v)
            torn = {j for j, (v, d) in slots.items() if len(there[v]) > 1 or len(back[d]) > 1}
            covered: set[int] = set()
            for q, size in found:
                if torn.isdisjoint(range(q, q + size)):
                    covered.update(range(q, q + size))
            changed = {j for j in covered & slots.keys() if slots[j][0] != slots[j][1]}
            if covered:
                one = got.setdefault((r, item), [set(), 1 << 60, 0, set()])
                one[0] |= covered
                one[1], one[2] = min(one[1], base + min(covered)), max(one[2], base + max(covered))
                one[3] |= changed
        best: dict[tuple[int, int], tuple] = {}
        for (r, item), (covered, first, last, changed) in got.items():
            own = self.own[item]
            share = sum(1 for j in covered if own[j]) / int(own.sum())
            if share >= self.least:
                row = (len(changed), -share, item, int(t.word[first]), int(t.word[last]) + 1)
                key = (r, int(self.family[item]))
                best[key] = min(best.get(key, row), row)
        return sorted((r, item, -share, first, end, changed) for (r, _), (changed, share, item, first, end) in best.items())


def indexes(benchmark: DataFrame, window: int = 8, literals: int = 4, least: float = 0.5, block_items: int = 50_000, block_chars: int = 1 << 25, common: int = 50):
    """One Index for each block of items (item_id, text); a block holds about half of either bound, or one item that is longer. Their number first."""
    items = benchmark.select("item_id", "text").where("text is not null")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = 1 if n <= block_items and chars <= block_chars else max(-(-2 * n // block_items), -(-2 * chars // block_chars))
    yield blocks
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        if rows:
            yield Index.build([r["item_id"] for r in rows], [r["text"] for r in rows], window, literals, least, common)


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("word_start", pa.int64()), ("word_end", pa.int64()), ("changed_slots", pa.int64()), ("items", pa.int64())])
FOUND_DDL = "doc_id long, item_id long, coverage double, word_start long, word_end long, changed_slots long, items long"


def contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """One row for each document and family of benchmark items (of a block) found in it."""
    spark, out = docs.sparkSession, None
    common.small_batches(spark)
    each = indexes(benchmark, **params)
    blocks = next(each)
    for index in each:
        shipped = spark.sparkContext.broadcast(index)

        def run(batches, shipped=shipped):
            for b in common.chunks(batches):
                ids = b.column("doc_id").to_pylist()
                found = shipped.value.find(b.column("text"))
                if found:
                    r, item, share, first, end, changed = zip(*found)
                    yield common.batch(FOUND, [ids[i] for i in r], [shipped.value.item_ids[i] for i in item], share, first, end, changed, shipped.value.items[list(item)])

        part = docs.select("doc_id", "text").mapInArrow(run, FOUND_DDL)
        if blocks > 1:  # one block at a time on the executors
            common.checkpoints(spark)
            part = part.checkpoint()
            shipped.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], FOUND_DDL) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns."""
    spark = docs.sparkSession
    common.small_batches(spark)
    each = indexes(benchmark, **params)
    blocks = next(each)
    for index in each:
        shipped = spark.sparkContext.broadcast(index)

        def run(batches, shipped=shipped):
            for b in common.chunks(batches):
                bad = {r for r, *_ in shipped.value.find(b.column("text"))}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)])) if bad else b

        docs = docs.mapInArrow(run, docs.schema)
        if blocks > 1:  # one block at a time on the executors
            common.checkpoints(spark)
            docs = docs.checkpoint()
            shipped.destroy()
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark")).drop("items")
