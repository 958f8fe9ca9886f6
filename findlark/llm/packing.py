"""Operator 2: best-fit packing with swap-based local search.

Documents become token ids (a public tokenizer, then id 0 as the end), are cut
into pieces only where they are longer than a sequence, and the pieces are
packed. Piece lengths alone travel: a few dozen bytes a piece go through one
round-robin shuffle into packing blocks of about ``block`` pieces, whatever
document, source or text they come from, so no hot key can fill a block. Each
block is packed best-fit decreasing, then improved by local search until its
lower bound is reached: pieces move or change places (one for one, two for one,
one for two) between underfull bins, each time raising the sum of squared
fills, so that the room gathers in few bins and others run empty. The pieces of
all underfull bins are searched, by bit sets of their lengths. Where nothing
more can be raised, bins change pieces with full ones, which moves the room
elsewhere, and the search goes on, until ``patience`` such changes gain nothing.

Defined results: null or empty text is one piece of length 1 (the end id);
repeated rows are packed as often as they come; a null doc_id is carried along.
"""

from __future__ import annotations

import os
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common

CAPACITY = 2048


@lru_cache(maxsize=2)
def tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))


#: Stands between words that are encoded in one call; its own id marks the cuts.
CUT, CUT_ID = "<|startoftext|>", 49406
#: Words whose capitals fold one to one and whose last full stop or comma is a token of its own.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"


def _spread(flat: np.ndarray, first: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """flat[first[k] : first[k] + size[k]] for each k in of, one after the other."""
    n = size[of]
    to = np.cumsum(n)
    return flat[np.arange(to[-1] if len(to) else 0) - np.repeat(to - n - first[of], n)]


def _encode_words(words: list[str], path: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after the other, and how many each has."""
    t = tokenizer(path)
    odd = [i for i, w in enumerate(words) if "<|" in w]
    own = {i: t.encode(words[i], add_special_tokens=False).ids for i in odd}
    for i in odd:
        words[i] = "a"
    flat, size = [], []
    for a in range(0, len(words), 1000):
        part = words[a : a + 1000]
        ids = np.array(t.encode_batch_fast([CUT.join(part) + CUT], add_special_tokens=False)[0].ids, dtype=np.uint32)
        cuts = np.flatnonzero(ids == CUT_ID)
        assert len(cuts) == len(part)
        flat.append(np.delete(ids, cuts))
        size.append(np.diff(cuts, prepend=-1) - 1)
    flat, size = np.concatenate([*flat, np.empty(0, np.uint32)]), np.concatenate([*size, np.empty(0, np.int64)])
    for i, ids in own.items():  # texts that spell special tokens
        at = int(size[:i].sum())
        flat = np.concatenate([flat[:at], np.array(ids, np.uint32), flat[at + int(size[i]) :]])
        size[i] = len(ids)
    return flat, size


class _Known:
    """Ids of words that a worker has met, up to ``most`` of them; later ones are encoded each time."""

    def __init__(self, path: str | None, most: int = 300_000):
        self.path, self.most, self.at, self.flat, self.size = path, most, {}, np.empty(0, np.uint32), np.empty(0, np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """flat, first and size: word k has flat[first[k] : first[k] + size[k]]."""
        at = np.fromiter((self.at.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0)
        fresh = [words[i] for i in new.tolist()]
        keep = max(0, min(len(fresh), self.most - len(self.size)))
        flat, size = _encode_words(list(fresh), self.path)
        old = len(self.size)
        at[new] = old + np.arange(len(new))
        flat, size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        first = np.cumsum(size) - size
        self.at.update(zip(fresh[:keep], range(old, old + keep)))
        self.size = size[: old + keep]
        self.flat = flat[: int(self.size.sum())]
        return flat, first[at], size[at]


@lru_cache(maxsize=2)
def _known(path: str | None) -> _Known:
    return _Known(path)


def token_ids(texts: pa.Array, path: str | None = None, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts one after the other, and how many each text has.

    The tokenizer drops white space and never joins across it, so each distinct
    word (lower-cased, without a last full stop or comma) is encoded once and
    its ids are spread over the places it stands in.
    """
    w = common.Words(texts)
    vocab = w.vocab
    plain = pc.match_substring_regex(vocab, PLAIN)
    low = pc.if_else(plain, pc.utf8_lower(vocab), vocab)
    tail = pc.and_(plain, pc.match_substring_regex(low, "[.,]$"))
    enc = pc.if_else(tail, pc.utf8_slice_codeunits(low, 0, -1), low).dictionary_encode()
    last = np.where(np.asarray(tail), np.where(np.asarray(pc.ends_with(low, ".")), 1, 2), 0)
    k = len(enc.dictionary)
    flat, first, size = _known(path).encode([*enc.dictionary.to_pylist(), ".", ","])
    core = np.asarray(enc.indices)
    # Each vocabulary entry is its core and perhaps a mark; a last entry is the end of a text.
    parts = np.column_stack([core, k - 1 + last]).ravel()
    parts = parts[np.column_stack([np.ones(len(core), bool), last > 0]).ravel()]
    size_v = size[core] + np.where(last > 0, size[np.maximum(k - 1 + last, 0)], 0)
    flat = _spread(flat, first, size, parts)
    words, row = w.ids, w.row
    if end is not None:
        flat, size_v = np.append(flat, np.uint32(end)), np.append(size_v, 1)
        places = w.start + w.count
        words, row = np.insert(words, places, len(size_v) - 1), np.insert(row, places, np.arange(w.n))
    ids = _spread(flat, np.cumsum(size_v) - size_v, size_v, words)
    return ids, np.bincount(row, weights=size_v[words], minlength=w.n).astype(np.int64)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; with_ids adds their ids."""
    common.small_batches(docs.sparkSession)
    schema = PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECES

    def run(batches):
        for b in common.chunks(batches, most=2 * common.CHUNK_BYTES):
            ids, count = token_ids(b.column("text"), path)
            n = -(-count // capacity)
            row = np.repeat(np.arange(b.num_rows), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, count[row] - start)
            at = (np.cumsum(count) - count)[row] + start
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())]
            more = [pa.ListArray.from_arrays(np.append(at, len(ids)).astype(np.int32), ids.astype(np.int32))] if with_ids else []
            yield common.batch(schema, b.column("doc_id").take(pa.array(row)), piece.astype(np.int32), start, length, crc, *more)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES_DDL + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of item numbers. A big integer's set bits say which amounts of room some bin has."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    have = 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        above = have >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                have ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        if r > n:
            room[r - n].append(b)
            have |= 1 << (r - n)
    return bins


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Bins that any packing needs: for each limit, of pieces that large ones leave no room for, and of the rest by volume."""
    n = np.bincount(np.array(lengths, np.int64), minlength=capacity + 1)
    count, volume = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    k = np.arange(capacity // 2 + 1)  # pieces shorter than k do not count
    above = lambda c, x: c[-1] - c[x]
    alone = above(count, capacity - k)
    halves = above(count, np.full(len(k), capacity // 2)) - alone
    room = halves * capacity - (above(volume, np.full(len(k), capacity // 2)) - above(volume, capacity - k))
    small = volume[capacity // 2] - np.where(k > 0, volume[np.maximum(k - 1, 0)], 0)
    return int((alone + halves + np.maximum(0, -(-(small - room) // capacity))).max()) if len(lengths) else 0


def _highest(bits: int, low: int, high: int) -> int:
    """The highest number in (low, high] whose bit is set; low if there is none."""
    x = bits & ((2 << high) - 1)
    return max(low, x.bit_length() - 1)


class _Search:
    """Bins under local search. pool has, by length, the pieces of the underfull bins, and full those of full ones; have a bit for each length in pool."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.of = {i: k for k, b in enumerate(bins) for i in b}
        self.pool: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.full: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.have = 0
        self.live = len(bins)
        for b, f in zip(bins, self.fill):
            if f < capacity:
                self._put(b)
            else:
                for i in b:
                    self.full[lengths[i]].add(i)

    def underfull(self) -> list[int]:
        return sorted((k for k, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda k: -self.fill[k])

    def _put(self, items) -> None:
        for i in items:
            n = self.lengths[i]
            self.pool[n].add(i)
            self.have |= 1 << n

    def _take(self, items) -> None:
        for i in items:
            n = self.lengths[i]
            self.pool[n].discard(i)
            if not self.pool[n]:
                self.have &= ~(1 << n)

    def sums(self) -> int:
        """A bit for each sum of two lengths in the pool, up to twice the capacity."""
        out, rest = 0, self.have
        while rest:
            n = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            out |= (self.have if len(self.pool[n]) > 1 else self.have & ~(1 << n)) << n
        return out

    def _partner(self, n: int, most: int) -> int | None:
        """A piece of length n in the emptiest bin, if that has less than most."""
        got = min(self.pool[n], key=lambda i: self.fill[self.of[i]], default=None)
        return got if got is not None and self.fill[self.of[got]] < most else None

    def _two(self, total: int, most: int) -> tuple[int, int] | None:
        """Two pieces of the pool that are of one bin and add up to total."""
        x = self.have & ((1 << total) - 1)
        y = x
        while y:
            n = (y & -y).bit_length() - 1
            y &= y - 1
            if 2 * n > total:
                break
            if x >> (total - n) & 1:
                bins = {self.of[i]: i for i in self.pool[n]}
                for j in self.pool[total - n]:
                    i = bins.get(self.of[j])
                    if i is not None and i != j and self.fill[self.of[j]] < most:
                        return i, j
        return None

    def raise_(self, b: int, sums: int) -> bool:
        """Moves and exchanges that fill bin b from other underfull bins, the most filling first."""
        L, cap, changed = self.lengths, self.capacity, False
        self._take(self.bins[b])
        while 0 < self.fill[b] < cap and self.have:
            gap, best, step = cap - self.fill[b], 0, None

            def offer(gain: int, pieces, back) -> bool:
                nonlocal best, step
                if gain > best:
                    best, step = gain, (pieces, back)
                return best == gap

            own: dict[int, int] = {}
            twice: dict[int, int] = {}
            for i in self.bins[b]:
                if L[i] in own:
                    twice[L[i]] = own[L[i]]
                own[L[i]] = i
            most = lambda gain: self.fill[b] + gain

            def one(c: int, back: list[int]) -> bool:
                """A piece for those of back, of length c in all."""
                n = min(cap, c + gap)
                while (n := _highest(self.have, c + best, n)) > c + best:
                    i = self._partner(n, most(n - c))
                    if i is not None:
                        return offer(n - c, [i], back)
                    n -= 1
                return False

            done = one(0, [])
            if not done:  # one for one
                for c, i in own.items():
                    if one(c, [i]):
                        done = True
                        break
            if not done:  # one for two of b
                for c, i in own.items():
                    for c2, j in (*((d, j) for d, j in own.items() if d < c), *([(c, twice[c])] if c in twice else [])):
                        if c + c2 + best < cap and one(c + c2, [i, j]):
                            done = True
                            break
                    if done:
                        break
            if not done:  # two for one of b
                for c, i in own.items():
                    n = c + gap
                    while (n := _highest(sums, c + best, n)) > c + best:
                        two = self._two(n, most(n - c))
                        if two:
                            done = offer(n - c, list(two), [i])
                            break
                        n -= 1
                    if done:
                        break
            if step is None:
                break
            self.swap(b, *step)
            changed = True
        self._place(b)
        return changed

    def _place(self, b: int) -> None:
        """Bin b's pieces, which are nowhere, come to the pool or to full."""
        if self.fill[b] < self.capacity:
            self._put(self.bins[b])
        else:
            for i in self.bins[b]:
                self.full[self.lengths[i]].add(i)

    def swap(self, b: int, pieces: list[int], back: list[int]) -> None:
        """Pieces of one other bin come to b, which gives it those of back. b's pieces are not in the pool."""
        a = self.of[pieces[0]]
        full = self.fill[a] == self.capacity
        if full:
            for i in self.bins[a]:
                self.full[self.lengths[i]].discard(i)
        else:
            self._take(pieces)
        for i in pieces:
            self.bins[a].remove(i)
            self.of[i] = b
        for i in back:
            self.bins[b].remove(i)
            self.of[i] = a
        self.bins[b] += pieces
        self.bins[a] += back
        gain = sum(self.lengths[i] for i in pieces) - sum(self.lengths[i] for i in back)
        self.fill[b] += gain
        self.fill[a] -= gain
        self._put(self.bins[a] if full else back)
        self.live -= not self.bins[a]

    def shake(self, b: int, r: random.Random) -> int | None:
        """Bin b is filled by one or two pieces of a full bin, for one or two of its own, and that bin gets b's room: which one it is."""
        L, gap = self.lengths, self.capacity - self.fill[b]
        own = self.bins[b]
        ways = [(i, n) for i in own if (n := L[i] + gap) <= self.capacity and self.full[n]]
        step = None
        if ways and r.random() < 0.5:
            i, n = r.choice(ways)
            step = [next(iter(self.full[n])) if len(self.full[n]) == 1 else r.choice(sorted(self.full[n]))], [i]
        for _ in range(40):
            if step:
                break
            a = r.randrange(len(self.bins))
            if self.fill[a] != self.capacity or a == b:
                continue
            theirs = {L[j]: j for j in self.bins[a]}
            options = []
            for x, i in enumerate(own):
                for n, j in theirs.items():
                    k = theirs.get(L[i] + gap - n)
                    if k is not None and k != j:
                        options.append(([j, k], [i]))
                options += [([theirs[n]], [i, k]) for k in own[x + 1 :] if (n := L[i] + L[k] + gap) in theirs]
            step = r.choice(options) if options else None
        if not step and ways:
            i, n = r.choice(ways)
            step = [next(iter(self.full[n]))], [i]
        if not step:
            return None
        a = self.of[step[0][0]]
        self._take(own)
        self.swap(b, *step)
        self._place(b)
        return a


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, patience: int = 20_000) -> list[list[int]]:
    """Moves and exchanges between underfull bins, each of which raises the sum of squared fills, until the lower bound; see the module.

    patience: how many changes with full bins may follow without any gain before the search ends, by the eighth of the number of underfull bins fewer.
    """
    least = lower_bound(lengths, capacity)
    if len(bins) <= least:
        return bins
    x, r = _Search(bins, lengths, capacity), random.Random(len(lengths))
    changed = True
    while changed and x.live > least:
        changed, sums = False, x.sums()
        for b in x.underfull():
            if 0 < x.fill[b] < capacity:
                changed |= x.raise_(b, sums)
    failed, open_, turn, sums = 0, x.underfull(), 0, x.sums()
    while x.live > least and open_ and failed <= patience // (1 + len(open_) // 8) + len(open_) // 2:
        if turn >= len(open_):
            turn, sums, open_ = 0, x.sums(), x.underfull()
            if any([x.raise_(b, sums) for b in open_ if 0 < x.fill[b] < capacity]):
                failed, open_ = 0, x.underfull()
            r.shuffle(open_)
            continue
        b = open_[turn]
        if not 0 < x.fill[b] < capacity:  # filled or emptied meanwhile
            open_[turn] = open_[-1]
            open_.pop()
            continue
        a = x.shake(b, r)
        if a is not None:
            open_[turn] = a
        failed = 0 if a is not None and x.raise_(a, sums) else failed + 1
        turn += 1
    return [b for b in x.bins if b]


def pack(items: DataFrame, n_items: int, capacity: int = CAPACITY, block: int = 65_536) -> DataFrame:
    """items(..., length) with sequence_id and offset. n_items: about how many there are; it sets the number of blocks only."""
    parts = max(1, -(-n_items // block))
    names = items.columns

    def run(batches):
        pid = TaskContext.get().partitionId()
        number, held, size = 0, [], 0

        def flush():
            nonlocal number
            t = pa.Table.from_batches(held).combine_chunks()
            lengths = t.column("length").to_pylist()
            seq, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for b in local_search(best_fit(lengths, capacity), lengths, capacity):
                at = 0
                for i in b:
                    seq[i], offset[i] = pid + number * parts, at
                    at += lengths[i]
                number += 1
            t = t.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))
            yield from t.to_batches()

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= 2 * block:  # more rows than n_items promised
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    ddl = ", ".join(f"`{n}` {t}" for n, t in items.dtypes) + ", sequence_id long, offset long"
    assert "sequence_id" not in names and "offset" not in names
    return items.repartition(parts).mapInArrow(run, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    return pack(pieces(docs), docs.count())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs), docs.count())
