"""Operator 10: unbounded n-gram scoring, from the longest context of every token that the corpus has.

A sharded suffix array that is asked about every token by every text would be
quadratic when all texts are scored. Here shards are ranges of suffix keys:
strings of tokens travel as fingerprints, distinct in a chunk of texts with
their counts, to the one sorted shard that can have them, and a binary search
there gives their count in the whole corpus.

Which strings have to be asked is what a suffix tree would branch at:

1. All strings of 1-3 tokens are counted. Runs of 3-grams that other places
   share bound every longer match.
2. Inside them windows of n = 4, 8, 32, 128, ... tokens and of n + 1 are counted.
   They tell for each window whether its occurrences differ in the token before
   it (it is a start) or after it (it is an end). Both are properties of the
   string, so all its occurrences agree on them.
3. The longest context of a token begins at a start (what has it elsewhere
   differs just before, else it would be longer), and a string's count stays
   the same up to the next end. So strings from a start to an end, with lengths
   from n up to the next window size, are all that is counted: a passage in a
   thousand texts is a string or two in each. All occurrences of a string count, but
   a text asks for the counts of those only that may be longest contexts of its tokens:
   not where another training place has the next window size too.
4. The longest context of a token is found by binary search over the starts
   before it (counts fall with length). It is exact at every length.

The probability of a token: p_0 is the base model's; for n = 1, 2, 3
p_n = (count(context w) + weight_n * p_(n-1)) / (count(context) + weight_n), and then the
same from the longest context alone, if it has 4 tokens or more. The counts of contexts
are those of all other places of the training part: a training text's own place is
taken out, or each would only find itself.

Counts cover every training document. The answers for a file split are written
to the shared checkpoint folder, where the task that reads that split finds
them; a checksum of the keys guards against a split that changed in between. With
the answers come notes that a pass left for the next about the same texts (which
3-grams are shared; the windows with their starts and ends), so they are looked up once.

Defined results: null and empty text is the end token alone; a null doc_id is
held out; repeated rows train as often as they come; without training documents
N and V are 0. Fingerprints have 54 bits (64 from 2^24 documents on): a false
match of a key needs a collision.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHORT = (1, 2, 3)
#: Smoothing by context length, and of longest contexts by their least length; chosen on held-out documents of the sample tables.
WEIGHT = {1: 2000.0, 2: 200.0, 3: 3.0}
LONG_WEIGHT = ((4, 1.0), (8, 0.2), (16, 0.1), (64, 0.03))
B = 0x9E3779B97F4A7C15 | 1
#: Levels of answers: lengths of windows, and this one for strings from starts to ends.
SPANS = 0


def next_window(n: int) -> int:
    return 8 if n == 4 else 4 * n


def windows(most: int) -> list[int]:
    """4, 8, 32, 128, ... up to most."""
    out, n = [], 4
    while n <= most:
        out.append(n)
        n = next_window(n)
    return out


def kinds(level: int, answer: bool = False) -> int:
    """How many counts a key of a level has. Lengths 1 and 2: of training places; 3 and windows: and of others; windows and the token before: of all places together. SPANS: of training places, and when sent, whether it is asked."""
    return 1 + (level in (SPANS, 3) or level > 3 and level % 2 == 0) - (answer and level == SPANS)


def by_level(parts: np.ndarray, raw: bytes, answer: bool = False) -> list[list[np.ndarray]]:
    """For each level of a row, its counts of each kind."""
    sizes = [(kinds(level, answer), n) for level, n, _ in parts.tolist()]
    flat = unpack(raw, sum(k * n for k, n in sizes)).view(np.int64)
    out, at = [[] for _ in sizes], 0
    for kind in range(2):
        for own, (k, n) in zip(out, sizes):
            if k > kind:
                own.append(flat[at : at + n])
                at += n
    return out


def checksum(keys: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(keys) >> 1


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers by byte planes, as many as they need, compressed."""
    x = x.astype("<u8")
    k = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :k].T)
    return bytes([k]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, n: int) -> np.ndarray:
    k = raw[0]
    planes = np.frombuffer(pa.decompress(memoryview(raw)[1:], k * n, codec="zstd"), np.uint8).reshape(k, n)
    if k == 1:
        return planes[0].astype("<u8")
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = planes.T
    return out.view("<u8").reshape(-1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(B, -1, 1 << 64)
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, v, np.uint64))]) for v in (B, inverse))


class Tokens:
    """Lower-cased words and an end of each text of a chunk; key(n, at) is the fingerprint of the n tokens that end at places."""

    def __init__(self, texts: pa.Array, doc_ids: pa.Array, bits: int):
        w = common.Words(texts)
        h = np.append(common.word_hashes(pc.ascii_lower(w.vocab)), np.uint64(0x1234567890ABCDEF))
        self.h, self.count = h, w.count + 1
        self.start = np.cumsum(self.count) - self.count
        self.n, self.bits = len(w.ids) + w.n, np.uint64(64 - bits)
        self.ids = ids = np.full(self.n, len(h) - 1, np.int32)
        ids[np.arange(len(w.ids)) + w.row] = w.ids
        self.row = np.repeat(np.arange(w.n, dtype=np.int32), self.count)
        self.before = np.arange(self.n) - np.repeat(self.start, self.count)  # tokens before it in its text
        size = 1 << max(16, (self.n).bit_length())
        up, self.down = _powers(size)
        self.sum = np.zeros(self.n + 1, np.uint64)
        np.cumsum(h[ids] * up[: self.n], out=self.sum[1:])
        crc = [None if i is None else zlib.crc32(str(i).encode()) for i in doc_ids.to_pylist()]
        self.train_row = np.array([c is not None and c % 10 != 0 for c in crc], dtype=bool)
        self.train = self.train_row[self.row]

    def key(self, n: int, at: np.ndarray) -> np.ndarray:
        return common.mix((self.sum[at + 1] - self.sum[at + 1 - n]) * self.down[at] + np.uint64(n * int(common.MULT[7]) % (1 << 64))) >> self.bits

    def span(self, s: np.ndarray, e: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the tokens from places s up to before e, as strings of the level of windows of n tokens."""
        return common.mix((self.sum[e] - self.sum[s]) * self.down[e - 1] + (e - s).astype(np.uint64) * common.MULT[7] + np.uint64(n * int(common.MULT[8]) % (1 << 64))) >> self.bits

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary entries in use and their fingerprints: key(1, at) by word instead of by place."""
        used = np.flatnonzero(np.bincount(self.ids, minlength=len(self.h)))
        return used, common.mix(self.h[used] + np.uint64(int(common.MULT[7]) % (1 << 64))) >> self.bits

    def places(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.before >= n - 1)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys; how many places have each."""
    keys = np.sort(keys)
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[cut], np.diff(np.append(cut, len(keys)))


def _distinct(keys: np.ndarray, train: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys; how many training and other places have each."""
    if bits < 64:
        s = np.sort(keys << np.uint64(1) | train.astype(np.uint64))
        k, t = s >> np.uint64(1), (s & np.uint64(1)).astype(np.int64)
    else:
        o = np.argsort(keys)
        k, t = keys[o], train[o].astype(np.int64)
    return _grouped(k, t, None)


def _grouped(k: np.ndarray, t: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _distinct, of ascending keys that stand for n places each (None: one), t of them in training."""
    if not len(k):
        return k, t, t
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    c = np.add.reduceat(t, cut)
    every = np.diff(np.append(cut, len(k))) if n is None else np.add.reduceat(n, cut)
    return k[cut], c, every - c


def _distinct_words(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    used, keys = t.words()
    o = np.argsort(keys)
    all_, train = np.bincount(t.ids, minlength=len(t.h))[used], np.bincount(t.ids[t.train], minlength=len(t.h))[used]
    return _grouped(keys[o], train[o], all_[o])


NOTE = pa.list_(pa.binary())
SENT = "shard int, split string, ord int, parts binary, keys binary, counts binary, note array<binary>"
SENT_SCHEMA = pa.schema([("shard", pa.int32()), ("split", pa.string()), ("ord", pa.int32()), ("parts", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("note", NOTE)])


def _send(counted: list[tuple[int, tuple[np.ndarray, ...]]], split: str, ord_: int, shards: int, bits: int, note: list[bytes] | None = None, crc: int | None = None) -> pa.RecordBatch:
    """A row for each shard with a chunk's keys of all levels there, else rows would be mostly overhead. parts: (level, keys of it in the row, checksum of the chunk's keys of it that are asked). Counts are those of kinds(). Keys of under 64 bits have the number of their level before them. The note is in the row of one shard, which depends on the chunk."""
    cuts = np.array([np.searchsorted((k >> np.uint64(bits - 20)) * np.uint64(shards) >> np.uint64(20), np.arange(shards + 1)) for _, (k, *_) in counted])
    parts = np.array([(level, 0, checksum(k) if crc is None else crc) for level, (k, *_) in counted], np.int64)
    keys = [k | np.uint64(j << bits) if bits < 64 else k for j, (_, (k, *_)) in enumerate(counted)]
    rows, noted = [], zlib.crc32(f"{split} {ord_}".encode()) % shards if note is not None else -1
    for s in range(shards):
        at = [slice(a, e) for a, e in cuts[:, s : s + 2].tolist()]
        parts[:, 1] = cuts[:, s + 1] - cuts[:, s]
        if s == noted or parts[:, 1].any():
            own = np.concatenate([k[i] for k, i in zip(keys, at)])
            rows.append((s, split, ord_, parts.tobytes(), pack(np.diff(own, prepend=np.uint64(0))), pack(np.concatenate([c[kind][i] for kind in (1, 2) for (_, c), i in zip(counted, at) if len(c) > kind])), note if s == noted else None))
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows) if rows else [[]] * len(SENT_SCHEMA), SENT_SCHEMA)], schema=SENT_SCHEMA)


def positions(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each of the keys, all of which it has, stands in an ascending table of distinct random keys: found by the highest bits in which they differ."""
    if not len(keys):
        return np.empty(0, np.int64)
    least = table[0]
    high = np.uint64(max(0, int(table[-1] - least).bit_length() - len(table).bit_length() - 1))
    own = np.bincount(((table - least) >> high).view(np.int64))
    at = (np.cumsum(own) - own)[((keys - least) >> high).view(np.int64)]
    off = np.flatnonzero(table[at] != keys)
    while len(off):
        at[off] += 1
        off = off[table[at[off]] != keys[off]]
    return at


def _answer(t: pa.Table) -> pa.Table:
    """One shard: the total counts of each key that a chunk sent, in its order (training places, then others; of strings from starts to ends those asked, training places only), and of all words (N, V) of the training part."""
    shard = t.column("shard")[0].as_py()
    parts = [np.frombuffer(r, np.int64).reshape(-1, 3) for r in t.column("parts").to_pylist()]
    ends = [np.cumsum(x[:, 1]).tolist() for x in parts]
    keys = [np.cumsum(unpack(r.as_py(), e[-1]), dtype=np.uint64) for r, e in zip(t.column("keys"), ends)]
    counts = [by_level(x, r.as_py()) for r, x in zip(t.column("counts"), parts)]
    stats = None
    for j in range(max(map(len, parts))):  # a level at a time: tables stay small
        of = [(i, slice(e[j] - int(x[j, 1]), e[j])) for i, (x, e) in enumerate(zip(parts, ends)) if j < len(x) and x[j, 1]]
        if not of:
            continue
        own = np.concatenate([keys[i][a] for i, a in of])
        level, table = parts[of[0][0]][j, 0], common.distinct(own)
        at = positions(table, own)
        del own
        for kind in range(kinds(level, True)):
            total, done = np.bincount(at, np.concatenate([counts[i][j][kind] for i, _ in of])).astype(np.int64), 0  # exact below 2^53
            if level == 1:
                stats = int(total.sum()), int((total > 0).sum())
            total = total[at]
            for i, a in of:
                counts[i][j][kind] = total[done : done + a.stop - a.start]
                done += a.stop - a.start
        if level == SPANS:
            for i, _ in of:
                on = np.flatnonzero(counts[i][j].pop())
                parts[i] = parts[i].copy()
                parts[i][j, 1], counts[i][j] = len(on), [counts[i][j][0][on]]
    counts = [np.concatenate([c[kind] for kind in range(2) for c in own if len(c) > kind]) for own in counts]
    out = [[split, o, shard, x.tobytes(), pack(c), 0, 0, note] for split, o, x, c, note in zip(t.column("split").to_pylist(), t.column("ord").to_pylist(), parts, counts, t.column("note").to_pylist())]
    if stats:
        out.append(["stats", 0, shard, b"", b"", *stats, None])
    names = [x.split()[0] for x in REPLY.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), NOTE]
    return pa.Table.from_arrays([pa.array(v, ty) for v, ty in zip(zip(*out), types)], names=names)


REPLY = "split string, ord int, shard int, parts binary, data binary, total long, kinds long, note array<binary>"


class Replies:
    """Answers for one split, from the folder that answers were written to; a chunk's are read when it is its turn."""

    def __init__(self, path: str, split: str):
        fs, base = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        folder = f"{base}/split={split}"
        self.data = pads.dataset(folder, filesystem=fs, format="parquet") if fs.get_file_info(folder).type != pafs.FileType.NotFound else None
        self.ord, self.parts, self.own = -1, {}, None

    def _rows(self, ord_: int) -> list[dict]:
        return self.data.to_table(columns=["shard", "parts", "data", "note"], filter=pads.field("ord") == ord_).to_pylist() if self.data is not None else []

    def _read(self, ord_: int) -> None:
        if ord_ != self.ord:
            self.ord, self.parts, self.own = ord_, {}, None
            found: dict[tuple[int, int], list] = {}
            for r in sorted(self._rows(ord_), key=lambda r: r["shard"]):
                parts = np.frombuffer(r["parts"], np.int64).reshape(-1, 3)
                self.own = self.own or r["note"]
                for (level, _, crc), c in zip(parts.tolist(), by_level(parts, r["data"], True)):
                    found.setdefault((level, crc), []).append(c)
            for (level, crc), c in found.items():
                self.parts.setdefault(level, []).append((crc, [np.concatenate(v) for v in zip(*c)]))

    def note(self, ord_: int) -> list[bytes]:
        """What the pass that sent the keys left for this one; nothing where it sent none."""
        self._read(ord_)
        return self.own or []

    def of(self, ord_: int, level: int, keys: np.ndarray) -> list[np.ndarray]:
        """The counts of each of the keys that were sent (or asked), of each kind."""
        self._read(ord_)
        table = common.distinct(keys)
        got = self.parts.get(level) or [(checksum(np.empty(0, np.uint64)), [np.empty(0, np.int64)] * kinds(level, True))]
        if [(crc, len(c[0])) for crc, c in got] != [(checksum(table), len(table))]:
            raise RuntimeError("a file split changed between the passes")
        at = positions(table, keys)
        return [c[at] for c in got[0][1]]


def _chunks(batches, bits: int):
    """(split, ordinal in the split, batch, tokens) of the texts, in the order in which a split has them."""
    split, ord_ = None, 0
    for big in batches:
        names = big.column("_file").to_pylist()
        starts = big.column("_start").to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or starts[i] != starts[i - 1]), len(names)]
        for a, e in zip(cuts, cuts[1:]):
            if a == e:
                continue
            own = f"{xxhash.xxh64_hexdigest(names[a])}-{starts[a]}"
            if own != split:
                split, ord_ = own, 0
            part = big.slice(a, e - a)
            size = np.asarray(pc.fill_null(pc.binary_length(part.column("text")), 0), dtype=np.int64) + 64
            pieces = -(-int(size.sum()) // (3 * common.CHUNK_BYTES // 2))
            for b in common.chunks([part], most=int(size.sum()) // pieces + int(size.max())):  # alike, else the last is small
                yield split, ord_, b, Tokens(b.column("text"), b.column("doc_id"), bits)
                ord_ += 1


def bits_of(*masks: np.ndarray) -> bytes:
    return pa.compress(np.packbits(np.concatenate(masks)).tobytes(), codec="zstd", asbytes=True)


def masks_of(raw: bytes, *sizes: int) -> list[np.ndarray]:
    n = sum(sizes)
    flat = np.unpackbits(np.frombuffer(pa.decompress(raw, -(-n // 8), codec="zstd"), np.uint8), count=n).view(bool)
    return np.split(flat, np.cumsum(sizes)[:-1])


def counts(t: Tokens, short: Replies, ord_: int, n: int) -> list[np.ndarray]:
    """The counts of the strings of n tokens that end at each place, n at most 3 (0 where there is none)."""
    if n == 1:
        used, keys = t.words()
        of_word = np.zeros(len(t.h), np.int64)
        of_word[used] = short.of(ord_, 1, keys)[0]
        return [of_word[t.ids]]
    at = t.places(n)
    got = short.of(ord_, n, t.key(n, at))
    out = np.zeros((len(got), t.n), np.int64)
    out[:, at] = got
    return list(out)


def shared(t: Tokens, train: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Whether a string at each place is of use: a training place's, if any other place has it; another's, if a training place has it."""
    return np.where(t.train, train + rest >= 2, train >= 1)


def runs(ok: np.ndarray) -> np.ndarray:
    """How many places up to each, itself included, are ok without a gap."""
    at = np.arange(len(ok))
    return at - np.maximum.accumulate(np.where(ok, -1, at)) if len(ok) else at


def asked(t: Tokens, run: np.ndarray, n: int, among: np.ndarray | None = None) -> np.ndarray:
    """The places where strings of n tokens end that may occur elsewhere, by the run of shared 3-grams that ends at each. among: those of a lesser n."""
    if among is None:
        return np.flatnonzero((t.before >= n - 1) & (run >= n - 2))
    return among[(t.before[among] >= n - 1) & (run[among] >= n - 2)]


def sent_windows(t: Tokens) -> list[int]:
    """Lengths of windows that are counted besides those of 1-3 tokens."""
    most = int(t.before.max()) + 1 if t.n else 0
    return sorted({m for n in windows(most) for m in (n, n + 1)})


class Level:
    """Windows of n tokens of a chunk that are shared: at (the places where they end), train (training places that have each), starts and ends (masks), and the strings between them that may be contexts."""

    def __init__(self, t: Tokens, n: int, at: np.ndarray, train: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.n, self.next = n, next_window(n)
        self.at, self.train, self.is_start, self.is_end = at, train, starts, ends
        self.others = train > t.train[at]  # whether another training place has each

    def needed(self, t: Tokens, above: Level | None) -> None:
        """Sets last (numbers of the windows that end before a token whose longest context begins at a start of this level), own (whether they are of the training part), end (the next end of each), lo and hi (the starts that come into question), turn (whether it is an end that another window follows), and for each end the range of starts of its strings. above: the next level; its windows are longer contexts."""
        at, n, m = self.at, self.n, len(self.at)
        cut = self.cut = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1, [m]])  # runs of neighbours without a gap
        self.is_start[cut[:-1]] = self.is_end[cut[1:] - 1] = True  # they are, unless fingerprints collide
        self.starts, self.ends = np.flatnonzero(self.is_start), np.flatnonzero(self.is_end)
        longer = np.zeros(t.n + 1, bool)
        longer[t.start] = longer[t.n] = True  # no token of the same text follows
        longer = longer[1:]
        if above is not None:
            longer[above.at[above.others]] = True
        last = np.flatnonzero(self.others & ~longer[at])
        starts, ends = np.cumsum(self.is_start), np.cumsum(self.is_end)
        run = np.searchsorted(cut, last, side="right")
        least = np.maximum(last - (self.next - 1 - n), cut[run - 1])
        lo, hi = starts[least] - self.is_start[least], starts[last] - 1
        on = lo <= hi
        last, run, self.lo, self.hi = last[on], run[on], lo[on], hi[on]
        self.last, self.end = last, ends[last] - self.is_end[last]
        self.own = t.train[at[last]].astype(np.int64)
        self.turn = self.is_end[last] & (last + 1 < cut[run])
        from_, to = np.zeros(len(self.ends) + 1, np.int64), np.full(len(self.ends) + 1, -1)
        if len(last):
            new = np.concatenate([[True], np.diff(self.end) != 0])
            first, final = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))
            from_[self.end[first]], to[self.end[first]] = self.lo[first], self.hi[final]
            # A string with the token after an end goes on to the next end.
            on = np.flatnonzero(self.turn)
            near = self.lo[on] + (self.starts[self.lo[on]] == self.last[on] - (self.next - 1 - n))  # with a token more it is shorter than the next window size
            on, near = on[near <= self.hi[on]], near[near <= self.hi[on]]
            more = self.end[on] + 1
            from_[more], to[more] = near, np.maximum(to[more], self.hi[on])
        count = to + 1 - from_
        self.size = int(count.sum())
        self.count, self.offset = count, np.cumsum(count) - count - from_

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """From each start, the strings to the ends up to the next window size and to the one after: their first places, and those after their last."""
        before = np.cumsum(self.is_end) - self.is_end  # ends before each window
        far = np.minimum(self.starts + (self.next - 1 - self.n), self.cut[np.searchsorted(self.cut, self.starts, side="right")] - 1)
        lo, size = before[self.starts], before[far] + 1 - before[self.starts]
        ends = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
        return np.repeat(self.at[self.starts] + 1 - self.n, size), (self.at[self.ends] + 1)[ends]

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """As strings, of those to each end from the starts of its range."""
        end = np.repeat(np.arange(len(self.count)), self.count)
        start = self.starts[np.arange(self.size) - self.offset[end]]
        return self.at[start] + 1 - self.n, self.at[self.ends[end]] + 1

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the strings from starts to ends (both as numbers) among those asked."""
        return self.offset[end] + start


def linked(t: Tokens, found: list[Level]) -> list[Level]:
    for level, above in zip(found, [*found[1:], None]):
        level.needed(t, above)
    return found


def levels(t: Tokens, run: np.ndarray, deep: Replies, ord_: int) -> list[Level]:
    """The levels of a chunk that have shared windows, by the counts of windows."""
    found, among = [], None
    for n in windows(int(t.before.max()) + 1 if t.n else 0):
        among = asked(t, run, n, among)
        train, rest = deep.of(ord_, n, t.key(n, among))
        every = train + rest
        wider = np.flatnonzero((t.before[among] >= n) & (run[among] >= n - 1))
        longer = np.ones(len(among), np.int64)  # of the window and the token before it; its own occurrence at least
        longer[wider] = deep.of(ord_, n + 1, t.key(n + 1, among[wider]))[0]
        follow = np.ones(len(among), np.int64)  # of the window and the token after it
        beside = np.flatnonzero(np.diff(among) == 1)
        follow[beside] = longer[beside + 1]
        ok = np.flatnonzero(np.where(t.train[among], every >= 2, train >= 1))
        if not len(ok):
            break
        at, every, row = among[ok], every[ok], t.row[among[ok]]
        found.append(Level(t, n, at, train[ok], (t.before[at] == n - 1) | (longer[ok] < every), (t.before[at] == t.count[row] - 1) | (follow[ok] < every)))
    return linked(t, found)


def note_of(t: Tokens, found: list[Level]) -> list[bytes]:
    """The levels for a later pass: for each, its places; its starts and ends; its counts."""
    out = []
    for x in found:
        at = np.zeros(t.n, bool)
        at[x.at] = True
        out += bits_of(at), bits_of(x.is_start, x.is_end), pack(x.train)
    return out


def noted_levels(t: Tokens, note: list[bytes]) -> list[Level]:
    found, n = [], 4
    for places, sides, train in zip(note[::3], note[1::3], note[2::3]):
        at = np.flatnonzero(masks_of(places, t.n)[0])
        found.append(Level(t, n, at, unpack(train, len(at)).view(np.int64), *masks_of(sides, len(at), len(at))))
        n = next_window(n)
    return linked(t, found)


def noted_3(t: Tokens, ok: bytes, train: bytes) -> np.ndarray:
    """Training places of the 3-grams that end at each place, by a note of which are shared and the counts of these; the others are in their own places only."""
    out = (t.train & (t.before >= 2)).astype(np.int64)
    at = np.flatnonzero(masks_of(ok, t.n)[0])
    out[at] = unpack(train, len(at)).view(np.int64)
    return out


def all_strings(t: Tokens, found: list[Level]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """Ascending keys of all strings, how many training places have each, and whether it is asked; the checksum of those asked. Strings of other texts only, which count for nothing, are left out unless asked."""
    got = [(level.n, *level.strings()) for level in found]
    table = common.distinct(asked_strings(t, found))
    keys, train = _counted(np.concatenate([table, *(t.span(s[on], e[on], n) for n, s, e in got for on in [t.train[s]])]))
    asked = np.zeros(len(keys), np.int64)
    asked[positions(keys, table)] = 1
    return (keys, train - asked, asked), checksum(table)


def asked_strings(t: Tokens, found: list[Level]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(t.span(*level.asked(), level.n) for level in found)])


def longest(t: Tokens, found: list[Level], strings: Replies, ord_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place: the length of the longest context that another training place has (0 where it has fewer than 4 tokens), how many have it, and how many of them go on with the place's token."""
    length, context, both = (np.zeros(t.n, np.int64) for _ in range(3))
    of = strings.of(ord_, SPANS, asked_strings(t, found))[0]
    base, before = 0, np.empty(0, np.int64)
    for x in found:
        if len(before):  # contexts one token short of this window size
            k = np.minimum(np.searchsorted(x.at, before), len(x.at) - 1)
            both[before] = np.where(x.at[k] == before, x.train[k] - t.train[before], 0)
        total = of[base : base + x.size]
        base += x.size
        last, end, own, lo, hi = x.last, x.end, x.own, x.lo.copy(), x.hi.copy()
        wide = np.flatnonzero(lo < hi)
        while len(wide):
            a, e = lo[wide], hi[wide]
            mid = (a + e) // 2
            yes = total[x.of(mid, end[wide])] > own[wide]
            lo[wide], hi[wide] = np.where(yes, a, mid + 1), np.where(yes, mid, e)
            wide = wide[lo[wide] < hi[wide]]
        c = total[x.of(lo, end)] - own
        on = c > 0
        last, end, own, lo, c, turn = (v[on] for v in (last, end, own, lo, c, x.turn))
        at = x.at[last] + 1
        own_length = last - x.starts[lo] + x.n
        # The string that has the place's token as well: the same count before an end.
        goes = np.where(x.is_end[last], 0, c)
        fits = np.flatnonzero(turn & (own_length + 1 < x.next))
        goes[fits] = total[x.of(lo[fits], end[fits] + 1)] - own[fits]
        length[at], context[at], both[at] = own_length, c, goes
        before = at[turn & (own_length + 1 == x.next)]
    return length, context, both


def _stored(rows: DataFrame, base: str, name: str, shards: int) -> str:
    path = f"{base}/{name}"
    answers = rows.groupBy("shard").applyInArrow(_answer, REPLY)
    # A split's answers are one file in the order of its chunks, whose row groups are small enough to read one chunk at a time.
    with common.shuffles_removed(rows.sparkSession):
        answers.repartition(max(1, shards), "split").sortWithinPartitions("split", "ord").write.option("parquet.block.size", 4 << 20).partitionBy("split").parquet(path)
    return path


def fingerprint_bits(n_docs: int) -> int:
    """Bits of the fingerprints; below 64 they leave room for the number of a level."""
    return 54 if n_docs < 1 << 24 else 64


def score(docs: DataFrame, stable: bool = False, shards: int | None = None) -> DataFrame:
    """Scores of docs(doc_id, text). stable: docs is a scan of files with narrow steps only; other inputs are written to the checkpoint folder first."""
    import uuid

    spark = docs.sparkSession
    common.checkpoints(spark)
    common.small_batches(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/lm-{uuid.uuid4().hex}"
    docs = docs.select("doc_id", "text")
    if not stable:
        docs.write.parquet(f"{base}/docs")
        docs = spark.read.parquet(f"{base}/docs")
    n_docs = docs.count()
    bits = fingerprint_bits(n_docs)
    shards = shards or max(8, n_docs // 2000)
    keyed = docs.withColumn("_file", F.input_file_name()).withColumn("_start", F.input_file_block_start())

    def first(batches):
        for split, ord_, _, t in _chunks(batches, bits):
            counted = []
            for n in SHORT:
                at = t.places(n)
                counted.append((n, (_distinct_words(t) if n == 1 else _distinct(t.key(n, at), t.train[at], bits))[: 1 + kinds(n)]))
            yield _send(counted, split, ord_, shards, bits)

    short = _stored(keyed.mapInArrow(first, SENT), base, "short", shards)
    stats = spark.read.schema(REPLY).parquet(short).where("split = 'stats'").agg(F.sum("total"), F.sum("kinds")).first()
    N, V = int(stats[0] or 0), int(stats[1] or 0)

    def second(batches):
        replies, of = None, None
        for split, ord_, _, t in _chunks(batches, bits):
            if split != of:
                replies, of = Replies(short, split), split
            train, rest = counts(t, replies, ord_, 3)
            ok = shared(t, train, rest)
            counted, run, at = [], runs(ok), None
            for n in sent_windows(t):
                at = asked(t, run, n, at)
                if not len(at):
                    break
                counted.append((n, _distinct(t.key(n, at), t.train[at], bits) if kinds(n) == 2 else _counted(t.key(n, at))))
            if counted:
                yield _send(counted, split, ord_, shards, bits, [bits_of(ok), pack(train[ok])])

    deep = _stored(keyed.mapInArrow(second, SENT), base, "deep", shards)

    def third(batches):
        replies = of = None
        for split, ord_, _, t in _chunks(batches, bits):
            if split != of:
                replies, of = Replies(deep, split), split
            if note := replies.note(ord_):
                found = levels(t, runs(masks_of(note[0], t.n)[0]), replies, ord_)
                if found:
                    own, crc = all_strings(t, found)
                    yield _send([(SPANS, own)], split, ord_, shards, bits, note + note_of(t, found), crc)

    spans = _stored(keyed.mapInArrow(third, SENT), base, "spans", shards)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def fourth(batches):
        replies = more = of = None
        for split, ord_, b, t in _chunks(batches, bits):
            if split != of:
                replies, more, of = Replies(short, split), Replies(spans, split), split
            note = more.note(ord_)
            found = noted_levels(t, note[2:])
            own = t.train.astype(np.int64)
            c = {1: counts(t, replies, ord_, 1)[0], 2: counts(t, replies, ord_, 2)[0], 3: noted_3(t, *note[:2]) if note else counts(t, replies, ord_, 3)[0], 4: own.copy()}
            if found:
                c[4][found[0].at] = found[0].train
            base_p = (c[1] + 0.1) / (N + 0.1 * (V + 1))
            p = base_p.copy()
            for n in (1, 2, 3):
                ctx = c[n][:-1] - own[1:]
                at = np.flatnonzero((ctx > 0) & (t.before[1:] >= n))
                ctx, both = ctx[at], (c[n + 1][1:] - own[1:])[at]
                at += 1
                p[at] = (both + WEIGHT[n] * p[at]) / (ctx + WEIGHT[n])
            length, ctx, both = longest(t, found, more, ord_)
            at = np.flatnonzero(length)
            weight = np.select([length[at] >= n for n, _ in LONG_WEIGHT[::-1]], [w for _, w in LONG_WEIGHT[::-1]])
            p[at] = (both[at] + weight * p[at]) / (ctx[at] + weight)
            sums = lambda v: common.sums(v, t.start, t.count)
            yield common.batch(schema, b.column("doc_id"), ~t.train_row, t.count, sums((c[1] > 0).astype(np.int64)), [N] * b.num_rows, sums(np.log10(base_p)), sums(np.log10(p)))

    return keyed.mapInArrow(fourth, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.load(spark, sf_dir, "documents"), stable=True)
