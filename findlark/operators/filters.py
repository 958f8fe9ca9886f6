"""Membership filters over index keys: Bloom, cuckoo and ribbon. None of them ever denies a key that was added."""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import xxhash


def _h(key: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(key, seed)


def _seal(kind: bytes, head: bytes, body: bytes) -> bytes:
    raw = kind + struct.pack("<I", len(head)) + head + body
    return raw + struct.pack("<I", zlib.crc32(raw))


def _open(kind: bytes, data: bytes) -> tuple[bytes, bytes]:
    if len(data) < 12 or data[:4] != kind:
        raise ValueError("not a filter of this kind")
    if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ValueError("the filter's checksum does not match")
    n = struct.unpack("<I", data[4:8])[0]
    return data[8 : 8 + n], data[8 + n : -4]


class Bloom:
    kind = b"FLB1"

    def __init__(self, items: int, bits_per_item: int = 10, hashes: int = 7, seed: int = 0):
        self.m, self.k, self.seed = max(8, items * bits_per_item), max(1, hashes), seed
        self.bits = np.zeros(-(-self.m // 8), np.uint8)

    def _places(self, key: str):
        a, b = _h(key, self.seed), _h(key, self.seed + 1) | 1
        return [(a + i * b) % self.m for i in range(self.k)]

    def add(self, key: str) -> bool:
        for p in self._places(key):
            self.bits[p >> 3] |= 1 << (p & 7)
        return True

    def contains(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))

    def serialize(self) -> bytes:
        return _seal(self.kind, struct.pack("<QIq", self.m, self.k, self.seed), self.bits.tobytes())

    @classmethod
    def load(cls, data: bytes) -> "Bloom":
        head, body = _open(cls.kind, data)
        out = cls(1)
        out.m, out.k, out.seed = struct.unpack("<QIq", head)
        out.bits = np.frombuffer(body, np.uint8).copy()
        return out


class Cuckoo:
    """Buckets of four 16-bit fingerprints; adding a key twice changes nothing; a full filter refuses."""

    kind, WIDE = b"FLC1", 4

    def __init__(self, items: int, kicks: int = 500, seed: int = 0):
        n = 1
        while n * self.WIDE * 0.9 < max(1, items):
            n *= 2
        self.table, self.kicks, self.seed = np.zeros((n, self.WIDE), np.uint16), kicks, seed
        self.random = random.Random(seed)

    def _at(self, key: str) -> tuple[int, int, int]:
        h = _h(key, self.seed)
        f = (h >> 48) or 1
        i = h & (len(self.table) - 1)
        return f, i, self._other(i, f)

    def _other(self, i: int, f: int) -> int:
        return (i ^ (f * 0x5BD1E995)) & (len(self.table) - 1)

    def contains(self, key: str) -> bool:
        f, i, j = self._at(key)
        return bool((self.table[i] == f).any() or (self.table[j] == f).any())

    def add(self, key: str) -> bool:
        if self.contains(key):
            return True
        f, i, j = self._at(key)
        for b in (i, j):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = f
                return True
        before = []
        b = self.random.choice((i, j))
        for _ in range(self.kicks):
            s = self.random.randrange(self.WIDE)
            before.append((b, s, int(self.table[b, s])))
            f, self.table[b, s] = int(self.table[b, s]), f
            b = self._other(b, f)
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = f
                return True
        for b, s, old in reversed(before):  # nothing that was in is lost
            self.table[b, s] = old
        return False

    def serialize(self) -> bytes:
        return _seal(self.kind, struct.pack("<QIq", len(self.table), self.kicks, self.seed), self.table.tobytes())

    @classmethod
    def load(cls, data: bytes) -> "Cuckoo":
        head, body = _open(cls.kind, data)
        n, kicks, seed = struct.unpack("<QIq", head)
        out = cls(1, kicks, seed)
        out.table = np.frombuffer(body, np.uint16).reshape(n, cls.WIDE).copy()
        return out


class NotSolvable(RuntimeError):
    """The ribbon's equations have no solution under this seed."""


class Ribbon:
    """A static filter: each key is an equation over ``width`` neighbouring 16-bit cells, solved by elimination over GF(2)."""

    kind, MOST = b"FLR1", 32 << 20

    def __init__(self, items: int, extra: int = 64, width: int = 32, seed: int = 0):
        if not 1 <= width <= 32:
            raise ValueError("a ribbon is 1 to 32 cells wide")
        extra = max(extra, items // 4)  # 32-cell rows need some slack as keys grow in number
        self.n = max(1, items + extra)
        if self.n + width > self.MOST:
            raise ValueError("the ribbon has too many cells")
        self.width, self.seed, self.cells, self.retries = width, seed, None, 0

    @property
    def ready(self) -> bool:
        return self.cells is not None

    def _row(self, key: str) -> tuple[int, int, int]:
        h = _h(key, self.seed)
        g = _h(key, self.seed ^ 0x5555)
        return h % self.n, (g & ((1 << self.width) - 1)) | 1, g >> 48

    def build(self, keys: Iterable[str]) -> "Ribbon":
        rows: dict[int, tuple[int, int]] = {}
        for key in dict.fromkeys(keys):
            start, coefficients, value = self._row(key)
            while True:
                if start not in rows:
                    rows[start] = coefficients, value
                    break
                c, v = rows[start]
                coefficients, value = coefficients ^ c, value ^ v
                if not coefficients:
                    if value:
                        raise NotSolvable
                    break
                shift = (coefficients & -coefficients).bit_length() - 1
                coefficients >>= shift
                start += shift
        cells = np.zeros(self.n + 2 * self.width, np.uint16)
        for start in sorted(rows, reverse=True):
            c, v = rows[start]
            for i in range(1, self.width):
                if c >> i & 1:
                    v ^= int(cells[start + i])
            cells[start] = v
        self.cells = cells
        return self

    def build_with_retries(self, keys: Iterable[str], attempts: int = 8) -> "Ribbon":
        keys, seed = list(keys), self.seed
        for self.retries in range(max(1, attempts)):
            self.seed = seed + self.retries
            try:
                return self.build(keys)
            except NotSolvable:
                continue
        raise NotSolvable(f"no solution in {attempts} attempts")

    def contains(self, key: str) -> bool:
        if self.cells is None:
            return True
        start, coefficients, value = self._row(key)
        got = 0
        for i in range(self.width):
            if coefficients >> i & 1:
                got ^= int(self.cells[start + i])
        return got == value

    def serialize(self) -> bytes:
        if self.cells is None:
            raise ValueError("the ribbon is not built")
        return _seal(self.kind, struct.pack("<QIq", self.n, self.width, self.seed), self.cells.tobytes())

    @classmethod
    def load(cls, data: bytes) -> "Ribbon":
        head, body = _open(cls.kind, data)
        out = cls(1)
        out.n, out.width, out.seed = struct.unpack("<QIq", head)
        out.cells = np.frombuffer(body, np.uint16).copy()
        return out


class Buffered:
    """Takes keys one at a time for a static filter; says maybe to everything until build()."""

    def __init__(self, make, attempts: int = 8):
        self.make, self.attempts, self.keys, self.built = make, attempts, [], None

    def add(self, key: str) -> bool:
        self.keys.append(key)
        self.built = None
        return True

    def build(self) -> None:
        self.built = self.make(len(set(self.keys))).build_with_retries(self.keys, self.attempts)

    def contains(self, key: str) -> bool:
        return True if self.built is None else self.built.contains(key)

    def serialize(self) -> bytes:
        if self.built is None:
            raise ValueError("the filter is not built")
        return self.built.serialize()


def bloom_of(keys, items: int, bits_per_item: int = 10, hashes: int = 7, seed: int = 0) -> Bloom:
    """A Bloom filter over a DataFrame's only column. Partitions set bits on the executors; 64-bit words that any of them
    touched come to the driver, at most the filter's own size."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    shape = Bloom(items, bits_per_item, hashes, seed)

    def run(batches):
        own = Bloom(items, bits_per_item, hashes, seed)
        for b in batches:
            for k in b.column(0).to_pylist():
                if k is not None:
                    own.add(k)
        words = np.frombuffer(own.bits.tobytes() + bytes(-len(own.bits) % 8), "<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at], pa.int64())], names=["w", "m"])

    t = keys.mapInArrow(run, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    words = np.zeros(-(-len(shape.bits) // 8), "<i8")
    words[np.asarray(t.column("w"))] = np.asarray(t.column("m"))
    shape.bits = np.frombuffer(words.tobytes(), np.uint8)[: len(shape.bits)].copy()
    return shape


class Sharded:
    """Filters of one kind, each over the keys of one hash value."""

    kind, SEED = b"FLS1", 0x5EED

    def __init__(self, parts: list):
        self.parts = parts

    def contains(self, key: str) -> bool:
        return self.parts[_h(key, self.SEED) % len(self.parts)].contains(key)

    def serialize(self) -> bytes:
        raw = [p.serialize() for p in self.parts]
        return _seal(self.kind, struct.pack(f"<{len(raw)}Q", *map(len, raw)), b"".join(raw))

    @classmethod
    def load(cls, data: bytes) -> "Sharded":
        head, body = _open(cls.kind, data)
        parts, at = [], 0
        for n in struct.unpack(f"<{len(head) // 8}Q", head):
            parts.append(load_filter(body[at : at + n]))
            at += n
        return cls(parts)


#: Keys of a part of a sharded filter.
SHARD = 200_000


def sharded(kind: str, keys, items: int) -> Sharded:
    """A filter over the different values of a DataFrame's only column, of which there are about ``items``. A task builds
    each part from its own keys; what comes to the driver is the filter."""
    import pyarrow as pa

    n = max(1, -(-items // SHARD))

    def deal(batches):
        for b in batches:
            own = [k for k in b.column(0).to_pylist() if k is not None]
            yield pa.RecordBatch.from_arrays([pa.array([_h(k, Sharded.SEED) % n for k in own], pa.int32()), pa.array(own, pa.string())], names=["shard", "key"])

    def make(shard, group):
        f = make_filter(kind, group.num_rows)
        for k in group.column("key").to_pylist():
            if not f.add(k):
                raise RuntimeError("the filter is full")
        if hasattr(f, "build"):
            f.build()
        return pa.table({"shard": pa.array([shard[0].as_py()], pa.int32()), "data": pa.array([f.serialize()], pa.binary())})

    parts = {r["shard"]: load_filter(bytes(r["data"])) for r in keys.mapInArrow(deal, "shard int, key string").groupBy("shard").applyInArrow(make, "shard int, data binary").toLocalIterator()}
    empty = Bloom(1)  # no key, no bit
    return Sharded([parts.get(i, empty) for i in range(n)])


FILTERS = {"bloom": Bloom, "cuckoo": Cuckoo, "ribbon": Ribbon}


def make_filter(name: str, items: int):
    """none, bloom, cuckoo or ribbon."""
    if name in ("", "none"):
        return None
    if name not in FILTERS:
        raise ValueError(f"unknown filter {name!r}")
    return Buffered(Ribbon) if name == "ribbon" else FILTERS[name](items)


def load_filter(data: bytes):
    for cls in (*FILTERS.values(), Sharded):
        if data[:4] == cls.kind:
            return cls.load(data)
    raise ValueError("unknown filter data")
