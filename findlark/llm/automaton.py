"""Regular expressions to one deterministic byte automaton.

A small parser (literals, classes, groups, ``| ? * + {m,n}``, ``(?i:...)``)
gives a Thompson-style automaton; subset construction over byte classes and
partition refinement give a minimal table. ``reverse=True`` builds the
automaton of the mirrored rules with an unanchored start: run from the end of a
text to its start it stands in an accepting state of rule r exactly at the
places where some match of r begins.
"""

from __future__ import annotations

import numpy as np


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def parse(self):
        node = self.alt()
        if self.i != len(self.p):
            raise ValueError(f"cannot parse {self.p!r} at {self.i}")
        return node

    def alt(self):
        parts = [self.seq()]
        while self.p[self.i : self.i + 1] == "|":
            self.i += 1
            parts.append(self.seq())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def seq(self):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            parts.append(self.repeat())
        return ("seq", parts)

    def repeat(self):
        node = self.atom()
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            self.i += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = self.p.index("}", self.i)
                a, comma, b = self.p[self.i : end].partition(",")
                low, high, self.i = int(a), (int(b) if b else None) if comma else int(a), end + 1
            node = ("rep", node, low, high)
        return node

    def atom(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            fold = self.fold
            if self.p.startswith("?i:", self.i):
                self.fold, self.i = True, self.i + 3
            elif self.p.startswith("?:", self.i):
                self.i += 2
            node = self.alt()
            if self.p[self.i : self.i + 1] != ")":
                raise ValueError("missing )")
            self.i, self.fold = self.i + 1, fold
            return node
        if c == "[":
            return ("set", self.char_class())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.folded({self.escape() if c == "\\" else self.one(c)}))

    @staticmethod
    def one(c: str) -> int:
        if ord(c) > 127:
            raise ValueError("patterns are ASCII")
        return ord(c)

    def folded(self, s: set[int]) -> frozenset:
        return frozenset(s | {ord(chr(b).swapcase()) for b in s if chr(b).isalpha() and b < 128} if self.fold else s)

    def escape(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, self.one(c))

    def char_class(self) -> frozenset:
        negate = self.p[self.i] == "^"
        self.i += negate
        got: set[int] = set()
        first = True
        while first or self.p[self.i] != "]":
            first = False
            c = self.p[self.i]
            self.i += 1
            a = self.escape() if c == "\\" else self.one(c)
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                c = self.p[self.i]
                self.i += 1
                got |= set(range(a, (self.escape() if c == "\\" else self.one(c)) + 1))
            else:
                got.add(a)
        self.i += 1
        s = self.folded(got)
        return frozenset(range(256)) - s if negate else s


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.move: list[tuple[frozenset, int] | None] = []

    def new(self) -> int:
        self.eps.append([])
        self.move.append(None)
        return len(self.eps) - 1

    def add(self, node, start: int, reverse: bool) -> int:
        """Adds node after start; the state where it ends."""
        kind = node[0]
        if kind == "set":
            end = self.new()
            mid = self.new()
            self.eps[start].append(mid)
            self.move[mid] = (node[1], end)
            return end
        if kind == "seq":
            for part in reversed(node[1]) if reverse else node[1]:
                start = self.add(part, start, reverse)
            return start
        if kind == "alt":
            end = self.new()
            for part in node[1]:
                s = self.new()
                self.eps[start].append(s)
                self.eps[self.add(part, s, reverse)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start, reverse)
        if high is None:
            loop = self.new()
            self.eps[start].append(loop)
            self.eps[self.add(inner, loop, reverse)].append(loop)
            return loop
        end = self.new()
        for _ in range(high - low):
            self.eps[start].append(end)
            start = self.add(inner, start, reverse)
        self.eps[start].append(end)
        return end


class Dfa:
    """table[state, byte] -> state; accepts[state]: bit r is set if rule r accepts. State 0 is the start; accepting states have the highest numbers."""

    def __init__(self, rules: list[str], reverse: bool = False, anchored: bool = False):
        nfa, ends = _Nfa(), {}
        root = nfa.new()
        for r, rule in enumerate(rules):
            s = nfa.new()
            nfa.eps[root].append(s)
            ends[nfa.add(_Parser(rule).parse(), s, reverse)] = r

        closures: dict[int, frozenset] = {}

        def closure(s: int) -> frozenset:
            if s not in closures:
                seen, todo = {s}, [s]
                while todo:
                    for t in nfa.eps[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                closures[s] = frozenset(x for x in seen if nfa.move[x] or x in ends)
            return closures[s]

        sets = {m[0] for m in nfa.move if m}
        sign: dict[tuple, list[int]] = {}
        order = sorted(sets, key=sorted)
        for b in range(256):
            sign.setdefault(tuple(b in s for s in order), []).append(b)
        classes = list(sign.values())
        first = closure(root)
        if any(s in ends for s in first):
            raise ValueError("a rule matches the empty string")
        number, todo, rows = {first: 0}, [first], []
        for now in todo:
            row = []
            for cls in classes:
                nxt: set[int] = set() if anchored else set(first)
                for s in now:
                    m = nfa.move[s]
                    if m and cls[0] in m[0]:
                        nxt |= closure(m[1])
                key = frozenset(nxt)
                if key not in number:
                    number[key] = len(number)
                    todo.append(key)
                row.append(number[key])
            rows.append(row)
        table = np.array(rows, dtype=np.int64)
        accepts = np.array([sum({1 << ends[s] for s in now if s in ends}) for now in todo], dtype=np.int64)
        # Partition refinement: states stay together while their next states do.
        part = np.unique(accepts, return_inverse=True)[1]
        while True:
            new = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].reshape(-1)
            if new.max() == part.max():
                break
            part = new
        one = np.zeros(part.max() + 1, dtype=np.int64)
        one[part] = np.arange(len(part))
        rank = np.lexsort((np.arange(len(one)), one != one[part[0]], accepts[one] != 0))
        place = np.empty(len(one), dtype=np.int64)
        place[rank] = np.arange(len(one))
        byte_class = np.empty(256, dtype=np.int64)
        for c, cls in enumerate(classes):
            byte_class[cls] = c
        self.table = place[part[table[one[rank]]]][:, byte_class]
        self.accepts = accepts[one[rank]]
        self.first_accepting = int((self.accepts == 0).sum())
        self.start = int(place[part[0]])


def scan_back(dfa: Dfa, data: np.ndarray, lanes: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """One backward pass over bytes: ascending places where matches begin, and the mask of their rules.

    The bytes are cut into lanes that numpy runs in lockstep from the start
    state; where the lane to the right ends in another state, the lane is
    walked again from that state until both walks meet. More threads are alive
    in the true walk, so it can only add places.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lanes = max(1, min(lanes, n // 512))
    m = -(-n // lanes)
    flat = np.zeros(lanes * m, dtype=np.uint8)
    flat[:n] = data
    cols = np.ascontiguousarray(flat.reshape(lanes, m).T)
    step = (dfa.table * 256).astype(np.int64).ravel()
    state, at = np.zeros(lanes, dtype=np.int64), np.empty(lanes, dtype=np.int64)
    least = dfa.first_accepting * 256
    places, masks = [], []
    for t in range(m - 1, -1, -1):
        np.add(state, cols[t], out=at)
        np.take(step, at, out=state, mode="clip")
        if state.max() >= least:
            hit = np.flatnonzero(state >= least)
            places.append(hit * m + t)
            masks.append(dfa.accepts[state[hit] >> 8])
    table, accepts = dfa.table, dfa.accepts
    carry = int(state[lanes - 1]) >> 8
    for k in range(lanes - 2, -1, -1):
        end = int(state[k]) >> 8
        if carry:
            true, guess = carry, 0
            for p in range((k + 1) * m - 1, k * m - 1, -1):
                true, guess = int(table[true, flat[p]]), int(table[guess, flat[p]])
                if true == guess:
                    break
                if accepts[true] & ~accepts[guess]:
                    places.append(np.array([p]))
                    masks.append(np.array([accepts[true] & ~accepts[guess]]))
            else:
                end = true
        carry = end
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, k = np.concatenate(places), np.concatenate(masks)
    order = np.argsort(p, kind="stable")
    p, k = p[order], k[order]
    cut = np.flatnonzero(np.diff(p, prepend=-1))
    return p[cut], np.bitwise_or.reduceat(k, cut)


def longest(dfa: Dfa, data: bytes, start: int) -> int:
    """End of the longest match that begins at start; -1 if there is none."""
    state, end, table, accepts = dfa.start, -1, dfa.table, dfa.accepts
    dead = getattr(dfa, "dead", None)
    if dead is None:
        dead = dfa.dead = {s for s in range(len(table)) if not accepts[s] and (table[s] == s).all()}
    for i in range(start, len(data)):
        state = int(table[state, data[i]])
        if state in dead:
            break
        if accepts[state]:
            end = i + 1
    return end
