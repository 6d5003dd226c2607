"""Regular expressions over bytes as one deterministic automaton: subset construction, minimisation, transition arrays.

Syntax: literals, `\\xNN` and escaped punctuation, classes with ranges and `^`, groups, `|`, and the repeats
`? * + {m} {m,} {m,n}`. Anchors, look-around and back-references aren't regular here and are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np

Bytes = frozenset  # of byte values


class _Parser:
    """Pattern to a tree of ("set", bytes) | ("seq", items) | ("or", items) | ("rep", item, least, most)."""

    def __init__(self, pattern: str, either_case: bool):
        self.s, self.i, self.either_case = pattern, 0, either_case

    def parse(self):
        tree = self._or()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return tree

    def _peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def _take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def _or(self):
        branches = [self._seq()]
        while self._peek() == "|":
            self._take()
            branches.append(self._seq())
        return branches[0] if len(branches) == 1 else ("or", branches)

    def _seq(self):
        items = []
        while self._peek() not in ("", "|", ")"):
            items.append(self._repeat(self._atom()))
        return ("seq", items)

    def _repeat(self, item):
        while (c := self._peek()) and c in "?*+{":
            self._take()
            if c == "{":
                close = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : close].partition(",")
                self.i = close + 1
                least, most = int(low), int(high) if high else None if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            item = ("rep", item, least, most)
        return item

    def _atom(self):
        c = self._take()
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            inner = self._or()
            if self._peek() != ")":
                raise ValueError(f"unclosed group in {self.s!r}")
            self._take()
            return inner
        if c == "[":
            return self._class()
        if c in "^$?*+{":
            raise ValueError(f"{c!r} at {self.i - 1} isn't supported in {self.s!r}")
        if c == ".":
            return ("set", Bytes(range(256)) - {10})
        return self._set({self._byte(c)})

    def _byte(self, c: str) -> int:
        if c == "\\":
            c = self._take()
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
            if c.isalnum():
                raise ValueError(f"\\{c} isn't supported")
        if ord(c) > 127:
            raise ValueError("write bytes beyond ASCII as \\xNN")
        return ord(c)

    def _class(self):
        negated, found = self._peek() == "^", set()
        if negated:
            self._take()
        while (c := self._take()) != "]":
            low = high = self._byte(c)
            if self._peek() == "-" and self.s[self.i + 1] != "]":
                self._take()
                high = self._byte(self._take())
            found.update(range(low, high + 1))
        kind, values = self._set(found)
        return (kind, Bytes(range(256)) - values if negated else values)

    def _set(self, values: set[int]):
        if self.either_case:
            values = values | {ord(chr(v).swapcase()) for v in values if chr(v).isascii() and chr(v).isalpha()}
        return ("set", Bytes(values))


def parse(pattern: str, either_case: bool = False):
    return _Parser(pattern, either_case).parse()


def reverse(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "seq":
        return ("seq", [reverse(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [reverse(x) for x in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:])


class Nfa:
    """Thompson's construction; each rule ends in a state of its own."""

    def __init__(self):
        self.moves: list[list[tuple[Bytes, int]]] = []
        self.free: list[list[int]] = []
        self.ends: dict[int, int] = {}

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int) -> int:
        """The state that is reached after the tree."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "seq":
            return reduce(lambda at, item: self.add(item, at), tree[1], start)
        if kind == "or":
            end = self.state()
            for item in tree[1]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(item, begin)].append(end)
            return end
        _, item, least, most = tree
        for _ in range(least):
            start = self.add(item, start)
        end = self.state()
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(item, loop)].append(loop)
            self.free[loop].append(end)
        else:
            self.free[start].append(end)
            for _ in range(most - least):
                start = self.add(item, start)
                self.free[start].append(end)
        return end


class Dfa:
    """next[state, byte] and a bit mask of the rules that end in each state; state 0 starts, `dead` has no way on."""

    def __init__(self, trees: list, *, search: bool):
        """`search`: a match may start anywhere, otherwise only at the start."""
        nfa = Nfa()
        start = nfa.state()
        for rule, tree in enumerate(trees):
            begin = nfa.state()
            nfa.free[start].append(begin)
            nfa.ends[nfa.add(tree, begin)] = 1 << rule
        if search:
            nfa.moves[start].append((Bytes(range(256)), start))
        sets = {s for moves in nfa.moves for s, _ in moves}
        kinds: dict[tuple, int] = {}  # bytes that no set tells apart share a column
        column = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
        sample = [column.index(k) for k in range(len(kinds))]

        def closed(states: set[int]) -> Bytes:
            todo, seen = list(states), set(states)
            while todo:
                for t in nfa.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return Bytes(seen)

        known = {closed({start}): 0}
        order, rows = list(known), []
        for states in order:
            row = []
            for b in sample:
                to = closed({t for s in states for chars, t in nfa.moves[s] if b in chars})
                if to not in known:
                    known[to] = len(known)
                    order.append(to)
                row.append(known[to])
            rows.append(row)
        table = np.array(rows, dtype=np.int32)
        masks = np.array([sum(nfa.ends.get(s, 0) for s in states) for states in order], dtype=np.int64)
        table, masks = _minimise(table, masks)
        self.next, self.masks = table[:, column], masks
        stuck = np.flatnonzero((table == np.arange(len(table))[:, None]).all(axis=1) & (masks == 0))
        self.dead = int(stuck[0]) if len(stuck) else -1

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match that starts at `start`, or -1."""
        state, found, rows, masks = 0, -1, self.rows, self.mask_list
        for at in range(start, len(data)):
            state = rows[state][data[at]]
            if state == self.dead:
                break
            if masks[state]:
                found = at + 1
        return found

    def farthest_back(self, data: bytes, end: int, least: int) -> int:
        """For the automaton of a reversed rule: smallest start, not below `least`, of a match that ends at `end`, or -1."""
        state, found, rows, masks = 0, -1, self.rows, self.mask_list
        for at in range(end - 1, least - 1, -1):
            state = rows[state][data[at]]
            if state == self.dead:
                break
            if masks[state]:
                found = at
        return found

    @property
    def rows(self) -> list[list[int]]:
        if not hasattr(self, "_rows"):
            self._rows, self._masks = self.next.tolist(), self.masks.tolist()
        return self._rows

    @property
    def mask_list(self) -> list[int]:
        self.rows  # noqa: B018
        return self._masks

    def __getstate__(self):
        return {"next": self.next, "masks": self.masks, "dead": self.dead}


def _minimise(table: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moore's refinement: states split until equal classes step to equal classes; state 0 stays first."""
    _, classes = np.unique(masks, return_inverse=True)
    while True:
        _, first, finer = np.unique(np.column_stack([classes, classes[table]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.reshape(-1)
        if len(first) == classes.max() + 1:
            break
        classes = finer
    rank = np.empty(len(first), dtype=np.int32)
    rank[np.argsort(first, kind="stable")] = np.arange(len(first))
    chosen = np.sort(first)
    return rank[finer][table[chosen]].astype(np.int32), masks[chosen]


class Scanner:
    """All rules in one pass over a text's bytes: one look-up a byte in a flat transition array."""

    def __init__(self, trees: list):
        dfa = Dfa(trees, search=True)
        order = np.argsort(dfa.masks != 0, kind="stable")  # ending states last: one comparison tells them
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        table = place[dfa.next[order]] * 256
        self.masks = dfa.masks[order].tolist()
        self.first_end = int((dfa.masks == 0).sum()) * 256
        self.begin = int(place[0]) * 256
        self.table = table.astype(np.int32).reshape(-1)
        self.resets = bytes(b for b in range(256) if (dfa.next[:, b] == 0).all())
        self.states = len(order)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_flat"}

    def ends(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(end, rules that end there) for each place where a match of any rule ends, one by one: a run may end everywhere."""
        if not hasattr(self, "_flat"):
            own: dict[int, int] = {}
            self._flat = [own.setdefault(x, x) for x in self.table.tolist()]
        flat, state, first_end, masks = self._flat, self.begin, self.first_end, self.masks
        for at, byte in enumerate(data):
            state = flat[state + byte]
            if state >= first_end:
                yield at + 1, masks[state >> 8]
