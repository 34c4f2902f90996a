"""Cheapest repair of a sequence of turns, by transfer matrices over a
grammar.

A turn is a symbol: the initial of its role and its first fault. A repair
walks the states of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. A
sequence's transfer matrix has, for each pair of states, the least cost of
edits that lead from one to the other and their audit: of equal costs the
ASCII-least. Sequences are put together by min-plus products.

Two audits of one sequence between the same states and of equal cost are
never one a prefix of the other: it would lack inserted turns only, and an
even number of them costs more. So the lesser of two stays the lesser
whatever follows, and entries can be chosen bottom-up.

Audits are ropes: a product joins two without copying; comparing stops at
the first difference. A grammar is a list of pairs (Re-Pair: the pair that
occurs most often becomes a symbol); each rule has one matrix for all
sequences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

ROLES = "sua?"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Base symbols: ``FIRST`` and the 15 letters after it. Rules begin at ``RULES``.
FIRST = ord("A")
RULES = 0x0100
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: The state that a user or assistant turn leads to, from each state.
NEXT = (2, 2, 3, 2)
STATES = range(4)
LEAF = 64


class Rope:
    """A string in parts."""

    __slots__ = ("left", "right", "text", "size")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        self.size = len(text) if left is None else left.size + right.size

    def __add__(self, other: Rope) -> Rope:
        if not other.size:
            return self
        if not self.size:
            return other
        if self.size + other.size <= LEAF:
            return Rope(str(self) + str(other))
        return Rope("", self, other)

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            x = stack.pop()
            if x.left is None:
                yield x.text
            else:
                stack += (x.right, x.left)

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        if self is other:
            return False
        a, b, x, y = self.leaves(), other.leaves(), "", ""
        while True:
            x, y = x or next(a, ""), y or next(b, "")
            if not x or not y:
                return bool(y)
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            x, y = x[n:], y[n:]


EMPTY = Rope()
#: An entry is (cost, audit) or None; a matrix has a row for each state.
Entry = tuple[int, Rope] | None


def better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if b[1] < a[1] else a


def product(a: list, b: list) -> list:
    out = []
    for row in a:
        line: list[Entry] = [None] * 4
        for k, x in enumerate(row):
            if x is None:
                continue
            for j, y in enumerate(b[k]):
                if y is None:
                    continue
                cost = x[0] + y[0]
                if line[j] is None or cost <= line[j][0]:
                    line[j] = better(line[j], (cost, x[1] + y[1]))
        out.append(line)
    return out


def inserting() -> list:
    """Up to two inserted turns; more lead back at a cost."""
    out: list[list[Entry]] = [[None] * 4 for _ in STATES]
    for i in STATES:
        j = i
        for n in range(3):
            out[i][j] = better(out[i][j], (n * INSERT, Rope("I" * n)))
            j = NEXT[j]
    return out


def turn(symbol: str) -> list:
    """Matrix of a base symbol: inserted turns, then the turn itself."""
    role, fault = divmod(ord(symbol) - FIRST, 4)
    own: list[list[Entry]] = [[None] * 4 for _ in STATES]
    for i in STATES:
        own[i][i] = (DELETE, Rope("D"))
        if fault in (BLANK, DUPLICATE):
            continue
        cut = CUT if fault == TRUNCATED else 0
        j = NEXT[i]
        own[i][j] = better(own[i][j], (REROLE + cut, Rope("R")))
        if ROLES[role] == "s" and i == 0:
            own[0][1] = better(own[0][1], (KEEP + cut, Rope("K")))
        if ROLES[role] == {2: "u", 3: "a"}[j]:
            own[i][j] = better(own[i][j], (KEEP + cut, Rope("K")))
    return product(inserting(), own)


class Grammar:
    """Matrices of the base symbols and of each rule, bottom-up."""

    def __init__(self, rules: Iterable[str] = ()):
        self.rules: list[str] = []
        self.matrix = {chr(FIRST + k): turn(chr(FIRST + k)) for k in range(16)}
        self.extend(rules)

    def extend(self, rules: Iterable[str]) -> None:
        for pair in rules:
            self.matrix[chr(RULES + len(self.rules))] = product(self.matrix[pair[0]], self.matrix[pair[1]])
            self.rules.append(pair)

    def compressed(self, symbols: str, since: int = 0) -> str:
        for k in range(since, len(self.rules)):
            symbols = symbols.replace(self.rules[k], chr(RULES + k))
        return symbols

    def evaluate(self, compressed: str) -> list:
        """Matrix of a whole sequence; an empty one changes nothing."""
        out = None
        for x in compressed:
            out = self.matrix[x] if out is None else product(out, self.matrix[x])
        return out or [[(0, EMPTY) if i == j else None for j in STATES] for i in STATES]


def pairs(symbols: str) -> Counter:
    """How often each pair can be replaced, from the left."""
    found, last = Counter(), -2
    for k in range(len(symbols) - 1):
        if symbols[k] == symbols[k + 1] and k == last + 1 and symbols[last] == symbols[k]:
            last = -2  # the middle of three equal symbols
            continue
        found[symbols[k : k + 2]] += 1
        last = k
    return found


def apart(found: Iterable[tuple[str, int]], room: int) -> list[str]:
    """The most frequent pairs that have no symbol in common: replacing one
    does not change how often another occurs."""
    out, used = [], set()
    for pair, _ in sorted(found, key=lambda x: (-x[1], x[0])):
        if len(out) < room and not used & set(pair):
            out.append(pair)
            used |= set(pair)
    return out


def best(matrix: list) -> tuple[int, str]:
    """Cost and audit of the whole: from nothing to nothing or after a."""
    ended = product([matrix[0]], inserting())[0]
    cost, audit = better(ended[0], ended[3])
    return cost, str(audit)


def packed(matrix: list) -> tuple[list[int], list[str]]:
    """Costs (-1: no way) and audits of the 16 entries."""
    flat = [x for row in matrix for x in row]
    return [-1 if x is None else x[0] for x in flat], ["" if x is None else str(x[1]) for x in flat]


def unpacked(costs: Iterable[int], audits: Iterable[str]) -> list:
    flat = [None if c < 0 else (int(c), Rope(a)) for c, a in zip(costs, audits, strict=True)]
    return [flat[4 * i : 4 * i + 4] for i in STATES]
