"""Plain Python versions that the operators are held against."""

import re

from mooclens.llm.line_dedup import WIDTH

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


def words(text):
    return WORD.findall(low(text))


def shingles(text, width):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(width))))


class Union:
    def __init__(self, names):
        self.up = {x: x for x in names}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def tie(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def similar(a, b, percent=80):
    k = len(a & b)
    return bool(a and b) and 100 * k >= percent * (len(a) + len(b) - k)


def near_components(rows, width, percent=80):
    """{doc_id: component} of (doc_id, text) rows."""
    sets = [(d, shingles(t, width)) for d, t in rows]
    union = Union([d for d, _ in sets])
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if similar(x, y, percent):
                union.tie(a, b)
    return {d: union.find(d) for d, _ in sets}


def removed_lines(rows, min_chars=1, width=WIDTH):
    """{doc_id: sorted removed line numbers} of distinct (doc_id, text)."""
    places = {}
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            line = low(line.strip(" \t\n\v\f\r"))
            if len(line) >= min_chars:
                places.setdefault(line, []).append((d, k))
    lines = list(places)
    sets = [{x[i : i + width] for i in range(max(1, len(x) - width + 1))} for x in lines]
    union = Union(range(len(lines)))
    for i, a in enumerate(sets):
        for j in range(i):
            if similar(a, sets[j]):
                union.tie(i, j)
    gone = {d: [] for d, _ in rows}
    groups = {}
    for i, line in enumerate(lines):
        groups.setdefault(union.find(i), []).extend(places[line])
    for found in groups.values():
        for d, k in found:
            if (d, k) != min(found):
                gone[d].append(k)
    return {d: sorted(x) for d, x in gone.items()}
