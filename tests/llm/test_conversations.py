"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from mooclens.llm import conversations as cv
from mooclens.llm import repair_grammar as rg

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\v\f\r"
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def plain(rows):
    """Result rows, by dynamic programming over single turns."""
    out = []
    hurt = list(damaged(rows))
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in hurt if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            rest = text.rstrip(WHITE)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        best = {"": (0, "", ())}

        def better(states, key, value):
            if key not in states or value < states[key]:
                states[key] = value

        def inserted(states):
            states = dict(states)
            for _ in range(2):
                for x, (cost, audit, said) in list(states.items()):
                    nxt = AFTER[x]
                    better(states, nxt, (cost + 3, audit + "I", (*said, ("user:", "assistant:")[nxt == "a"])))
            return states

        for (_, role, text), fault in zip(own, faults, strict=True):
            new = {}
            for x, (cost, audit, said) in inserted(best).items():
                better(new, x, (cost + 4, audit + "D", said))
                if fault in ("blank", "duplicate"):
                    continue
                cut, nxt = 3 * (fault == "truncated"), AFTER[x]
                better(new, nxt, (cost + 3 + cut, audit + "R", (*said, f"{'user' if nxt == 'u' else 'assistant'}:{text}")))
                if role[:1] == nxt or (role[:1] == "s" and x == ""):
                    better(new, role[:1], (cost + cut, audit + "K", (*said, f"{role}:{text}")))
            best = new
        cost, audit, said = min(v for k, v in inserted(best).items() if k in ("", "a"))
        turns = {r[0] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in cv.repaired(df).select(*columns).collect()), key=repr)


def talks(seed, convs, longest=14):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "", " \n", "cut off", "é ß. \t", None, "And so on.", "Well?\n"]
    roles = ["user", "assistant"] * 4 + ["system", "tool", None, "Sys", "u", ""]
    rows = []
    for c in range(convs):
        turn = rng.choice([0, 1, 5])
        for k in range(rng.randrange(1, longest)):
            turn += rng.choice([1, 1, 1, 2, 0])
            role = ["user", "assistant"][k % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((None if c == 7 else c, rng.choice([turn] * 9 + [None]), role, rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}."))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_single_turns(spark, seed):
    rows = talks(seed, 120)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_conversations_of_many_blocks(spark, hot, monkeypatch):
    """Hot conversations: key ranges for positions, blocks, joins of joins."""
    monkeypatch.setattr(cv, "BLOCK", 5)
    monkeypatch.setattr(cv, "FAN", 3)
    rows = talks(3, 8, 12) + [(50, k // 2, "user" if k % 3 else "assistant", f"turn {k % 40}" + "." * (k % 5 > 0)) for k in range(260)]
    rows += [(51, 4, "user", "the same turn.")] * 33
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == plain(rows)


def test_awkward_rows(spark):
    gone = [(c, t) for c in range(300, 400) for t in range(30) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    rows = [(c, t, "user", "Dropped.") for c, t in gone]
    rows += [(1, None, None, None), (1, 2, "user", "x" * 100_000), (2, 1, "system", "Be kind."), (3, 9, "assistant", "Hi."), (3, 9, "assistant", "Hi.")]
    rows += [(None, None, None, None), (None, 3, "user", "Who?"), (4, -5, "user", "a\nb."), (4, 5, "assistant", "user:x.")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("n", "part", "symbols", "block", "digest", "copies", "is_turn", "audit", "_conv", "c"):
        df = df.withColumn(c, F.lit("x"))
    got = found(df)
    assert got == plain(rows)
    empty = [r for r in got if r[0] in {c for c, _ in gone}]
    assert empty and all(r[1:] == (0, 0, 0, 0, 0, 0, "", cv.NOTHING) for r in empty)


def test_no_rows(spark):
    assert cv.repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_grammar_changes_nothing():
    """Matrices over a grammar equal those over single turns."""
    rng = random.Random(8)
    stock = ["".join(chr(rg.FIRST + rng.randrange(16)) for _ in range(rng.randrange(1, 9))) for _ in range(5)]
    lines = ["".join(rng.choice(stock) for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    grammar = rg.Grammar()
    short = lines
    for _ in range(6):
        total = sum((rg.pairs(x) for x in short), start=rg.Counter())
        since = len(grammar.rules)
        grammar.extend(rg.apart(total.items(), 9))
        short = [grammar.compressed(x, since) for x in short]
    assert sum(map(len, short)) < sum(map(len, lines)) / 2
    for x, y in zip(lines, short, strict=True):
        assert rg.packed(grammar.evaluate(y)) == rg.packed(rg.Grammar().evaluate(x))
        assert rg.best(rg.unpacked(*rg.packed(grammar.evaluate(y)))) == rg.best(grammar.evaluate(y))


def test_least_audit_among_all_edits():
    """Every sequence of edits of short conversations, by enumeration."""
    rng = random.Random(11)
    nxt = {0: 2, 1: 2, 2: 3, 3: 2}
    for _ in range(25):
        symbols = "".join(chr(rg.FIRST + rng.randrange(16)) for _ in range(rng.randrange(4)))
        least = None
        stack = [(0, 0, 0, "")]
        while stack:
            k, state, cost, audit = stack.pop()
            if k == len(symbols) and state in (0, 3) and (least is None or (cost, audit) < least):
                least = (cost, audit)
            if audit[-3:] != "III":
                stack.append((k, nxt[state], cost + 3, audit + "I"))
            if k < len(symbols):
                role, fault = divmod(ord(symbols[k]) - rg.FIRST, 4)
                stack.append((k + 1, state, cost + 4, audit + "D"))
                if fault in (rg.OK, rg.TRUNCATED):
                    cut = 3 * (fault == rg.TRUNCATED)
                    stack.append((k + 1, nxt[state], cost + 3 + cut, audit + "R"))
                    if rg.ROLES[role] == "s" and state == 0:
                        stack.append((k + 1, 1, cost + cut, audit + "K"))
                    if rg.ROLES[role] == "ua"[nxt[state] - 2]:
                        stack.append((k + 1, nxt[state], cost + cut, audit + "K"))
        assert rg.best(rg.Grammar().evaluate(symbols)) == least


def test_ropes_compare_as_strings():
    rng = random.Random(2)
    parts = ["".join(rng.choice("DIK") for _ in range(rng.randrange(1, 70))) for _ in range(12)]
    for _ in range(300):
        a, b = (sum((rg.Rope(parts[k]) for k in rng.choices(range(3), k=rng.randrange(5))), start=rg.EMPTY) for _ in range(2))
        assert (a < b) == (str(a) < str(b)) and str(a + b) == str(a) + str(b) and (a + b).size == len(str(a)) + len(str(b))
