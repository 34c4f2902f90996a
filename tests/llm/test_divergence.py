"""Source divergence against dictionaries; perfect hashes by themselves."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mooclens.llm import divergence, perfect_hash
from mooclens.llm.perfect_hash import PerfectHash, build, hashed, joined, shard_of

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, min_docs=30, top=50):
    """Result rows of (lang, source, text) rows."""
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    docs = [(a or "", b or "", [low(x) for x in TERM.findall(t or "")]) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(x for d in own for x in set(d[2]))
        kept = [x for x, n in seen.items() if n >= min_docs]
        groups = {s: Counter() for s in {d[1] for d in own}}
        for _, s, words in own:
            groups[s].update(words)

        def share(count, total):
            return 1 + 10**9 * (count + 5) // (total + 5 * len(kept))

        def shares(counts):
            total = sum(counts[x] for x in kept)
            return {x: share(counts[x], total) for x in kept}

        whole = shares(sum(groups.values(), Counter()))
        p = {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(o, sum(abs(p[s][x] - p[o][x]) for x in kept)) for o in groups if o != s]
            terms = [(x, p[s][x] - whole[x]) for x in kept if groups[s][x] and p[s][x] > whole[x]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in divergence.divergence(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, docs):
    rng = random.Random(seed)
    rows = []
    for _ in range(docs):
        lang = rng.choice(["aa", "aa", "aa", "bb", "é", None])
        source = rng.choice(["s1", "s1", "s2", "s3", None, "ß"])
        skew = len(source or "") + ord((source or "x")[-1]) % 5
        words = [f"{'ÉßAbcxyz你'[min(8, int(rng.expovariate(0.4)))]}{chr(97 + (rng.randrange(26) * (1 + skew)) % 26)}" for _ in range(rng.randrange(40))]
        rows.append((lang, source, rng.choice([" ", "1", "-\x00", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("rounds", [1 << 30, 200])
def test_against_dictionaries(spark, rounds):
    rows = corpus(4, 700) + [("lonely", "s9", "few words"), ("lonely", "s8", None), ("aa", "s7", ""), ("aa", "s7", None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    expect = plain(rows)
    assert {r[2] for r in expect} == {"pair", "term"} and ("lonely", "s8", "pair", "s9", 0, 1) in expect
    assert found(df, round_bytes=rounds, shard_keys=16) == expect


def test_small_dense_arrays_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 300)
    monkeypatch.setattr(divergence, "SLOTS", 40)
    monkeypatch.setattr(divergence, "PART", 2000)
    rows = corpus(9, 500)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert found(df, min_docs=5, top=7) == plain(rows, 5, 7)


def test_awkward(awkward):
    rows = [(r["lang"], r["source"], r["text"]) for r in awkward.collect()]
    assert found(awkward, min_docs=3) == plain(rows, 3)


def test_no_kept_term_and_no_rows(spark, nothing):
    rows = [("aa", "s1", "a b"), ("aa", "s2", "b"), ("bb", "s1", None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert found(df) == plain(rows) == [("aa", "s1", "pair", "s2", 0, 1), ("aa", "s2", "pair", "s1", 0, 1)]
    assert divergence.divergence(nothing).count() == 0


def shards_of(keys, shards, hashes=hashed):
    numbers = shard_of(hashed(joined(*k) for k in keys), shards)
    rows = []
    for s in range(shards):
        own = [k for k, n in zip(keys, numbers, strict=True) if n == s]
        sizes, bits, order = build(hashes([joined(*k) for k in own]))
        langs, terms = ([own[k][c] for k in order] for c in (0, 1))
        rows.append({"shard": s, "n": len(own), "sizes": sizes, "bits": np.packbits(bits).tobytes(), "langs": langs, "terms": terms, "bytes": 0})
    kinds = [("shard", pa.int32()), ("n", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()),
             ("langs", pa.list_(pa.string())), ("terms", pa.list_(pa.string())), ("bytes", pa.int64())]
    return pa.Table.from_pylist(rows, pa.schema(kinds))


@pytest.mark.parametrize("shards", [1, 5])
def test_perfect_hash_is_minimal_and_verified(shards):
    keys = [(lang, f"{lang}w{k}") for lang in ("aa", "b", "é") for k in range(1500)]
    found = PerfectHash(shards_of(keys, shards), shards)
    at = found.positions([joined(*k) for k in keys])
    assert sorted(at) == list(range(len(keys)))
    assert [found.keys[k].as_py() for k in at.tolist()] == [joined(*k) for k in keys]
    strangers = [joined("aa", f"x{k}") for k in range(5000)]
    assert (found.positions(strangers) == -1).all()
    for lang, own in found.lang_slots.items():
        assert (found.local[own] == np.arange(1500)).all() and found.keys[int(own[0])].as_py().startswith(lang.encode() + b"\0")


def test_keys_that_never_settle(monkeypatch):
    """Two keys with one hash end in the list and are still told apart."""
    real = perfect_hash.hashed
    same = lambda keys: real(b"" if k in (joined("aa", "x"), joined("aa", "y")) else k for k in keys)
    keys = [("aa", x) for x in ["x", "y", *(f"w{k}" for k in range(50))]]
    table = shards_of(keys, 1, same)
    monkeypatch.setattr(perfect_hash, "hashed", same)
    found = PerfectHash(table, 1)
    assert len(found.odd) == 2
    at = found.positions([joined(*k) for k in [*keys, ("aa", "z")]])
    assert sorted(at[:-1]) == list(range(len(keys))) and at[-1] == -1
