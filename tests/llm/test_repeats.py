"""Repeat removal against a plain version over all windows."""

import random
import re

import pytest

from mooclens.llm import repeats

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
NULL = 1 << 62  # a null id is the greatest


def plain(rows, width=repeats.WIDTH):
    """(doc_id, n_words, n_removed, kept) of (doc_id, text) rows."""
    words = [(NULL if d is None else d, SPLIT.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            least[x] = min(d, least.get(x, d))
    out = []
    for d, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < d:
                gone.update(range(k, k + width))
        out.append((None if d == NULL else d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def found(df):
    rows = repeats.remove_repeats(df).collect()
    for r in rows:
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]
        assert all(x["end"] - x["start"] >= repeats.WIDTH for x in r["removed"]) and r["removed"] == sorted(r["removed"])
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def shared_passages(seed, docs, passages=6):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    stock = [[word() for _ in range(rng.choice([12, 13, 14, 20, 27, 60]))] for _ in range(passages)]
    rows = []
    for i in range(docs):
        text = [word() for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            text += rng.choice(stock)[rng.randrange(3) :] + [word() for _ in range(rng.randrange(4))]
        rows.append((i * 3 % 101, rng.choice([" ", "\n", " \t "]).join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_windows(spark, seed):
    rows = shared_passages(seed, 90)
    expect = plain(rows)
    assert sum(r[2] for r in expect) > 500
    assert found(table(spark, rows).repartition(4)) == expect


def test_every_offset_and_length(spark):
    """A passage of 13 words at any place is found, one of 12 stays."""
    rows = []
    for shift in range(15):
        passage = [f"p{shift}x{k}" for k in range(13)]
        own = lambda n, d: [f"w{d}x{shift}x{k}" for k in range(n)]
        rows.append((100 + shift, " ".join(own(shift, "a") + passage + own(3, "b"))))
        rows.append((200 + shift, " ".join(own(5, "c") + passage + own(shift, "d"))))
        rows.append((300 + shift, " ".join(own(9, "e") + passage[:12] + own(2, "f"))))
    got = found(table(spark, rows).repartition(3))
    assert got == plain(rows)
    assert [r[2] for r in got] == [0] * 15 + [13] * 15 + [0] * 15


def test_many_small_chunks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BUCKET", 97)
    monkeypatch.setattr(repeats, "WINDOW_BUCKET", 31)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rows = shared_passages(7, 150, 3)
    assert found(table(spark, rows).repartition(6)) == plain(rows)


def test_awkward(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert found(awkward) == plain(rows)


def test_ties_nulls_and_long_texts(spark):
    long = " ".join(f"w{k % 5000}" for k in range(200_000))
    same = " ".join(f"same{k}" for k in range(20))
    rows = [(None, same), (5, same), (5, same), (-3, f"x {same} y"), (None, None), (7, ""), (8, long), (9, f"{long} end"), (1, "a " * 60)]
    got = found(table(spark, rows))
    assert got == plain(rows)
    assert [r[2] for r in got if r[0] == 1] == [0]  # repeats itself only
    assert [r[2] for r in got if r[0] == 9] == [200_000]


def test_adjacent_documents_are_not_one(spark):
    """A window never runs from one document into the next."""
    w = [f"w{k}" for k in range(26)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:6])), (3, " ".join(w[6:13])), (4, " ".join(w[13:])), (5, " ".join(w[:13]))]
    got = found(table(spark, rows).coalesce(1))
    assert got == plain(rows) and [r[2] for r in got] == [0, 0, 0, 13, 13]


def test_empty(nothing):
    assert repeats.remove_repeats(nothing).count() == 0
