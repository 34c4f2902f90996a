import hashlib

import numpy as np
from mooclens.llm import fingerprint

from .conftest import prose


def test_edited_pairs_against_plain_python(awkward):
    rows = sorted(awkward.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    expect = []
    for r, nxt in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = r["text"] or "", nxt["text"] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        expect.append((str(r["doc_id"]), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    got = fingerprint.edited_pairs(awkward).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == sorted(expect)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[4]["fingerprint"] == by_id[140]["fingerprint"]
    assert by_id[200]["fingerprint"] == by_id[201]["fingerprint"] != by_id[203]["fingerprint"]


def test_empty_and_single(spark, nothing):
    assert fingerprint.edited_pairs(nothing).count() == 0
    one = spark.createDataFrame([(7, "a b c d")], "doc_id long, text string")
    r = fingerprint.edited_pairs(one).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest() or r["n_chars"] == 7


def test_estimate_is_near_the_true_likeness():
    import random

    rng = random.Random(8)
    errors = []
    for share in (0.1, 0.3, 0.5, 0.7, 0.9):
        for _ in range(40):
            w = prose(rng, 400).split(" ")
            cut = int(400 * share)
            a, b = " ".join(w), " ".join(w[:cut] + prose(rng, 400 - cut).split(" "))
            pad = lambda t: {tuple((["^"] * 4 + t.split(" "))[i : i + 5]) for i in range(len(t.split(" ")))}
            x, y = pad(a), pad(b)
            p = fingerprint.packed([a.encode(), b.encode()])
            errors.append(fingerprint.likeness(p[:1], p[1:])[0] - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_fingerprints_keep_columns(awkward):
    out = fingerprint.fingerprints(awkward)
    assert out.columns == [*awkward.columns, "fingerprint"] and out.count() == awkward.count()
