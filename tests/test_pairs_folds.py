"""Hard negatives (N6), query folds (L9) and two-split features."""

import datetime as dt
import random
from collections import Counter

import pytest

from mooclens.operators import pairs
from mooclens.operators.logs import build_log
from mooclens.operators.pairs import hard_negative_pairs
from mooclens.operators.ranksvm import cross_validate, query_folds
from mooclens.plans.features import FINAL_FEATURES, split_features


def test_candidates_are_distinct_and_the_nearest_is_kept(spark):
    """With every row a candidate the pair is the nearest of all."""
    rng = random.Random(2)
    rows = [(i * 3, [rng.random(), rng.random()], i % 2) for i in range(30)] + [(1000, [0.5, 0.5], None), (None, [0.1, 0.1], 1)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    rows = [r for r in rows if r[0] is not None and r[2] is not None]
    for n in (15, 40):
        got = {r["id"]: r for r in hard_negative_pairs(df, n_candidates=n).collect()}
        assert sorted(got) == sorted(r[0] for r in rows)
        for i, x, y in rows:
            d = {o: sum((a - b) ** 2 for a, b in zip(x, v)) for o, v, c in rows if c != y}
            assert got[i]["other_id"] == min(d, key=lambda o: (d[o], o)) and got[i]["y"] == y and got[i]["x1"] == x


def test_draws_spread_over_the_class(spark, hot):
    """One draw a stratum: repeats differ, neighbours share no run."""
    rows = [(i, [float(i % 50)], int(i >= 200)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    found = hard_negative_pairs(df, n_candidates=1, repeats=4, seed=5).collect()
    assert len(found) == 1600
    used = Counter(r["other_id"] for r in found)
    assert len(used) > 360 and max(used.values()) < 20
    by = {}
    for r in found:
        by.setdefault(r["id"], set()).add(r["other_id"])
    assert sum(len(x) >= 3 for x in by.values()) > 350
    assert hard_negative_pairs(df.where("label = 1")).count() == 0


def drawn(pos, repeat, t, m, k, seed):
    def one(x):
        return x % 2147483647 * 48271 % 2147483647

    low, high = t * m // k, (t + 1) * m // k
    return low + one(one(one(pos * 16807 + seed) + repeat * 69621) + t * 630360016) % (high - low)


def test_vectors_meet_in_blocks(spark, monkeypatch):
    """Many blocks and slices, classes of unequal size, repeated ids, vectors
    with nulls, NaN, of other lengths or none: the nearest of the draws. No
    vector is sent to its draws one by one."""
    monkeypatch.setattr(pairs, "BLOCK_BITS", 3)
    monkeypatch.setattr(pairs, "PAIRS", 7)
    rng = random.Random(4)
    rows = [(i // 2 * 2 if i % 11 == 0 else i, [float(rng.randrange(6)) for _ in range(3)], int(rng.random() < 0.2)) for i in range(260)]
    rows += [(300, [1.0, None, 2.0], 0), (301, None, 1), (302, [], 0), (303, [float("nan"), 1.0, 1.0], 1), (304, [1.0], 0), (305, [], 1)]
    rows += [(7, [0.5, 0.5, 0.5], 1), (7, [0.5, 0.5, 0.5], 0)]  # one id in both classes
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    of = {}
    for i, x, _ in rows:
        of.setdefault(i, []).append(x)
    ids = {c: sorted(i for i, _, k in rows if k == c) for c in (0, 1)}

    def apart(a, b):  # null before numbers before NaN, as Spark orders them
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return (0, 0.0)
        total = 0.0
        for u, v in zip(a, b):
            total += (u - v) * (u - v)
        return (2, 0.0) if total != total else (1, total ** 0.5)

    want = {}
    for c in (0, 1):
        other, k = ids[1 - c], min(6, len(ids[1 - c]))
        for pos, i in enumerate(ids[c]):
            for r in range(2):
                met = [other[drawn(pos, r, t, len(other), k, 9)] for t in range(k)]
                best = min((*apart(a, b), o) for o in met for a in of[i] for b in of[o])
                want[i, r, c] = min(want.get((i, r, c), best), best)
    out = hard_negative_pairs(df, n_candidates=6, repeats=2, seed=9)
    got = {}
    for row in out.collect():
        got.setdefault((row["id"], row["repeat"], row["y"]), []).append((row["other_id"], row["x1"], row["x2"]))
    assert {k: {o for o, _, _ in v} for k, v in got.items()} == {k: {v[2]} for k, v in want.items()}
    assert all(len(v) == len(of[k[0]]) * len(of[v[0][0]]) for k, v in got.items())
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()


def folds(df, k):
    found, n = query_folds(df, k)
    return found.collect(), n


def test_whole_queries_balanced(spark):
    sizes = [40, 1, 2, 3, 9, 9, 9, 20, 5, 5, 7, 30]
    rows = [(q, i) for q, n in enumerate(sizes) for i in range(n)] + [(None, i) for i in range(6)]
    df = spark.createDataFrame(rows, "qid long, row_id long")
    got, n = folds(df, 4)
    assert n == 4 and len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r["qid"], set()).add(r["fold"])
    assert all(len(x) == 1 for x in of.values()) and len(of) == 13
    per_fold = Counter(next(iter(x)) for x in of.values())
    assert set(per_fold) == {0, 1, 2, 3} and max(per_fold.values()) - min(per_fold.values()) <= 1
    weight = Counter(r["fold"] for r in got)
    assert max(weight.values()) - min(weight.values()) <= max(sizes)
    assert folds(df, 50)[1] == 13 and {r["fold"] for r in folds(df, 50)[0]} == set(range(13))


def test_single_query(spark):
    rows = [(7, i, i % 2, float(i % 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "qid long, row_id long, label int, a double")
    got, n = folds(df, 100)
    assert n == 4  # rows / 2
    assert sorted(Counter(r["fold"] for r in got).values()) == [2, 2, 2, 3]
    assert cross_validate(df, ["a"], 1.0, k=2).count() == 1
    with pytest.raises(ValueError):
        cross_validate(df.limit(3), ["a"], 1.0)


def test_enrollments_on_either_side(spark):
    day = lambda n: dt.datetime(2024, 1, n, 12)
    raw = [(1, day(1), "server", "access", "o1"), (1, day(2), "browser", "video", "o1"), (2, day(3), "server", "access", "o2"), (9, day(4), "server", "access", "o1")]
    log = spark.createDataFrame(raw, "enrollment_id long, time timestamp, source string, event string, object string")
    enr = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 11, "a")], "enrollment_id long, username long, course_id string")
    obj = spark.createDataFrame([("o1", "a", "video", ""), ("o2", "b", "problem", "")], "module_id string, course_id string, category string, children string")
    whole = build_log(log, enr, obj)
    got = {(r["split"], r["enrollment_id"]): r for r in split_features({
        "train": (whole.where("enrollment_id in (1, 9)"), enr.where("enrollment_id in (1, 3)")),
        "test": (whole.where("enrollment_id = 2"), enr.where("enrollment_id = 2")),
    }).collect()}
    assert set(got) == {("train", 1), ("train", 3), ("train", 9), ("test", 2)}
    assert got["train", 9]["n_records"] == 1 and got["train", 9]["u_n_records"] == 0 and got["train", 9]["course_enroll"] == 0
    assert got["train", 3]["n_records"] == 0 and got["train", 3]["course_enroll"] > 0
    # the user's table counts the logs of both splits
    assert got["train", 1]["u_n_records"] == got["test", 2]["u_n_records"] == 3
    assert all(r[c] is not None for r in got.values() for c in FINAL_FEATURES)
