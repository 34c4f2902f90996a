import math
import random

import numpy as np
from mooclens.llm import cover_tree
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, score string, v string"


def plain(rows, k, every):
    good = {}
    for i, e, *_ in rows:
        if i is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        good[i] = [math.floor(256 * float(np.float32(x))) for x in e]
    out = []
    for q, v in good.items():
        if q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good.items() if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_against_all_pairs(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], 0, "x", "y") for i in range(400)]
    rows += [(i, [0.5] * 6, 0, "x", "y") for i in range(400, 460)]  # one vector many times
    rows += [
        (500, None, 0, "x", "y"),
        (510, [], 0, "x", "y"),
        (520, [None] * 6, 0, "x", "y"),
        (530, [float("nan")] * 6, 0, "x", "y"),
        (540, [float("inf")] * 6, 0, "x", "y"),
        (550, [0.1, 0.2], 0, "x", "y"),  # shorter
        (560, [0.0] * 6, 0, "x", "y"),
        (None, [1.0] * 6, 0, "x", "y"),
    ]
    rows.append(rows[0])  # an equal row
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(cover_tree.top_k(df, F.col("vec_id") % 10 == 0, k=5, block_rows=50)) == plain(rows, 5, 10)


def test_few_and_no_candidates(spark):
    two = spark.createDataFrame([(0, [1.0], 0, "", ""), (3, [2.0], 0, "", "")], SCHEMA)
    assert found(cover_tree.top_k(two, F.col("vec_id") % 50 == 0)) == [(0, 1, 3, 256 * 512)]
    one = two.where("vec_id = 0")
    assert found(cover_tree.top_k(one, F.col("vec_id") % 50 == 0)) == []
    assert found(cover_tree.top_k(two.limit(0), F.col("vec_id") % 50 == 0)) == []


def test_tree_covers_and_separates():
    points = np.random.default_rng(0).normal(size=(600, 3))
    t = cover_tree.CoverTree(points)
    seen = {0}
    for n in range(len(t.point)):
        own = t.below(n)
        far = np.sqrt(((points[own] - points[t.point[n]]) ** 2).sum(axis=1)).max()
        assert far <= t.radius[n] + 1e-9
        seen |= set(own.tolist())
        kids = t.point[t.first[n] : t.last[n]]
        if len(own) > cover_tree.FEW + 1:
            d = np.sqrt(((points[kids][:, None] - points[kids][None]) ** 2).sum(axis=2))
            assert d[~np.eye(len(kids), dtype=bool)].min() > t.radius[n] / 2 - 1e-9
    assert len(seen) == len(points)
    rows = np.concatenate([r for r, *_ in t.bundles()])
    assert sorted(rows.tolist()) == list(range(len(points)))
