"""Rows whose query, model or split is NULL form a group like any other."""

import pytest
from pyspark.sql import functions as F

from mooclens.operators import rank, scale

ROWS = [(q, i, y, s) for q in (None, 1, 2) for i, (y, s) in enumerate([(0, 0.3), (1, 0.9), (2, 0.1), (1, 0.3), (0, 0.7), (2, 2.5)])]


@pytest.fixture(params=[False, True], ids=["plain", "split"])
def lines(request, spark):
    if request.param:
        request.getfixturevalue("hot")
    return spark.createDataFrame(ROWS, "qid long, row_id long, label int, score double")


def per_query(rows, *cols):
    found = {}
    for r in rows:
        found.setdefault(r["qid"], []).append(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols))
    return {q: sorted(x, key=repr) for q, x in found.items()}


def alike(found):
    """Every query holds the same rows, so the results must agree."""
    assert set(found) == {None, 1, 2}
    assert found[None] == found[1] == found[2]
    return found[None]


def test_levels_and_violations(lines):
    levels = rank.label_levels(lines)
    assert alike(per_query(levels.collect(), "row_id", "level")) == sorted((r[1], r[2] + 1) for r in ROWS[:6])
    found = alike(per_query(rank.margin_violations(levels.withColumn("z", F.col("score")), "z").collect(), "row_id", "l_plus", "l_minus"))
    z, y = [r[3] for r in ROWS[:6]], [r[2] for r in ROWS[:6]]
    plus = [sum(y[j] > y[i] and z[j] < z[i] + 1 for j in range(6)) for i in range(6)]
    minus = [sum(y[j] < y[i] and z[j] > z[i] - 1 for j in range(6)) for i in range(6)]
    assert found == sorted(zip(range(6), plus, minus))


def test_pairs_and_ndcg(lines):
    rows = [r[2:] for r in ROWS[:6]]
    ranked = [(a, b) for a in rows for b in rows if a[0] > b[0]]
    expect = (len(ranked), sum(a[1] < b[1] for a, b in ranked))
    assert alike(per_query(rank.pair_counts(lines).collect(), "n_pairs", "n_discordant")) == [expect]
    assert len(alike(per_query(rank.ndcg_per_query(lines).collect(), "ndcg"))) == 1
    assert rank.pairwise_accuracy(lines).first()["n_pairs"] == 36


@pytest.mark.parametrize("fn", [scale.rank_calibrate, scale.minmax_calibrate, scale.range_calibrate, scale.std_calibrate])
@pytest.mark.parametrize("keys", [["qid"], ["qid", "split"]])
def test_calibration(lines, fn, keys):
    df = lines.withColumn("split", F.when(F.col("row_id") < 4, "a")).withColumnRenamed("row_id", "enrollment_id")
    found = fn(df, keys).collect()
    assert len(found) == len(ROWS)
    alike(per_query(found, "enrollment_id", "score"))
