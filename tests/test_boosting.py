"""Boosting: slopes against all pairs, falling loss, stopping, going on."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mooclens.operators import boosting


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(240):
        y = i % 2
        data.append((i, i % 3 if i % 5 else None, y if i % 40 else None, rng.gauss(y * 1.2, 1.0), rng.gauss(0, 1) if i % 7 else None, rng.choice([0.0, 1.0])))
    df = spark.createDataFrame(data, "enrollment_id long, qid long, label int, a double, b double, c double")
    return df.where("enrollment_id < 160").cache(), df.where("enrollment_id >= 160").cache()


def test_pairwise_slopes(spark):
    rng = np.random.default_rng(1)
    data = [(i, int(rng.integers(0, 3)), int(rng.integers(1, 4)), float(rng.normal())) for i in range(40)]
    state = spark.createDataFrame(data, "r long, q long, level int, z double")
    got = {r["r"]: r for r in boosting._slopes(state, "pairwise").collect()}

    def loss(z):
        return sum(max(0, 1 - z[a[0]] + z[b[0]]) ** 2 for a in data for b in data if a[1] == b[1] and a[2] > b[2])

    z = np.array([r[3] for r in data])
    assert sum(r["part"] for r in got.values()) == pytest.approx(loss(z), rel=1e-12)
    for k in range(40):
        d = np.zeros(40)
        d[k] = 1e-6
        assert got[k]["g"] == pytest.approx((loss(z + d) - loss(z - d)) / 2e-6, abs=1e-4)
        pairs = sum(a[1] == b[1] and a[2] > b[2] and 1 - z[a[0]] + z[b[0]] > 0 and k in (a[0], b[0]) for a in data for b in data)
        assert got[k]["h"] == 2 * pairs


def test_loss_falls_and_ranks(rows):
    train, valid = rows
    model, losses, checks = boosting.boost(train, ["a", "b", "c"], "pairwise", valid, rounds=6, step=0.3, max_depth=2, every=2, qid="qid")
    assert len(losses) == 6 and all(b < a for a, b in zip(losses, losses[1:]))
    assert [n for n, _ in checks] == [2, 4, 6] and max(x for _, x in checks) > 0.7
    assert len(model.trees) == max(checks, key=lambda c: (c[1], -c[0]))[0]
    found = boosting.score(model, valid).collect()
    assert len(found) == valid.count() and all(0 < r["score"] < 1 for r in found)


def test_going_on_equals_one_run(rows):
    train, valid = rows
    whole, losses, _ = boosting.boost(train, ["a", "b"], rounds=4, step=0.2, max_depth=2)
    half, first, _ = boosting.boost(train, ["a", "b"], rounds=2, step=0.2, max_depth=2)
    rest, second, _ = boosting.boost(train, ["a", "b"], rounds=2, step=0.2, max_depth=2, start=half)
    assert first + second == pytest.approx(losses, rel=1e-9) and len(rest.trees) == 4
    n = train.where("label is not null").count()
    assert losses[0] == pytest.approx(n * math.log(2)) and losses[-1] < losses[0]
    a, b = ({r[0]: r[1] for r in boosting.score(m, valid).collect()} for m in (whole, rest))
    assert a == pytest.approx(b, abs=1e-9)


def test_no_tree_after_patience(rows, monkeypatch):
    """Checks that never gain after the second: stopped, cut to the best."""
    train, valid = rows
    values = iter([0.6, 0.7, 0.7, 0.65, 0.7, 0.9])

    def falling(df, keys, *_):
        return df.sparkSession.createDataFrame([(next(values),)], "auc double")

    monkeypatch.setattr(boosting, "auc", falling)
    model, losses, checks = boosting.boost(train, ["a"], "logistic", valid, rounds=50, max_depth=1, every=1, patience=3)
    assert [a for _, a in checks] == [0.6, 0.7, 0.7, 0.65, 0.7]
    assert len(losses) == 5 and len(model.trees) == 2


def test_without_pairs_or_rows(spark, rows):
    train, _ = rows
    model, losses, checks = boosting.boost(train.where("label = 1"), ["a"], "pairwise", rounds=3)
    assert model.trees == [] and losses == [0.0] and checks == []
    assert boosting.boost(train.where("false"), ["a"], rounds=3)[0].trees == []


def test_a_tree_is_fitted_by_all_tasks(spark, monkeypatch):
    """The sweep of a single query leaves its rows in one task."""
    x = spark.range(120, numPartitions=1).select(F.col("id").alias("enrollment_id"), (F.col("id") % 9).cast("double").alias("a"), (F.col("id") * 5 % 11 > 4).cast("int").alias("label"))
    tasks, fitted = [], boosting.materialize
    monkeypatch.setattr(boosting, "materialize", lambda df, name: (tasks.append(df.rdd.getNumPartitions()) if name == "slopes" else None, fitted(df, name))[1])
    monkeypatch.setattr(boosting, "WIDE_ROWS", 20)
    model, losses, _ = boosting.boost(x, ["a"], "pairwise", rounds=2, max_depth=2)
    assert tasks == [6, 6] and len(model.trees) == 2 and losses[1] < losses[0]


def test_features_stay_out_of_the_sweeps(spark, monkeypatch):
    """Also where a query is huge and ids repeat; nothing stays in memory."""
    from mooclens.session import HOT_ROWS_KEY

    x = spark.range(120).select((F.col("id") % 50).alias("enrollment_id"), (F.col("id") % 9).cast("double").alias("a"), (F.col("id") * 5 % 11 > 4).cast("int").alias("label"))
    seen, swept, before = [], boosting.margin_violations, len(spark.sparkContext._jsc.getPersistentRDDs())
    monkeypatch.setattr(boosting, "margin_violations", lambda state, *a, **k: (seen.append((set(state.columns), k["small"])), swept(state, *a, **k))[1])
    _, losses, _ = boosting.boost(x, ["a"], "pairwise", rounds=3, max_depth=2)
    spark.conf.set(HOT_ROWS_KEY, "119")
    try:
        _, hot, _ = boosting.boost(x, ["a"], "pairwise", rounds=3, max_depth=2)
    finally:
        spark.conf.unset(HOT_ROWS_KEY)
    assert seen == [({"r", "q", "level", "z"}, True)] * 3 + [({"r", "q", "level", "z"}, False)] * 3
    assert hot == pytest.approx(losses, rel=1e-9) and losses[2] < losses[1] < losses[0]
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
