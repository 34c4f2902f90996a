"""Rows that must not get lost, and work that must not grow with pairs."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mooclens.operators import activity, blend, course, prefix, rank
from mooclens.operators.ranksvm import RankSVMBatch, fit_candidates, minimise
from mooclens.session import BUCKETS_KEY, HOT_ROWS_KEY


@pytest.fixture(params=["plain", "split"])
def path(request, spark):
    """Ordinary windows, and every group of more than three rows split."""
    if request.param == "split":
        spark.conf.set(HOT_ROWS_KEY, "3")
        spark.conf.set(BUCKETS_KEY, "4")
    yield request.param
    spark.conf.unset(HOT_ROWS_KEY)
    spark.conf.unset(BUCKETS_KEY)


def test_null_groups_and_null_order_values(spark, path):
    rows = [(g, o, 1) for g in ("a", None) for o in range(6)] + [("a", None, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = prefix.prefix_sums(df, ["g"], ["o"], {"s": F.col("v")}).collect()
    assert sorted((r["g"] or "", -1 if r["o"] is None else r["o"], r["s"]) for r in got) == sorted(
        (g or "", -1 if o is None else o, 1 if o is None else o + 2) for g, o, _ in rows
    )
    back = prefix.previous_value(df.where("o is not null"), ["g"], "o", "o", "p").collect()
    assert len(back) == 12 and all(r["p"] == (r["o"] - 1 if r["o"] else None) for r in back)


def log_with_null_objects(spark):
    day = datetime.date(2024, 1, 1)
    at = datetime.datetime(2024, 1, 1, 8)
    rows = [(1, "u", "c1", at, day, "browser", "video", "o1", "video"), (2, "w", "c2", at, day, "server", "access", None, None)]
    return spark.createDataFrame(
        rows, "enrollment_id long, username string, course_id string, time timestamp, date date, source string, event string, object string, category string"
    )


def test_null_objects_keep_enrollment_day_and_course(spark):
    log = log_with_null_objects(spark)
    info = course.course_info(log)
    assert {r["course_id"]: (r["n_enroll"], r["n_video"]) for r in info.collect()} == {"c1": (1, 1), "c2": (1, 0)}
    total = {r["enrollment_id"]: (r["n_records"], r["n_video_object"]) for r in activity.total_activity(log).collect()}
    assert total == {1: (1, 1), 2: (1, 0)}
    daily = {(r["enrollment_id"], r["day"]): (r["records"], r["video_object"]) for r in activity.daily_long(log, info).collect()}
    assert daily == {(1, 0): (1, 1), (2, 0): (1, 0)}


def test_every_event_is_in_the_log(spark):
    from mooclens.sources import fixtures

    sf = "/root/testdata/sf0.001"
    assert fixtures.raw_log(spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_many_levels_cost_their_logarithm(spark, path):
    rng = random.Random(4)
    rows = [(1, i, rng.random(), rng.gauss(0, 2)) for i in range(150)] + [(2, i, float(i % 3), rng.gauss(0, 2)) for i in range(40)]
    df = rank.label_levels(spark.createDataFrame(rows, "qid long, row_id long, label double, z double"))
    got = {(r["qid"], r["row_id"]): (r["l_plus"], round(r["gamma_plus"], 6), r["l_minus"], round(r["gamma_minus"], 6)) for r in rank.margin_violations(df, "z").collect()}
    for q, i, y, z in rows:
        own = [r for r in rows if r[0] == q]
        up = [r[3] for r in own if r[2] > y and r[3] < z + 1]
        down = [r[3] for r in own if r[2] < y and r[3] > z - 1]
        assert got[q, i] == (len(up), round(sum(up), 6), len(down), round(sum(down), 6))
    for way in ("plus", "minus"):
        enters, probes = rank._cells(F.col("level"), F.lit(150), way)
        most = df.where("qid = 1").select(F.max(F.size(enters)), F.max(F.size(probes))).first()
        assert max(most) <= math.ceil(math.log2(151)) + 1


def test_ndcg_with_a_label_that_most_rows_share(spark, path):
    rng = random.Random(9)
    rows = [(1, i, int(rng.random() < 0.1), rng.random()) for i in range(60)]
    got = rank.ndcg_per_query(spark.createDataFrame(rows, "qid long, row_id long, label int, score double")).first()["ndcg"]
    disc = lambda k: 1.0 if k <= 2 else 1 / math.log2(k)
    a = np.cumsum([(2 ** r[2] - 1) * disc(k + 1) for k, r in enumerate(sorted(rows, key=lambda r: (-r[3], r[1])))])
    b = np.cumsum([(2**y - 1) * disc(k + 1) for k, y in enumerate(sorted((r[2] for r in rows), reverse=True))])
    assert abs(got - np.mean(a / b)) < 1e-9


def test_models_named_by_strings(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        y = i % 2
        rows += [(i, m, "val", y, y * w + rng.random()) for m, w in (("good", 1.0), ("fair", 0.4), ("bad", -0.5))]
    scores = spark.createDataFrame(rows, "enrollment_id long, model string, split string, label int, score double")
    kept, history = blend.backward_elimination(scores, rule="exhaust")
    assert kept == ["good"] and [h[1] for h in history] == ["bad", "fair"]
    chosen, _ = blend.forward_selection(scores, 2)
    assert chosen[0] == "good"


def test_gradient_and_curvature_by_differences(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 3), int(i), int(rng.integers(0, 4)), *map(float, rng.normal(size=3))) for i in range(45)]
    df = spark.createDataFrame(rows, "qid long, row_id long, label int, a double, b double, c double")
    batch = RankSVMBatch(df, ["a", "b", "c"])
    w, s, h = np.array([0.3, -0.2, 0.1]), np.array([0.5, 1.0, -0.7]), 1e-5
    points = batch.values([(0, 2.0, w), (1, 2.0, w + h * s), (2, 2.0, w - h * s)])
    assert abs((points[1][0] - points[2][0]) / (2 * h) - points[0][1] @ s) < 1e-4
    bend = batch.curvatures([(0, 2.0, w, s)])[0]
    assert np.allclose((points[1][1] - points[2][1]) / (2 * h), bend, atol=1e-3)

    def plain(w):
        x = np.array([r[3:] for r in rows]) @ w
        return w @ w / 2 + 2.0 * sum(
            max(0, 1 - x[i] + x[j]) ** 2 for i, a in enumerate(rows) for j, b in enumerate(rows) if a[0] == b[0] and a[2] > b[2]
        )

    assert abs(points[0][0] - plain(w)) < 1e-6
    fit = fit_candidates(df, ["a", "b", "c"], [(2.0, None)], eps=1e-6)[0]
    best = np.array([fit[c] for c in "abc"])
    assert np.linalg.norm(batch.values([(0, 2.0, best)])[0][1]) < 1e-3
    assert all(plain(best) <= plain(best + d) for d in 0.01 * rng.normal(size=(20, 3)))


def test_minimiser_on_a_quadratic():
    a = np.array([[4.0, 1], [1, 3]])

    class Bowl:
        def value(self, w):
            return 0.5 * w @ a @ w - w.sum(), a @ w - 1

        def curvature(self, w, s):
            return a @ s

    assert np.allclose(minimise(Bowl(), 2, eps=1e-8), np.linalg.solve(a, np.ones(2)))


def test_forward_selection_stops_without_gain(spark):
    """Every added model raises the AUC, and no further one would."""
    rng = random.Random(3)
    rows = []
    for i in range(80):
        y = i % 2
        rows += [(i, m, "val", y, y * w + rng.random()) for m, w in (("a", 0.6), ("b", 0.5), ("c", 0.0), ("d", -0.6))]
    scores = spark.createDataFrame(rows, "enrollment_id long, model string, split string, label int, score double").cache()
    chosen, history = blend.forward_selection(scores)
    values = [h[2] for h in history]
    assert [h[1] for h in history] == chosen and values == sorted(set(values)) and "d" not in chosen
    _, rest = blend.forward_selection(scores, rule="exhaust")
    assert len(rest) == 4 and rest[: len(history)] == history and rest[len(history)][2] <= values[-1]
    assert len(blend.forward_selection(scores, rounds=3, repeat=True, rule="exhaust")[0]) == 3
