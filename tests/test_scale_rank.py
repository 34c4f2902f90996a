"""Hand cases for calibration (K1, K4), A2, L3, L4, N3 against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from mooclens.operators import rank, scale
from mooclens.operators.objects import explode_children


def test_rank_calibrate_hand(spark):
    df = spark.createDataFrame([(1, 0.3), (2, 0.1), (3, 0.2)], "enrollment_id long, score double")
    df = df.withColumn("m", F.lit(0))
    out = {r["enrollment_id"]: r["score"] for r in scale.rank_calibrate(df, ["m"]).collect()}
    assert out == pytest.approx({1: 2 / 3, 2: 0.0, 3: 1 / 3})


def test_std_calibrate_hand(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 2.0)], "id long, score double").withColumn("m", F.lit(0))
    out = {r["id"]: r["score"] for r in scale.std_calibrate(df, ["m"]).collect()}
    assert out == {1: -1.0, 2: 1.0}


def test_children_split(spark):
    df = spark.createDataFrame(
        [("m1", "a b "), ("m2", "a b"), ("m3", ""), ("module_id", "children")], "module_id string, children string")
    got = sorted((r["module_id"], r["children"]) for r in explode_children(df).collect())
    assert got == [("m1", "a"), ("m1", "b"), ("m2", "a"), ("m3", "")]


def test_pairwise_accuracy_ties_are_concordant(spark):
    df = spark.createDataFrame([(0, 1, 1, 0.5), (0, 2, 0, 0.5)], "qid long, row_id int, label int, score double")
    r = rank.pairwise_accuracy(df).first()
    assert r["pairwise_accuracy"] == 1.0 and r["n_pairs"] == 1


def test_ndcg_discount_at_position_two(spark):
    df = spark.createDataFrame([(0, 1, 0, 2.0), (0, 2, 1, 1.0)], "qid long, row_id int, label int, score double")
    assert rank.ndcg_per_query(df).first()["ndcg"] == pytest.approx(0.5)


def _brute_n3(rows, margin=1.0):
    out = {}
    for (q, i, li, zi) in rows:
        lp = gp = lm = gm = 0
        for (q2, j, lj, zj) in rows:
            if q2 != q:
                continue
            if lj > li and zj < zi + margin:
                lp += 1
                gp += zj
            if lj < li and zj > zi - margin:
                lm += 1
                gm += zj
        out[(q, i)] = (lp, round(gp, 9), lm, round(gm, 9))
    return out


@pytest.mark.parametrize("use_hot", [False, True])
def test_margin_violations_brute_force(spark, hot, use_hot):
    s = hot if use_hot else spark
    rnd = random.Random(5)
    rows = [(rnd.randrange(3), i, rnd.randrange(4), float(rnd.randrange(8)) / 2) for i in range(60)]
    df = s.createDataFrame(rows, "qid long, row_id int, label int, z double")
    lv = rank.label_levels(df)
    got = {(r["qid"], r["row_id"]): (r["l_plus"], round(r["gamma_plus"], 9), r["l_minus"], round(r["gamma_minus"], 9))
           for r in rank.margin_violations(lv, "z").collect()}
    assert got == _brute_n3(rows)


def test_pair_counts_brute_force(spark):
    rnd = random.Random(9)
    rows = [(rnd.randrange(4), i, rnd.randrange(3), float(rnd.randrange(5))) for i in range(50)]
    df = spark.createDataFrame(rows, "qid long, row_id int, label int, score double")
    got = {r["qid"]: (r["n_pairs"], r["n_discordant"]) for r in rank.pair_counts(df).collect()}
    ref = {}
    for q in {r[0] for r in rows}:
        rs = [r for r in rows if r[0] == q]
        np_ = sum(1 for a, b in itertools.permutations(rs, 2) if b[2] > a[2])
        nd = sum(1 for a, b in itertools.permutations(rs, 2) if b[2] > a[2] and b[3] < a[3])
        ref[q] = (np_, nd)
    assert got == ref


def test_column_minmax_plan_does_not_grow_with_columns(spark):
    """The bounds are numbers in the plan, not a subquery for each of them."""
    rows = [(1, 0, None, 2.0, 7), (2, 0, None, 4.0, 7), (3, 0, 5.0, None, 7)]
    df = spark.createDataFrame(rows, "id int, zero int, one double, some double, same int")
    out = scale.column_minmax(df, ["zero", "one", "some", "same"])
    assert "ubquery" not in out._jdf.queryExecution().toString()
    assert [tuple(r) for r in out.orderBy("id").collect()] == [
        (1, 0.0, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 0.0, 0.0)]
    empty = scale.column_minmax(df.where("false"), ["some"])
    assert empty.count() == 0 and scale.column_minmax(df, ["some"], fit=df.where("false")).first()["some"] == 2.0


def test_few_levels_of_a_huge_query_need_no_cells(spark, hot, monkeypatch):
    """A huge query with few labels is counted on its distinct scores; one with many by cells, with the same result."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2]), i, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, *map(float, range(9))])) for i in range(150)]
    df = spark.createDataFrame(rows, "qid long, row_id long, label int, score double")
    expect = {}
    for q, _, y, s in rows:  # without label or score: the lowest
        n = expect.setdefault(q, [0, 0])
        for q2, _, y2, s2 in rows:
            if q2 == q and (-1 if y2 is None else y2) > (-1 if y is None else y):
                n[0] += 1
                n[1] += (-1 if s2 is None else s2) < (-1 if s is None else s)
    take = lambda: {r["qid"]: [r["n_pairs"], r["n_discordant"]] for r in rank.pair_counts(df).collect()}
    with monkeypatch.context() as m:
        m.setattr(rank, "FEW_LEVELS", 2)
        assert take() == expect
    monkeypatch.setattr(rank, "_dominance", None)
    assert take() == expect
