"""Cross-validation by query: one matrix for all folds, measures query by query."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mooclens.operators import rank, ranksvm


def lines(spark, queries=40, seed=4):
    rng = np.random.default_rng(seed)
    data = []
    for q in range(queries):
        for i in range(int(rng.integers(1, 8)) if q else 25):
            y = int(rng.integers(0, 5)) if rng.random() > 0.05 else None
            a = float(np.round(rng.normal(y or 0), 1)) if rng.random() > 0.05 else None
            data.append((q if q != 3 else None, i, y, a, float(np.round(rng.normal(), 1))))
    return spark.createDataFrame(data, "qid long, row_id int, label long, a double, b double")


def test_one_matrix_serves_all_folds(spark, monkeypatch):
    df, kept, stored = lines(spark), [], ranksvm.materialize
    numbered = df.withColumn("row_id", F.row_number().over(Window.partitionBy("qid").orderBy("row_id")))
    with monkeypatch.context() as m:
        m.setattr(ranksvm, "materialize", lambda x, name: (kept.append((name, x._jdf.queryExecution().executedPlan().toString())), stored(x, name))[1])
        got = ranksvm.cross_validate(numbered, ["a", "b"], 1.0, k=3).first()
    assert [name for name, _ in kept] == ["query_sizes", "query_places", "matrix"]
    # rows that lie by query already are shuffled once, by their window
    assert kept[2][1].count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(ranksvm, "WHOLE_ROWS", 0)  # a matrix for each fold, queries in packs
    expect = ranksvm.cross_validate(numbered, ["a", "b"], 1.0, k=3).first()
    assert got.asDict() == pytest.approx(expect.asDict(), rel=1e-9)


def test_scores_of_folds_equal_single_fits(spark):
    df = lines(spark)
    folded, k = ranksvm.query_folds(df, 3)
    batch = ranksvm.RankSVMBatch(folded, ["a", "b"], fold="fold")
    batch.left_out = {f: f for f in range(k)}
    fits = ranksvm.fit_candidates(folded, ["a", "b"], [(1.0, None)] * k, batch=batch)
    key = lambda r: (r["qid"] is None, r["qid"] or 0, r["row_id"])
    got = sorted(batch.scored(dict(enumerate(fits))).collect(), key=key)
    expect = []
    for f in range(k):
        w = ranksvm.rank_svm_fit(folded.where(F.col("fold") != f), ["a", "b"], 1.0)
        assert w == pytest.approx(fits[f], rel=1e-6)
        expect += ranksvm.rank_svm_score(folded.where(F.col("fold") == f), fits[f]).select("qid", "row_id", "label", "fold", "score").collect()
    assert got == sorted(expect, key=key)


def test_measures_without_a_shuffle_equal_the_scans(spark, hot):
    df = lines(spark, seed=9).withColumn("score", F.round(F.col("a") + F.col("b"), 0))
    together = df.coalesce(1)

    def found(x, whole):
        per = rank.ndcg_per_query(x, whole=whole), rank.pair_counts(x, whole=whole)
        if whole:
            assert all("Exchange hashpartitioning" not in y._jdf.queryExecution().executedPlan().toString() for y in per)
        return [{r["qid"]: tuple(r)[1:] for r in y.collect()} for y in per]

    (ndcg, pairs), (by_scans, counted) = found(together, True), found(df.where("label is not null and score is not null"), False)
    assert set(ndcg) == {r["qid"] for r in df.select("qid").distinct().collect()}
    whole_ndcg, whole_pairs = found(together.where("label is not null and score is not null"), True)
    assert whole_pairs == counted and set(whole_ndcg) == set(by_scans)
    assert all(whole_ndcg[q] == pytest.approx(by_scans[q], abs=1e-12) for q in by_scans)
    # a label that is not known stands first in the ideal order, so its query's best gain is 0
    for r in df.groupBy("qid").agg(F.max(F.col("label").isNull()).alias("lacks")).where("lacks").collect():
        assert ndcg[r["qid"]] == (0.0,)


@pytest.mark.parametrize("direction", ["plus", "minus"])
def test_small_queries_are_swept_as_great_ones(monkeypatch, direction):
    rng = np.random.default_rng(2)
    group = np.sort(np.concatenate([rng.integers(0, 60, 240), np.full(50, 61)]))
    group = np.unique(group, return_inverse=True)[1]
    level, key, value = rng.integers(1, 5, len(group)), np.round(rng.normal(size=len(group)), 1), rng.normal(size=len(group))
    some = rank.dominance(group, level, key, value, 1.0, direction)
    monkeypatch.setattr(rank, "PAIR_ROWS", 0)
    none = rank.dominance(group, level, key, value, 1.0, direction)
    assert (some[0] == none[0]).all() and np.allclose(some[1], none[1], atol=1e-12)


def test_a_great_query_is_not_gone_through_for_each_batch(monkeypatch):
    monkeypatch.setattr(rank, "SWEEP_ROWS", 4)
    calls, runs = [], rank._runs
    monkeypatch.setattr(rank, "_runs", lambda x: (calls.append(len(x[0])), runs(x))[1])
    batches = [pa.RecordBatch.from_pydict({"q": [7 + (i > 190), 7 + (i > 190)]}) for i in range(200)]
    found = [g.tolist() for _, g in rank._whole_queries(iter(batches), ["q"])]
    assert sum(map(len, found)) == 400 and sum(calls) < 2000 and len(calls) < 12
