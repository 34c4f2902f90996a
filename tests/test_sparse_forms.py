"""Sparse D16 and D18 for any number of courses, M7 for several classes, D12 by date."""

import datetime as dt
import math

from pyspark.sql import functions as F

from mooclens.operators import activity, legacy, sparse
from mooclens.sources import fixtures


def test_twenty_thousand_courses(hot):
    """No bound on the courses; the dictionary's numbering is split too."""
    hot.conf.set("mooclens.prefix.hotGroupRows", "5000")
    enrollment = hot.range(30_000).select(F.col("id").alias("enrollment_id"), F.format_string("c%05d", F.col("id") % 20_000).alias("course_id"))
    cells = {r["enrollment_id"]: r["idx"] for r in legacy.course_entries(enrollment).collect()}
    assert len(cells) == 30_000 and all(idx == e % 20_000 for e, idx in cells.items())


def test_null_and_unknown_courses(spark):
    known = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "course_id string")
    enrollment = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "enrollment_id long, course_id string")
    cells = legacy.course_entries(enrollment, legacy.course_dictionary(known)).collect()
    assert sorted((r["enrollment_id"], r["idx"], r["value"]) for r in cells) == [(1, 0, 1.0), (2, 1, 1.0)]
    assert legacy.course_dictionary(known.where("false")).count() == 0


def test_entries_hold_the_wide_form(spark):
    t = dt.datetime(2014, 5, 1, 12)
    rows = [(1, "a", t, "server", "access"), (1, "a", t + dt.timedelta(hours=3), "browser", "video"), (2, "b", t, "browser", "problem")]
    log = spark.createDataFrame(rows, "enrollment_id long, course_id string, time timestamp, source string, event string")
    enrollment = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "enrollment_id long, course_id string")
    names = [*legacy.LEGACY_COUNT_COLUMNS, "course_last_time", "course_a", "course_b", "course_c"]
    wide = legacy.build_legacy_features(log, enrollment).collect()
    expect = {(r["enrollment_id"], i, float(r[c])) for r in wide for i, c in enumerate(names) if r[c]}
    got = legacy.legacy_entries(log, enrollment).collect()
    assert len(got) == len(expect) and {tuple(r) for r in got} == expect


def test_multiclass_by_hand(spark):
    weights = spark.createDataFrame([(0, 1, 1.0), (1, 1, -1.0), (2, 2, 0.5)], "class int, idx int, w double")
    entries = spark.createDataFrame([("x", 1, 2.0), ("x", 9, 5.0), ("y", 1, -1.0), ("y", 2, 2.0)], "id string, idx int, value double")
    rows = spark.createDataFrame([("x",), ("y",), ("none",)], "id string")
    got = {(r["id"], r["class"]): r for r in sparse.multiclass_scores(entries, weights, ["id"], rows).collect()}
    z = {"x": [2.0, -2.0, 0.0], "y": [-1.0, 1.0, 1.0], "none": [0.0] * 3}
    best = {"x": 0, "y": 1, "none": 0}  # ties: the least class
    assert len(got) == 9
    for k, zs in z.items():
        p = [1 / (1 + math.exp(-v)) for v in zs]
        for c in range(3):
            r = got[k, c]
            assert r["z"] == zs[c] and abs(r["p"] - p[c] / sum(p)) < 1e-12 and r["predicted"] == (best[k] == c)


def test_dates_wide(spark):
    d1, d2 = dt.date(2014, 5, 1), dt.date(2014, 5, 3)
    t = dt.datetime(2014, 5, 1)
    log = spark.createDataFrame([(1, d1, t), (1, d1, t), (1, d2, t), (2, d2, t)], "enrollment_id long, date date, time timestamp")
    wide = activity.exact_date_wide(log, "enrollment_id", activity.log_dates(log))
    assert wide.columns == ["enrollment_id", "2014-05-01", "2014-05-03"]
    assert sorted(map(tuple, wide.collect())) == [(1, 2, 1), (2, 0, 1)]


def test_multiclass_keeps_one_row_for_each_entry(spark):
    """No row for each entry and class: classes are sums side by side, and
    the weights are worked out once."""
    weights = spark.createDataFrame([(0, 1, 1.0), (1, 1, -1.0), (None, 1, 3.0)], "class int, idx int, w double")
    entries = spark.createDataFrame([("x", 1, 2.0)], "id string, idx int, value double")
    out = sparse.multiclass_scores(entries, weights, ["id"], entries.select("id"))
    before_sums = out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [id")[1]
    assert "Generate" not in before_sums and "collect_list" not in before_sums
    assert sorted((r["class"], r["z"], r["predicted"]) for r in out.collect()) == [(0, 2.0, True), (1, -2.0, False)]
    assert sparse.multiclass_scores(entries, weights.where("false"), ["id"], entries.select("id")).count() == 0


def test_parse_works_each_step_out_once(spark):
    """The rejects' filter repeats no step of the parse, whatever the line."""
    lines = [("1 qid:3 1:2 2:3",), ("x 1:2",), ("1 1:a",), ("1 3:1 2:1",), ("1 0:4",), ("   ",), (None,), ("1 qid:x",), ("1 1:2 1:3",), ("1 1:2:3",)]
    rows, entries, rejects = sparse.parse_svmlight(spark.createDataFrame(lines, "value string"))
    assert rejects._jdf.queryExecution().optimizedPlan().toString().count("split(trim(") == 1
    reasons = sorted(r["reason"] for r in rejects.collect())
    assert reasons == sorted(["bad label", "bad feature token", "indices not ascending", "bad feature token", "empty line",
                              "bad qid", "indices not ascending", "bad feature token", "bad label"]) and rows.count() == 1
    assert sorted((r["idx"], r["value"]) for r in entries.collect()) == [(1, 2.0), (2, 3.0)]


def test_sparse_entries_come_from_one_pass(spark, tmp_path):
    rows = [(1, 1, 1, 1, 5.0, 9.0, 0.0, 0.1), (1, 2, 1, 1, 0.0, 9.0, None, 0.2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double") \
        .withColumn("l_shipdate", F.lit(dt.datetime(1995, 1, 1))).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = fixtures.sparse(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, 5.0), (1, 1, 3, 0.1), (1, 2, 3, 0.2)]
