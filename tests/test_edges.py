"""Edge cases: look-ahead window bounds, svm-scale implicit zeros, the
ranking-SVM golden model, histogram last bin, sparse text rejects."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mooclens.operators.course import course_info
from mooclens.operators.leak import leak_features


def _log(spark, rows):
    schema = ("enrollment_id long, username string, course_id string, time timestamp, date date, "
              "source string, event string, object string, category string")
    out = []
    for eid, user, course, t in rows:
        out.append((eid, user, course, t, t.date(), "server", "access", "o1", None))
    return spark.createDataFrame(out, schema)


def test_leak_window_bounds_match_range_join(spark):
    d = dt.datetime
    rows = [
        (1, "u", "c1", d(2024, 1, 5, 10)),          # course c1 ends 2024-01-05 -> window (01-06 00:00, 01-16 00:00)
        (2, "u", "c2", d(2024, 1, 6, 0, 0, 0)),     # exactly at course_end: excluded
        (2, "u", "c2", d(2024, 1, 6, 0, 0, 1)),     # just after: included
        (2, "u", "c2", d(2024, 1, 15, 23, 59, 59)),  # last second of day D+9: included
        (2, "u", "c2", d(2024, 1, 16, 0, 0, 0)),    # D+10 midnight: excluded
        (3, "v", "c1", d(2024, 1, 2, 8)),
    ]
    log = _log(spark, rows)
    got = {r["enrollment_id"]: (r["after_n_records"], r["after_n_days"])
           for r in leak_features(log, course_info(log)).collect()}
    # brute force: the reference's range condition
    ends = {r["course_id"]: dt.datetime.combine(r["end_date"], dt.time()) + dt.timedelta(days=1)
            for r in course_info(log).collect()}
    ref = {}
    for eid, user, course, _ in rows:
        c_end = ends[course]
        hits = [t for e2, u2, _, t in rows if u2 == user and c_end < t < c_end + dt.timedelta(days=10)]
        ref[eid] = (len(hits), len({t.date() for t in hits}))
    assert got == ref
    assert got[1] == (2, 2)


def test_svm_scale_implicit_zeros(spark):
    from mooclens.operators.sparse import apply_scale, scale_factors

    rows = spark.createDataFrame([(1,), (2,), (3,)], "r int")
    entries = spark.createDataFrame([(1, 1, 2.0), (2, 1, 4.0), (1, 2, 5.0), (2, 2, 5.0), (3, 2, 5.0)],
                                    "r int, idx int, value double")
    fac = scale_factors(entries, rows)
    got = sorted((r["r"], r["idx"], r["value"]) for r in apply_scale(entries, rows, fac, ["r"]).collect())
    # feature 1 is missing in row 3 -> min 0, max 4: 2 -> 0 (not written), 4 -> 1, implicit 0 -> -1
    # feature 2 is single-valued in every row -> dropped
    assert got == [(2, 1, 1.0), (3, 1, -1.0)]


def test_rank_svm_golden_model(spark):
    from mooclens.operators.ranksvm import rank_svm_fit

    df = spark.createDataFrame([(0, 1, 1.0, 0.1, 0.1, 0.0004), (0, 2, 0.0, 0.01, 0.01, 0.0002)],
                               "qid long, row_id int, label double, f1 double, f2 double, f3 double")
    w = rank_svm_fit(df, ["f1", "f2", "f3"], C=0.001, drop="f3")
    assert w["f1"] == pytest.approx(0.0001799941681889507, rel=1e-12)
    assert w["f2"] == pytest.approx(0.0001799941681889507, rel=1e-12)


def test_histogram_last_bin_closed(spark):
    from mooclens.operators.legacy import class_histograms

    d = dt.datetime(2024, 1, 1)
    # positives with 1, 2 and 31 events: n_logs range [1, 31]; 31 falls in the last bin
    rows, eid = [], 0
    for n in (1, 2, 31):
        eid += 1
        rows += [(eid, "u", "c", d + dt.timedelta(minutes=i)) for i in range(n)]
    log = _log(spark, rows)
    truth = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "enrollment_id long, label int")
    h = {r["bin"]: r["n"] for r in class_histograms(log, truth).where(F.col("measure") == "n_logs").collect()}
    assert h == {0: 1, 1: 1, 29: 1}


def test_svmlight_rejects(spark):
    from mooclens.operators.sparse import parse_svmlight

    lines = spark.createDataFrame([("1 qid:3 1:0.5 4:2",), ("0 2:1",), ("x 1:1",), ("1 2:1 1:1",), ("",)],
                                  "value string")
    rows, entries, rejects = parse_svmlight(lines)
    assert sorted(r["reason"] for r in rejects.collect()) == ["bad label", "empty line", "indices not ascending"]
    assert sorted((r["label"], r["qid"]) for r in rows.collect()) == [(0.0, 0), (1.0, 3)]
    assert entries.count() == 3


def test_sparse_scaling_with_defaults(spark, tmp_path):
    """Absent entries have the feature's default; entries at it need no row."""
    from mooclens.operators.sparse import load_factors, save_factors, scale_factors, scale_sparse

    rows = spark.createDataFrame([(1,), (2,), (3,)], "r int")
    entries = spark.createDataFrame([(1, 1, 2.0), (2, 1, 4.0), (1, 2, 5.0), (2, 2, 5.0), (3, 2, 5.0), (1, 3, -1.0), (2, 3, 0.0), (3, 3, 1.0)],
                                    "r int, idx int, value double")
    save_factors(scale_factors(entries, rows), str(tmp_path / "factors"))
    scaled, defaults = scale_sparse(entries, load_factors(spark, str(tmp_path / "factors")))
    assert sorted(map(tuple, defaults.collect())) == [(1, -1.0), (3, 0.0)]
    # feature 1: min 0 (absent in row 3), so 2 -> 0 and 4 -> 1; feature 2 is single-valued; 0 of feature 3 is its default
    assert sorted((r["r"], r["idx"], r["value"]) for r in scaled.collect()) == [(1, 1, 0.0), (1, 3, -1.0), (2, 1, 1.0), (3, 3, 1.0)]
    other = spark.createDataFrame([(9, 1, 8.0), (9, 7, 1.0)], "r int, idx int, value double")
    assert [tuple(r) for r in scale_sparse(other, load_factors(spark, str(tmp_path / "factors")))[0].collect()] == [(9, 1, 3.0)]
    assert scale_sparse(other.where("false"), scale_factors(other.where("false"), rows))[0].count() == 0
