"""E1 / E2 hand cases (FIXTURES.md section 3) and B5 class bounds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mooclens.operators.sessions import event_sessions, gap_sessions, session_features


def _log(spark, times, eid=1):
    base = dt.datetime(2024, 1, 1)
    rows = [(eid, base + dt.timedelta(seconds=s)) for s in times]
    return spark.createDataFrame(rows, "enrollment_id long, time timestamp")


def _sessions(df):
    return sorted((r["grp"], r["time"]) for r in gap_sessions(df).collect())


@pytest.mark.parametrize("use_hot", [False, True])
def test_gap_exactly_interval(spark, hot, use_hot):
    s = spark if not use_hot else hot
    # 00:00:00, 00:30:00, 01:00:01 -> groups 0 and 1, both length 0
    assert _sessions(_log(s, [0, 1800, 3601])) == [(0, 0.0), (1, 0.0)]


def test_leading_singleton(spark):
    # 00:00, 01:00, 01:05 -> one session (group 1) of 300 s
    assert _sessions(_log(spark, [0, 3600, 3900])) == [(1, 300.0)]


def test_single_event_has_no_session(spark):
    assert _sessions(_log(spark, [0])) == []


def test_event_sessions_match_session_window(spark):
    df = _log(spark, [0, 1800, 3601, 3700, 9000])
    ours = sorted((r["n_events"], r["start"], r["end"]) for r in event_sessions(df).collect())
    sw = df.groupBy("enrollment_id", F.session_window("time", "30 minutes")).agg(F.count("*").alias("n"))
    ref = sorted((r["n"], r["session_window"]["start"], r["session_window"]["end"]) for r in sw.collect())
    assert ours == ref
    assert [o[0] for o in ours] == [1, 2, 2]


def test_session_length_classes(spark):
    # one enrollment per length: 599, 600, 601, 1800, 1801 s (two events each,
    # gap < 30 min only for the first three, so build lengths from short gaps)
    rows = []
    for eid, length in enumerate([599, 600, 601, 1800, 1801]):
        times, t = [0], 0
        remaining = length
        while remaining > 0:
            step = min(1000, remaining)
            t += step
            times.append(t)
            remaining -= step
        rows += [(eid, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=x)) for x in times]
    df = spark.createDataFrame(rows, "enrollment_id long, time timestamp")
    f = {r["enrollment_id"]: r for r in session_features(gap_sessions(df)).collect()}
    cls = {e: (f[e]["s_n_small_session"], f[e]["s_n_mid_session"], f[e]["s_n_large_session"]) for e in f}
    assert cls == {0: (1, 0, 0), 1: (0, 0, 0), 2: (0, 1, 0), 3: (0, 0, 0), 4: (0, 0, 1)}


def test_hot_path_equals_plain_on_fixture(spark, hot):
    from mooclens.plans.queries_features import fx_log

    sf = "/root/testdata/sf0.001"
    hot.conf.set("mooclens.prefix.hotGroupRows", "20")
    a = sorted(tuple(r) for r in gap_sessions(fx_log(hot, sf)).collect())
    hot.conf.unset("mooclens.prefix.hotGroupRows")
    b = sorted(tuple(r) for r in gap_sessions(fx_log(spark, sf)).collect())
    assert a == b and len(a) > 0
