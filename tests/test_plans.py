"""Physical-plan guards for the scale design: no pair enumeration, no
DISTINCT row expansion in the heavy aggregates, pruned scans."""

import contextlib
import io

import pytest

from mooclens.operators import activity, course, leak, sessions, user
from mooclens.plans.queries_features import fx_log

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("build", [
    lambda log: activity.total_activity(log),
    lambda log: course.course_info(log),
    lambda log: activity.daily_long(log, course.course_info(log)),
    lambda log: leak.leak_features(log, course.course_info(log)),
    lambda log: user.user_info(log, sessions.sessions_with_user(
        sessions.gap_sessions(log), log.select("enrollment_id", "username", "course_id").distinct())),
])
def test_no_expand_or_pairs(spark, build):
    plan = _plan(build(fx_log(spark, SF)))
    for op in ("Expand", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert op not in plan, op


def test_flagship_has_no_pair_joins_and_prunes_columns(spark):
    import __spark_entry__ as entry

    plan = _plan(entry.queries()["h15_enrollment_features"](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # the events scan never reads the unused `value` column
    for line in plan.splitlines():
        if "ReadSchema" in line and "event_type" in line:
            assert "value:" not in line, line


def test_ranking_sweeps_have_no_pair_joins(spark):
    import __spark_entry__ as entry

    for name in ("n3_margin_violations", "l3_pairwise_accuracy", "l4_ndcg_per_query"):
        plan = _plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
