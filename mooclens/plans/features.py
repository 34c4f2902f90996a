"""Logs-to-features plan: the 56-column enrollment feature table.

Stages (all lazy DataFrames): course table, gap sessions, user table,
look-ahead table, then one join per keyed table. Course-level tables are
broadcast after a row-count check; per-enrollment tables are aggregates
keyed by enrollment_id, so they join on matching hash partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.functions.scalar import safe_div, whole_days_between
from mooclens.operators.activity import total_activity
from mooclens.operators.course import course_info
from mooclens.operators.leak import leak_features
from mooclens.operators.sessions import gap_sessions, session_features, sessions_with_user
from mooclens.operators.sizing import maybe_broadcast
from mooclens.operators.user import USER_FEATURES, user_info

FINAL_FEATURES = [
    "n_records", "first_day", "last_day", "online_day",
    "n_server_navigate", "n_server_access", "n_server_problem", "n_server_discussion",
    "n_browser_access", "n_browser_problem", "n_browser_pageclose", "n_browser_video",
    "n_video_object", "n_problem_object", "n_chapter_object", "n_sequential_object",
    "duration", "online_rate",
    "course_s_access", "course_enroll", "course_n_problem", "course_n_chapter",
    "course_n_sequential", "course_video_release",
    "release_rate", "click_video_rate", "click_problem_rate", "click_sequential_rate",
    *USER_FEATURES,
    "s_n_session", "s_t_max", "s_t_mean", "s_n_small_session", "s_n_mid_session", "s_n_large_session",
    "after_n_records", "after_n_days",
    "n_records_rate", "duration_rate", "small_session_rate", "mid_session_rate",
    "large_session_rate", "n_session_rate", "t_max_rate", "t_mean_rate",
]

# (rate column, enrollment measure, user measure)
USER_RATES = [
    ("n_records_rate", "n_records", "u_n_records"),
    ("duration_rate", "duration", "u_duration"),
    ("small_session_rate", "s_n_small_session", "u_n_small_session"),
    ("mid_session_rate", "s_n_mid_session", "u_n_mid_session"),
    ("large_session_rate", "s_n_large_session", "u_n_large_session"),
    ("n_session_rate", "s_n_session", "u_n_sessions"),
    ("t_max_rate", "s_t_max", "u_t_max"),
    ("t_mean_rate", "s_t_mean", "u_t_mean"),
]


@dataclass
class FeatureTables:
    """Shared tables computed from all logs (train and test together)."""

    course: DataFrame
    sessions: DataFrame
    session_info: DataFrame
    user: DataFrame
    leak: DataFrame


def feature_tables(all_log: DataFrame, all_enrollment: DataFrame, interval_minutes: float = 30,
                   store_course: bool = False) -> FeatureTables:
    course = course_info(all_log)
    if store_course:
        # one row per course, read by three consumers and by their broadcast
        # size checks: compute it once
        from mooclens.session import materialize

        course = materialize(course, "course")
    sessions = gap_sessions(all_log, "enrollment_id", interval_minutes)
    session_info = session_features(sessions)
    user = user_info(all_log, sessions_with_user(sessions, all_enrollment))
    leak = leak_features(all_log, course)
    return FeatureTables(course, sessions, session_info, user, leak)


def final_features(log: DataFrame, enrollment: DataFrame, t: FeatureTables, align: str = "left") -> DataFrame:
    """enrollment_id plus the 56 feature columns (double), missing and
    infinite values as 0.

    ``log`` / ``enrollment`` are the split being featurized; ``t`` holds
    the tables built on all logs. ``align='left'`` gives a row to every row of
    ``enrollment``; ``'full'`` (C6) also to enrollments that only the log has:
    their user and course are unknown, so those features are 0.
    """
    act = total_activity(log)
    course = maybe_broadcast(
        t.course.select(
            "course_id",
            F.date_add("end_date", 1).cast("timestamp").alias("_course_end"),
            F.col("n_server_access").alias("course_s_access"),
            F.col("n_enroll").alias("course_enroll"),
            F.col("n_video").alias("_course_n_video"),
            F.col("n_problem").alias("course_n_problem"),
            F.col("n_chapter").alias("course_n_chapter"),
            F.col("n_sequential").alias("course_n_sequential"),
            F.col("v_release_fre").alias("course_video_release"),
        )
    )
    enr = enrollment.select("enrollment_id", "username", "course_id")
    j = (
        enr.join(act, "enrollment_id", align)
        .join(course, "course_id", "left")
        .join(t.user, "username", "left")
        .join(t.session_info, "enrollment_id", "left")
        .join(t.leak, "enrollment_id", "left")
    )
    first = whole_days_between("_course_end", "first_day")
    last = whole_days_between("_course_end", "last_day")
    v = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in j.columns}
    v["first_day"] = F.coalesce(first.cast("double"), F.lit(0.0))
    v["last_day"] = F.coalesce(last.cast("double"), F.lit(0.0))
    v["duration"] = v["first_day"] - v["last_day"]
    v["online_rate"] = safe_div(v["online_day"], v["duration"])
    v["release_rate"] = safe_div(v["course_video_release"], v["_course_n_video"])
    v["click_video_rate"] = safe_div(v["n_video_object"], v["_course_n_video"])
    v["click_problem_rate"] = safe_div(v["n_problem_object"], v["course_n_problem"])
    v["click_sequential_rate"] = safe_div(v["n_sequential_object"], v["course_n_sequential"])
    for name, a, b in USER_RATES:
        v[name] = safe_div(v[a], v[b])
    return j.select("enrollment_id", *[v[c].alias(c) for c in FINAL_FEATURES])


LOG_FIELDS = ["enrollment_id", "username", "course_id", "time", "date", "source", "event", "object", "category"]


def generate_features(log: DataFrame, enrollment: DataFrame, interval_minutes: float = 30,
                      materialize_log: bool = True) -> DataFrame:
    """Single-split convenience: tables and final features on one log.

    The joined log feeds six aggregations; with ``materialize_log`` it is
    written once as parquet in the shared checkpoint folder and read back,
    so its dedupe and joins run once instead of once per consumer.
    """
    if materialize_log:
        from mooclens.session import materialize

        log = materialize(log.select(*LOG_FIELDS), "log")
    tables = feature_tables(log, enrollment, interval_minutes, store_course=materialize_log)
    return final_features(log, enrollment, tables)


def split_features(splits: dict[str, tuple[DataFrame, DataFrame]], interval_minutes: float = 30) -> DataFrame:
    """G1: features of several splits (name: (log, enrollment)) whose course,
    session, user and look-ahead tables are built over the logs of all splits
    together, each split's own activity from its own log. Every enrollment on
    either side of a split has a row: (split, enrollment_id, features)."""
    from mooclens.operators.logs import union_logs
    from mooclens.session import materialize

    logs = [log.select(F.lit(name).alias("split"), *LOG_FIELDS) for name, (log, _) in splits.items()]
    stored = materialize(union_logs(*logs), "split_log")
    everyone = union_logs(*[e.select("enrollment_id", "username", "course_id") for _, e in splits.values()])
    tables = feature_tables(stored.drop("split"), everyone, interval_minutes, store_course=True)
    out = [final_features(stored.where(F.col("split") == name), enrollment, tables, "full").select(F.lit(name).alias("split"), "*")
           for name, (_, enrollment) in splits.items()]
    return union_logs(*out)
