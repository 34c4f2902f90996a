"""Per-user measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.operators.sessions import session_stats

USER_FEATURES = [
    "u_n_records", "u_n_enroll", "u_online_day", "u_first_day", "u_last_day", "u_duration",
    "u_n_sessions", "u_t_max", "u_t_mean",
    "u_n_small_session", "u_n_mid_session", "u_n_large_session",
]


def user_info(log: DataFrame, user_sessions: DataFrame) -> DataFrame:
    """Twelve user columns from the log and the sessions of the user's
    enrollments (``user_sessions`` = sessions with username attached).

    u_first_day / u_last_day are whole days since the first day of any
    user (a global minimum, evaluated as a scalar subquery so no cross
    join or single-partition window is needed). Missing session measures
    are 0.
    """
    # two narrow pre-aggregations instead of DISTINCT expansion: per
    # (user, date) row counts and per (user, enrollment) presence
    per_day = log.groupBy("username", "date").agg(F.count("time").alias("_n")).groupBy("username").agg(
        F.sum("_n").alias("u_n_records"),
        F.count(F.when(F.col("date").isNotNull(), 1)).alias("u_online_day"),
        F.min("date").alias("_first"),
        F.max("date").alias("_last"),
    )
    enrolls = log.where(F.col("enrollment_id").isNotNull()).groupBy("username", "enrollment_id").count() \
        .groupBy("username").agg(F.count(F.lit(1)).alias("u_n_enroll"))
    base = per_day.join(enrolls, "username", "left").select(
        "username", "u_n_records", F.coalesce("u_n_enroll", F.lit(0)).alias("u_n_enroll"), "u_online_day",
        "_first", "_last")
    # the first day of any user is the first log date: a one-column scan
    min_day = log.select(F.min("date")).scalar()
    sess = session_stats(user_sessions.where(F.col("username").isNotNull()), "username", "u", "u_n_sessions")
    out = base.join(sess, "username", "left")
    first = F.datediff("_first", min_day)
    last = F.datediff("_last", min_day)
    cols = {
        "u_n_records": F.col("u_n_records"),
        "u_n_enroll": F.col("u_n_enroll"),
        "u_online_day": F.col("u_online_day"),
        "u_first_day": first,
        "u_last_day": last,
        "u_duration": last - first,
    }
    for c in USER_FEATURES[6:]:
        cols[c] = F.coalesce(F.col(c), F.lit(0))
    return out.select("username", *[v.alias(k) for k, v in cols.items()])
