"""Gap-based sessions (E1), conventional sessions (E2) and their
per-enrollment summary (D8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.functions.scalar import count_when, epoch_micros
from mooclens.operators.prefix import BUCKET, prefix_sums, previous_value, with_buckets

SMALL_SECONDS = 10 * 60
LARGE_SECONDS = 30 * 60


def gap_sessions(log: DataFrame, key: str = "enrollment_id", interval_minutes: float = 30) -> DataFrame:
    """Sessions built from the gaps between consecutive events of a key.

    Follows the reference's definition on the n-1 gaps of a time-ordered
    key: a gap longer than the interval starts a new group (the group
    number is the running count of such gaps, so a group 0 exists only if
    the first gap is short); a session's length is the sum of its gaps
    shorter than the interval. A gap exactly equal to the interval neither
    breaks nor adds. A key with one event has no session.

    Returns (key, grp, time) with time in seconds (double).
    """
    limit = float(interval_minutes) * 60.0
    ev = log.select(key, epoch_micros("time").alias("_t"))
    # one size check / key-range split serves both ordered passes
    ev, split = with_buckets(ev, [key], "_t")
    ev = previous_value(ev, [key], "_t", "_t", "_prev", prebucketed=split)
    gaps = ev.where(F.col("_prev").isNotNull()).select(
        key, "_t", BUCKET, ((F.col("_t") - F.col("_prev")) / F.lit(1_000_000.0)).alias("_gap")
    )
    grouped = prefix_sums(
        gaps, [key], ["_t"], {"grp": (F.col("_gap") > limit).cast("long")}, ties="range", prebucketed=split
    )
    return grouped.groupBy(key, "grp").agg(
        F.sum(F.when(F.col("_gap") < limit, F.col("_gap")).otherwise(F.lit(0.0))).alias("time")
    )


def event_sessions(log: DataFrame, key: str = "enrollment_id", gap_minutes: float = 30) -> DataFrame:
    """Conventional sessionization (E2), equal to ``session_window`` grouping.

    Every event belongs to a session; a new session starts at the first
    event and after any gap longer than ``gap_minutes``. Returns (key,
    session, start, end, n_events) where end = last event + gap, as Spark's
    session windows report it. Runs on the skew-safe scans of
    ``mooclens.operators.prefix`` instead of one task per key.
    """
    gap_us = int(float(gap_minutes) * 60 * 1_000_000)
    ev = log.select(key, epoch_micros("time").alias("_t"))
    ev, split = with_buckets(ev, [key], "_t")
    ev = previous_value(ev, [key], "_t", "_t", "_prev", prebucketed=split)
    starts = (F.col("_prev").isNull() | ((F.col("_t") - F.col("_prev")) > gap_us)).cast("long")
    ev = prefix_sums(ev, [key], ["_t"], {"session": starts}, ties="range", prebucketed=split)
    return ev.groupBy(key, "session").agg(
        F.timestamp_micros(F.min("_t")).alias("start"),
        F.timestamp_micros(F.max("_t") + gap_us).alias("end"),
        F.count(F.lit(1)).alias("n_events"),
    )


def session_stats(sessions: DataFrame, key: str, prefix: str, n_name: str) -> DataFrame:
    """Count, max, mean of non-zero lengths and small / mid / large counts.

    small < 600 s, mid strictly between 600 and 1800 s, large > 1800 s;
    lengths of exactly 600 or 1800 fall in no class.
    """
    t = F.col("time")
    # whole microseconds add up exactly in any order
    micros = F.round(F.when(t != 0, t) * 1_000_000).cast("long")
    return sessions.groupBy(key).agg(
        F.count(t).alias(n_name),
        F.max(t).alias(f"{prefix}_t_max"),
        (F.sum(micros) / (F.count(micros) * F.lit(1e6))).alias(f"{prefix}_t_mean"),
        count_when(t < SMALL_SECONDS).alias(f"{prefix}_n_small_session"),
        count_when((t > SMALL_SECONDS) & (t < LARGE_SECONDS)).alias(f"{prefix}_n_mid_session"),
        count_when(t > LARGE_SECONDS).alias(f"{prefix}_n_large_session"),
    )


SESSION_FEATURES = [
    "s_n_session", "s_t_max", "s_t_mean",
    "s_n_small_session", "s_n_mid_session", "s_n_large_session",
]


def session_features(sessions: DataFrame) -> DataFrame:
    """Per-enrollment session summary (missing values filled later)."""
    return session_stats(sessions, "enrollment_id", "s", "s_n_session")


def sessions_with_user(sessions: DataFrame, enrollment: DataFrame) -> DataFrame:
    """Attach username / course_id to the session rows."""
    return sessions.join(enrollment.select("enrollment_id", "username", "course_id"), "enrollment_id", "left")
