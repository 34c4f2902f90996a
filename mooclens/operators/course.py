"""Course-level measures (D5) and per-video / per-problem detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.functions.scalar import count_when

# (output name, source, event) of the nine course counts.
COURSE_EVENT_COUNTS = [
    ("n_server_navigate", "server", "nagivate"),
    ("n_server_access", "server", "access"),
    ("n_server_problem", "server", "problem"),
    ("n_server_discussion", "server", "discussion"),
    ("n_server_wiki", "server", "wiki"),
    ("n_browser_access", "browser", "access"),
    ("n_browser_problem", "browser", "problem"),
    ("n_browser_pageclose", "browser", "page_close"),
    ("n_browser_video", "browser", "video"),
]


def _distinct_when(cond, value="object"):
    return F.count_distinct(F.when(cond, F.col(value)))


def _floor_div(a, b):
    return F.when(F.col(b) > 0, F.floor(F.col(a) / F.col(b)).cast("long"))


def course_info(log: DataFrame) -> DataFrame:
    """One row per course from the joined log.

    start_date / end_date are the first / last log dates, n_enroll the
    distinct users, nine (source, event) row counts, n_video / n_problem
    distinct objects of video / problem events, n_chapter / n_sequential
    distinct objects of that category, floor quotients per chapter (NULL
    without chapters) and v_release_fre = number of distinct dates on
    which some video was first viewed. Missing kinds count 0.
    """
    from mooclens.operators.activity import _object_flags

    ev, src = F.col("event"), F.col("source")
    counts = [count_when((src == s) & (ev == e)).alias(n) for n, s, e in COURSE_EVENT_COUNTS]
    # distinct counts from narrow pre-aggregations (no row expansion)
    rows = log.groupBy("course_id").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), *counts)
    users = log.where(F.col("username").isNotNull()).groupBy("course_id", "username").agg(F.count(F.lit(1)).alias("_c")) \
        .groupBy("course_id").agg(F.count(F.lit(1)).alias("n_enroll"))
    objs = _object_flags(log, ["course_id"]).groupBy("course_id").agg(
        count_when(F.col("_v") == 1).alias("n_video"),
        count_when(F.col("_p") == 1).alias("n_problem"),
        count_when(F.col("_ch") == 1).alias("n_chapter"),
        count_when(F.col("_sq") == 1).alias("n_sequential"),
    )
    # a course without users or objects named in its log counts none
    base = rows.join(users, "course_id", "left").join(objs, "course_id", "left").na.fill(0, [*users.columns[1:], *objs.columns[1:]]).select(
        "course_id", "start_date", "end_date", "n_enroll", *[n for n, _, _ in COURSE_EVENT_COUNTS],
        "n_video", "n_problem", "n_chapter", "n_sequential",
    )
    first_view = (
        log.where(F.col("event") == "video").groupBy("course_id", "object").agg(F.min("date").alias("_first"))
    )
    release = first_view.groupBy("course_id").agg(F.count_distinct("_first").alias("v_release_fre"))
    out = base.join(release, "course_id", "left")
    return out.select(
        *base.columns,
        _floor_div("n_sequential", "n_chapter").alias("s_per_chapter"),
        _floor_div("n_video", "n_chapter").alias("v_per_chapter"),
        _floor_div("n_problem", "n_chapter").alias("p_per_chapter"),
        F.coalesce("v_release_fre", F.lit(0)).cast("long").alias("v_release_fre"),
    )


def object_detail(log: DataFrame, kind: str = "video") -> tuple[DataFrame, DataFrame]:
    """Per-object view detail for ``kind`` in {'video', 'problem'}.

    Returns (summary, daily): summary = (course_id, object, n_view,
    appear_date) with n_view the distinct (user, date) pairs; daily =
    (course_id, object, date, n_users), the date -> count map kept flat.
    """
    views = log.where(F.col("event") == kind).select("course_id", "username", "date", "object").distinct()
    daily = views.groupBy("course_id", "object", "date").agg(F.count(F.lit(1)).alias("n_users"))
    summary = daily.groupBy("course_id", "object").agg(
        F.sum("n_users").alias("n_view"), F.min("date").alias("appear_date")
    )
    return summary, daily


def object_activity_map(daily: DataFrame) -> DataFrame:
    """Nested form of the D6 detail: one row per object with a date -> count map."""
    return daily.groupBy("course_id", "object").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("date", "n_users")))).alias("d_activity")
    )
