"""Per-enrollment activity: totals (D10), 30-day daily grid (D11), exact
calendar dates (D12), daily area (D14) and moving means (E5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.functions.scalar import count_when
from mooclens.operators.sizing import maybe_broadcast

# D10 row counts: (name, source, event). server/wiki is not part of D10.
TOTAL_EVENT_COUNTS = [
    ("n_server_navigate", "server", "nagivate"),
    ("n_server_access", "server", "access"),
    ("n_server_problem", "server", "problem"),
    ("n_server_discussion", "server", "discussion"),
    ("n_browser_access", "browser", "access"),
    ("n_browser_problem", "browser", "problem"),
    ("n_browser_pageclose", "browser", "page_close"),
    ("n_browser_video", "browser", "video"),
]

ACTIVITY_FEATURES = (
    ["n_records", "first_day", "last_day", "online_day"]
    + [n for n, _, _ in TOTAL_EVENT_COUNTS]
    + ["n_video_object", "n_problem_object", "n_chapter_object", "n_sequential_object"]
)


def _object_flags(log: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, object) with whether it saw a video / problem
    event and its category flags: the input of the distinct-object counts."""
    ev, cat = F.col("event"), F.col("category")
    # distinct counts ignore NULL objects
    return log.where(F.col("object").isNotNull()).groupBy(*keys, "object").agg(
        F.max((ev == "video").cast("int")).alias("_v"),
        F.max((ev == "problem").cast("int")).alias("_p"),
        F.max((cat == "chapter").cast("int")).alias("_ch"),
        F.max((cat == "sequential").cast("int")).alias("_sq"),
    )


def total_activity(log: DataFrame) -> DataFrame:
    """Sixteen columns per enrollment.

    Two narrow pre-aggregations instead of five DISTINCT aggregates (which
    Catalyst would evaluate by copying every log row five more times):
    per (enrollment, date) partial counts give the row counts, first / last
    time and online days; per (enrollment, object) type flags give the
    distinct-object counts. Both shrink the data before their shuffle.
    first_day / last_day are the first and last event timestamps here;
    the final feature table turns them into days before the course end.
    """
    ev, src = F.col("event"), F.col("source")
    daily = log.groupBy("enrollment_id", "date").agg(
        F.count("time").alias("_n"), F.min("time").alias("_first"), F.max("time").alias("_last"),
        *[count_when((src == s) & (ev == e)).alias(n) for n, s, e in TOTAL_EVENT_COUNTS],
    )
    per_day = daily.groupBy("enrollment_id").agg(
        F.sum("_n").alias("n_records"),
        F.min("_first").alias("first_day"),
        F.max("_last").alias("last_day"),
        F.count(F.when(F.col("date").isNotNull() & (F.col("_n") > 0), 1)).alias("online_day"),
        *[F.sum(n).alias(n) for n, _, _ in TOTAL_EVENT_COUNTS],
    )
    objects = _object_flags(log, ["enrollment_id"]).groupBy("enrollment_id").agg(
        count_when(F.col("_v") == 1).alias("n_video_object"),
        count_when(F.col("_p") == 1).alias("n_problem_object"),
        count_when(F.col("_ch") == 1).alias("n_chapter_object"),
        count_when(F.col("_sq") == 1).alias("n_sequential_object"),
    )
    return per_day.join(objects, "enrollment_id", "left").na.fill(0, objects.columns[1:]).select("enrollment_id", *ACTIVITY_FEATURES)


# The 13 daily measures, in the reference's column order: (suffix, source, event).
DAILY_COUNTS = [
    ("s_navigate", "server", "nagivate"),
    ("s_access", "server", "access"),
    ("s_problem", "server", "problem"),
    ("s_discussion", "server", "discussion"),
    ("s_wiki", "server", "wiki"),
    ("b_access", "browser", "access"),
    ("b_problem", "browser", "problem"),
    ("b_pageclose", "browser", "page_close"),
    ("b_video", "browser", "video"),
]
DAILY_MEASURES = ["records"] + [n for n, _, _ in DAILY_COUNTS] + ["video_object", "pro_object", "seq_object"]
N_DAYS = 30


def daily_long(log: DataFrame, course: DataFrame, n_days: int = N_DAYS) -> DataFrame:
    """D11 in long form: (enrollment_id, day, 13 measures) for days
    0..n_days-1 after the course start; other days are ignored. Row
    counts and distinct-object counts come from two pre-aggregations
    (per (enrollment, day) and per (enrollment, day, object)), joined."""
    starts = maybe_broadcast(course.select("course_id", F.col("start_date").alias("_start")))
    ev, src = F.col("event"), F.col("source")
    dated = log.join(starts, "course_id", "inner").withColumn("day", F.datediff("date", "_start"))
    dated = dated.where((F.col("day") >= 0) & (F.col("day") < n_days))
    counts = dated.groupBy("enrollment_id", "day").agg(
        F.count("time").alias("records"),
        *[count_when((src == s) & (ev == e)).alias(n) for n, s, e in DAILY_COUNTS],
    )
    objects = _object_flags(dated, ["enrollment_id", "day"]).groupBy("enrollment_id", "day").agg(
        count_when(F.col("_v") == 1).alias("video_object"),
        count_when(F.col("_p") == 1).alias("pro_object"),
        count_when(F.col("_sq") == 1).alias("seq_object"),
    )
    return counts.join(objects, ["enrollment_id", "day"], "left").na.fill(0, objects.columns[2:]).select("enrollment_id", "day", *DAILY_MEASURES)


def daily_column(day: int, measure: str) -> str:
    return f"n_{day}_{measure}"


def daily_wide(log: DataFrame, course: DataFrame, n_days: int = N_DAYS) -> DataFrame:
    """13 x n_days columns n_{day}_{measure} per enrollment with any
    log row (0 where nothing happened), day-major as in the reference."""
    long = daily_long(log, course, n_days)
    piv = long.groupBy("enrollment_id").pivot("day", list(range(n_days))).agg(
        *[F.first(m).alias(m) for m in DAILY_MEASURES]
    )
    ids = log.select("enrollment_id").distinct()
    out = ids.join(piv, "enrollment_id", "left")
    cols = []
    for d in range(n_days):
        for m in DAILY_MEASURES:
            cols.append(F.coalesce(F.col(f"`{d}_{m}`"), F.lit(0)).cast("long").alias(daily_column(d, m)))
    return out.select("enrollment_id", *cols)


def daily_area(long: DataFrame, enrollments: DataFrame, n_days: int = N_DAYS) -> DataFrame:
    """Trapezoid area of each measure's n_days daily values on
    x = 1/n .. 1: (2 * sum(v) - v_first - v_last) / (2 n). Columns
    ``{measure}_auc`` for each row of ``enrollments`` (enrollment_id); one
    without a day in ``long`` has area 0."""
    d = F.col("day")
    weight = F.lit(2.0) - (d == 0).cast("double") - (d == n_days - 1).cast("double")
    area = long.groupBy("enrollment_id").agg(
        *[(F.sum(F.col(m) * weight) / F.lit(2.0 * n_days)).alias(f"{m}_auc") for m in DAILY_MEASURES]
    )
    return enrollments.join(area, "enrollment_id", "left").na.fill(0.0, area.columns[1:])


def exact_date_counts(log: DataFrame, key: str = "enrollment_id") -> DataFrame:
    """D12 in long form: rows per (key, calendar date)."""
    return log.groupBy(key, "date").agg(F.count("time").alias("n"))


def log_dates(log: DataFrame) -> list:
    """The calendar dates of the log, ascending (one a day, so bounded)."""
    return [r[0] for r in log.select("date").where(F.col("date").isNotNull()).distinct().orderBy("date").collect()]


def exact_date_wide(log: DataFrame, key: str, dates: list) -> DataFrame:
    """D12 pivoted on a given date list (fixed schema), 0-filled."""
    long = exact_date_counts(log, key)
    piv = long.groupBy(key).pivot("date", dates).agg(F.first("n"))
    return piv.select(key, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(str(c)) for c in piv.columns[1:]])


def smooth_daily(long: DataFrame, by: int = 3, n_days: int = N_DAYS, measures: list[str] | None = None) -> DataFrame:
    """E5 on the long daily form: value at day c = mean of days c..c+by-1
    (missing days are 0, as in the 0-filled grid); the last by-1 days are
    dropped. Each row is spread to the windows that contain it and summed,
    so no window function or wide row is needed."""
    measures = measures or DAILY_MEASURES
    last = n_days - by
    lo = F.greatest(F.lit(0), F.col("day") - (by - 1))
    hi = F.least(F.lit(last), F.col("day"))
    spread = long.where(F.col("day") <= n_days - 1).select(
        "enrollment_id", *measures, F.explode(F.sequence(lo, hi)).alias("_c")
    )
    return spread.groupBy("enrollment_id", F.col("_c").alias("day")).agg(
        *[(F.sum(m) / F.lit(float(by))).alias(m) for m in measures]
    )


def smooth_columns(df: DataFrame, cols: list[str], by: int = 3) -> DataFrame:
    """E5 on a wide table: column c = mean of cols c..c+by-1 skipping NULL/NaN."""
    out = []
    for i in range(len(cols) - by + 1):
        win = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols[i:i + by]]
        s = sum((F.coalesce(w, F.lit(0.0)) for w in win), F.lit(0.0))
        n = sum((w.isNotNull().cast("int") for w in win), F.lit(0))
        out.append(F.when(n > 0, s / n).alias(cols[i]))
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *out)
