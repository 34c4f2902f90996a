"""Look-ahead activity after a course ends (C5 + D9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.functions.scalar import count_when
from mooclens.operators.sizing import maybe_broadcast

WINDOW_DAYS = 10


def leak_features(log: DataFrame, course: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """after_n_records / after_n_days per enrollment.

    For an enrollment of user u in course c, count u's log rows in any
    course with course_end < time < course_end + 10 days, where course_end
    is midnight after c's last log date, and the distinct dates of those
    rows. Enrollments without such rows get 0.

    The range join is rewritten exactly as an equi-join: course_end and
    its +10 days are midnights, so the window covers whole days D .. D+9
    except events at exactly midnight of D. The log is first reduced to
    one row per (user, date) with its row count and its count at
    midnight; each enrollment is expanded to its ten dates; both sides
    then join on (username, date). A very active user is spread over many
    dates, and the big side is pre-aggregated before the shuffle.
    """
    user_day = log.groupBy("username", "date").agg(
        F.count(F.lit(1)).alias("_n"),
        count_when(F.col("time").cast("timestamp") == F.col("date").cast("timestamp")).alias("_n0"),
    )
    ends = maybe_broadcast(
        course.select("course_id", F.date_add("end_date", 1).alias("_d0"))
    )
    enr = log.select("enrollment_id", "username", "course_id").distinct()
    days = enr.join(ends, "course_id", "inner").select(
        "enrollment_id", "username", "_d0",
        F.explode(F.sequence(F.col("_d0"), F.date_add("_d0", window_days - 1))).alias("date"),
    )
    hits = days.join(user_day, ["username", "date"], "inner").select(
        "enrollment_id",
        (F.col("_n") - F.when(F.col("date") == F.col("_d0"), F.col("_n0")).otherwise(F.lit(0))).alias("_c"),
    )
    per = hits.groupBy("enrollment_id").agg(
        F.sum("_c").alias("after_n_records"), count_when(F.col("_c") > 0).alias("after_n_days")
    )
    return enr.select("enrollment_id").join(per, "enrollment_id", "left").select(
        "enrollment_id",
        F.coalesce("after_n_records", F.lit(0)).cast("long").alias("after_n_records"),
        F.coalesce("after_n_days", F.lit(0)).cast("long").alias("after_n_days"),
    )
