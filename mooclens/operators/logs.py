"""Click-log assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.operators.sizing import maybe_broadcast

LOG_COLUMNS = ["enrollment_id", "time", "source", "event", "object"]

# Fixed value domains of the log (must equal the reference's lists, in its order).
EVENTS = ["problem", "video", "access", "wiki", "discussion", "nagivate", "page_close"]
SOURCES = ["server", "browser"]


def build_log(
    log: DataFrame,
    enrollment: DataFrame,
    objects: DataFrame | None = None,
    fanout: bool = True,
    dedupe: bool = True,
) -> DataFrame:
    """Joined click log: the reference's ``read_log_data`` as one plan.

    ``log`` holds enrollment_id, time, source, event, object (extra
    columns are ignored). Exact duplicate log rows are dropped, username
    and course_id come from ``enrollment`` (left join), ``date`` and the
    time of day are derived, and ``category`` comes from a left join with
    the object table on object = module_id.

    With ``fanout=True`` the object side keeps one row per child, as in the
    reference, so a log row on an object with n children appears n times
    and every later row count includes the copies. ``fanout=False`` joins
    one row per module instead.
    """
    base = log.select(*LOG_COLUMNS)
    if dedupe:
        base = base.distinct()
    enr = enrollment.select("enrollment_id", "username", "course_id")
    out = base.join(enr, "enrollment_id", "left")
    ts = F.col("time").cast("timestamp")
    out = out.select(
        "enrollment_id", "username", "course_id",
        ts.alias("time"),
        ts.cast("date").alias("date"),
        F.date_format(ts, "HH:mm:ss").alias("hour"),
        "source", "event", "object",
    )
    if objects is None:
        return out.withColumn("category", F.lit(None).cast("string"))
    obj_cols = ["module_id", "category"] + (["release_time"] if "release_time" in objects.columns else [])
    obj = objects.select(*obj_cols)
    if not fanout:
        obj = obj.groupBy("module_id").agg(*[F.first(c).alias(c) for c in obj_cols[1:]])
    obj = maybe_broadcast(obj.withColumnRenamed("module_id", "object"))
    return out.join(obj, "object", "left").select(*out.columns, *obj_cols[1:])


def union_logs(*logs: DataFrame) -> DataFrame:
    """Append train and test logs."""
    out = logs[0]
    for other in logs[1:]:
        out = out.unionByName(other)
    return out


def coded_log(log: DataFrame, enrollment: DataFrame, strict: bool = True) -> DataFrame:
    """A4 re-aimed: the per-enrollment log lists as flat coded rows.

    The reference nests each enrollment's events in one list; here every
    event stays a row keyed by enrollment_id (no group is collected into a
    single value). Columns: enrollment_id, username, course_id, t (epoch
    seconds), source / event as indexes into the fixed lists (unknown
    values raise when ``strict``), object. Enrollments without events keep
    one row with NULL event fields, the flat form of an empty list.
    """
    from mooclens.functions.scalar import index_in

    ev = log.select(
        "enrollment_id",
        F.unix_seconds(F.col("time").cast("timestamp")).alias("t"),
        index_in(SOURCES, "source", strict).alias("source_idx"),
        index_in(EVENTS, "event", strict).alias("event_idx"),
        "object",
    )
    enr = enrollment.select("enrollment_id", "username", "course_id")
    return enr.join(ev, "enrollment_id", "left")
