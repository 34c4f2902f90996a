"""The older feature set (D13, D15, D16, D18) and class-conditional
histograms (D17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.functions.scalar import count_when
from mooclens.operators.logs import EVENTS, SOURCES
from mooclens.operators.prefix import row_numbers
from mooclens.operators.sizing import maybe_broadcast

#: Columns of the wide one-hot form; ``course_entries`` has no such bound.
MAX_ONE_HOT = 10_000


def legacy_counts(log: DataFrame) -> DataFrame:
    """25 numbers per enrollment: event count, span (last - first
    event, seconds; by time rather than file order), 2 source counts,
    7 event counts and 14 source x event counts."""
    src, ev = F.col("source"), F.col("event")
    t = F.unix_seconds(F.col("time").cast("timestamp"))
    aggs = [F.count(F.lit(1)).alias("n_logs"), (F.max(t) - F.min(t)).alias("span")]
    aggs += [count_when(src == s).alias(f"src_{s}") for s in SOURCES]
    aggs += [count_when(ev == e).alias(f"evt_{e}") for e in EVENTS]
    aggs += [count_when((src == s) & (ev == e)).alias(f"{s}_{e}") for s in SOURCES for e in EVENTS]
    return log.groupBy("enrollment_id").agg(*aggs)


LEGACY_COUNT_COLUMNS = (
    ["n_logs", "span"] + [f"src_{s}" for s in SOURCES] + [f"evt_{e}" for e in EVENTS]
    + [f"{s}_{e}" for s in SOURCES for e in EVENTS]
)


def last_course_time(log: DataFrame) -> DataFrame:
    """Per course, the latest event time (epoch seconds). The
    reference's first-enrollment-counts-0 defect is not reproduced."""
    t = F.unix_seconds(F.col("time").cast("timestamp"))
    return log.groupBy("course_id").agg(F.max(t).alias("course_last_time"))


def course_list(df: DataFrame) -> list[str]:
    """Sorted distinct course ids (a bounded list: one entry per course)."""
    courses = df.select("course_id").distinct()
    rows = courses.limit(MAX_ONE_HOT + 1).collect()
    if len(rows) > MAX_ONE_HOT:
        raise ValueError(f"more than {MAX_ONE_HOT} courses; use course_entries or legacy_entries")
    return sorted(r[0] for r in rows)


def course_one_hot(enrollment: DataFrame, courses: list[str] | None = None) -> DataFrame:
    """One indicator column ``course_<id>`` per course (sorted order)."""
    courses = courses if courses is not None else course_list(enrollment)
    c = F.col("course_id")
    return enrollment.select(
        "enrollment_id", *[(c == x).cast("int").alias(f"course_{x}") for x in courses]
    )


def build_legacy_features(log: DataFrame, enrollment: DataFrame) -> DataFrame:
    """D13 counts, course one-hot and the course's last event time,
    keyed by enrollment_id (enrollments without log rows are left out,
    as the reference deletes them)."""
    counts = legacy_counts(log)
    onehot = course_one_hot(enrollment.select("enrollment_id", "course_id"))
    last = maybe_broadcast(last_course_time(log))
    enr = enrollment.select("enrollment_id", "course_id")
    out = counts.join(enr, "enrollment_id", "inner").join(onehot, "enrollment_id", "inner")
    out = out.join(last, "course_id", "left")
    return out.drop("course_id")


def course_dictionary(df: DataFrame) -> DataFrame:
    """(course_id, idx): a dense number from 0 for each course, in order of
    course_id. Nothing is collected; NULL is no course."""
    courses = df.select("course_id").where(F.col("course_id").isNotNull()).distinct()
    numbered = row_numbers(courses.withColumn("_all", F.lit(0)), ["_all"], ["course_id"], "_n")
    return numbered.select("course_id", (F.col("_n") - 1).alias("idx"))


def course_entries(enrollment: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """D16 for any number of courses: the non-zero cells (enrollment_id, idx,
    value 1.0) of the indicator columns, idx by ``course_dictionary``.
    Enrollments of courses outside the dictionary have no cell."""
    dictionary = course_dictionary(enrollment) if dictionary is None else dictionary
    cells = enrollment.select("enrollment_id", "course_id").join(maybe_broadcast(dictionary), "course_id")
    return cells.select("enrollment_id", "idx", F.lit(1.0).alias("value"))


def legacy_entries(log: DataFrame, enrollment: DataFrame) -> DataFrame:
    """D18 for any number of courses, as sparse cells (enrollment_id, idx,
    value), zeros left out: idx 0 to 24 are the D13 counts in the order of
    ``LEGACY_COUNT_COLUMNS``, 25 the course's last event time, 26 and up the
    course indicators."""
    counts = legacy_counts(log)
    first = len(LEGACY_COUNT_COLUMNS)
    enr = enrollment.select("enrollment_id", "course_id")
    facts = maybe_broadcast(course_dictionary(enr).join(last_course_time(log), "course_id", "left"))
    rows = counts.join(enr, "enrollment_id").join(facts, "course_id", "left")
    cells = [F.struct(F.lit(i).cast("long").alias("idx"), F.col(c).cast("double").alias("value"))
             for i, c in enumerate([*LEGACY_COUNT_COLUMNS, "course_last_time"])]
    cells.append(F.struct((F.col("idx") + (first + 1)).alias("idx"), F.lit(1.0).alias("value")))
    long = rows.select("enrollment_id", F.explode(F.array(*cells)).alias("c")).select("enrollment_id", "c.idx", "c.value")
    return long.where(F.col("idx").isNotNull() & (F.col("value") != 0))


HIST_MEASURES = ["span", "last_offset", "n_logs"]


def class_histograms(log: DataFrame, truth: DataFrame, bins: int = 30) -> DataFrame:
    """Per measure, histograms of positives and negatives on shared
    equal-width bins spanning the positives' range.

    Measures per labelled enrollment: span (last - first event seconds),
    last_offset (last event minus the earliest last event of all labelled
    enrollments), n_logs. Negatives outside the positives' range are
    dropped, the last bin is closed on the right, and each class's counts
    are divided by that class's kept total. Returns (measure, label, bin,
    n, frac); empty bins are not listed.
    """
    t = F.unix_seconds(F.col("time").cast("timestamp"))
    per = log.groupBy("enrollment_id").agg(
        (F.max(t) - F.min(t)).alias("span"), F.max(t).alias("_last"), F.count(F.lit(1)).alias("n_logs")
    ).join(truth.select("enrollment_id", "label"), "enrollment_id", "inner")
    min_last = per.select(F.min("_last")).scalar()
    per = per.withColumn("last_offset", F.col("_last") - min_last)
    long = per.select(
        "label",
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x"))
                            for m in HIST_MEASURES])).alias("m"),
    ).select("label", "m.measure", "m.x")
    rng = maybe_broadcast(
        long.where(F.col("label") == 1).groupBy("measure").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    )
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    raw = F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1)))
    binned = long.join(rng, "measure", "inner").where((x >= lo) & (x <= hi)).withColumn("bin", b)
    counts = binned.groupBy("measure", "label", "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("measure", "label").agg(F.sum("n").alias("_tot"))
    return counts.join(totals, ["measure", "label"]).select(
        "measure", "label", "bin", "n", (F.col("n") / F.col("_tot")).alias("frac")
    )
