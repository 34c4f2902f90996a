"""Registered file round trips: fixture tables are written in the
reference's formats under the session's checkpoint folder and read back
with ``mooclens.sources.io``."""

from __future__ import annotations

from pyspark.sql import functions as F

from mooclens.operators import activity, blend
from mooclens.operators.logs import build_log
from mooclens.plans.oracle import rounded, with_ctes
from mooclens.plans.queries_features import fx_log
from mooclens.plans.queries_ranking import scratch_dir
from mooclens.plans.queries_scoring import MINMAX_CTE, cal_scores
from mooclens.plans.registry import query
from mooclens.sources import fixtures as fx
from mooclens.sources import io


def _write_click_files(spark, sf):
    base = scratch_dir(spark, "clicks")
    log = fx.raw_log(spark, sf).select(
        "enrollment_id", F.date_format("time", io.TIME_FORMAT).alias("time"), "source", "event", "object")
    log.write.mode("overwrite").csv(f"{base}/log", header=True)
    fx.enrollment(spark, sf).write.mode("overwrite").csv(f"{base}/enrollment", header=True)
    obj = fx.object_raw(spark, sf).select(F.concat_ws(",", "course_id", "module_id", "category", "children",
                                                      F.lit("2024-01-01T00:00:00")).alias("value"))
    header = spark.createDataFrame([("course_id,module_id,category,children,start",)], "value string")
    obj.unionByName(header).write.mode("overwrite").text(f"{base}/object")
    return base


@query("a1_csv_round_trip", with_ctes("""
SELECT CAST(l.enrollment_id AS INTEGER) AS enrollment_id, CAST(e.username AS VARCHAR) AS username, e.course_id, epoch_us(l.time) AS time_us, l.source, l.event, l.object, o.category
FROM (SELECT DISTINCT enrollment_id, date_trunc('second', time) AS time, source, event, object FROM raw_log) l
LEFT JOIN enrollment e ON l.enrollment_id = e.enrollment_id
LEFT JOIN objects o ON l.object = o.module_id"""))
def a1_csv_round_trip(spark, sf):
    """A1-A3 from CSV / text files: log, enrollment and object readers,
    then the joined log (second-resolution times, as the files hold)."""
    base = _write_click_files(spark, sf)
    log = build_log(io.read_log_csv(spark, f"{base}/log"), io.read_enrollment_csv(spark, f"{base}/enrollment"),
                    io.read_object_csv(spark, f"{base}/object"))
    return log.select("enrollment_id", "username", "course_id", F.unix_micros("time").alias("time_us"),
                      "source", "event", "object", "category")


@query("a2_object_file", with_ctes("SELECT module_id, course_id, category, children FROM objects"))
def a2_object_file(spark, sf):
    """A2 from the text file, header line included (it vanishes)."""
    base = _write_click_files(spark, sf)
    return io.read_object_csv(spark, f"{base}/object").select("module_id", "course_id", "category", "children")


@query("a5_truth_file", with_ctes("SELECT CAST(enrollment_id AS INTEGER) AS enrollment_id, label FROM truth"))
def a5_truth_file(spark, sf):
    path = scratch_dir(spark, "truth")
    fx.truth(spark, sf).write.mode("overwrite").csv(path, header=False)
    return io.read_truth_csv(spark, path)


@query("a6_read_predictions", with_ctes(rounded(
    "SELECT CAST(model AS VARCHAR) AS model, split, enrollment_id, score FROM cal",
    ["model", "split", "enrollment_id"], ["score"]), MINMAX_CTE))
def a6_read_predictions(spark, sf):
    """Score files of 64 models x 3 splits read back, min-max
    calibrated per (model, split) on reading."""
    path = scratch_dir(spark, "preds")
    io.write_predictions(fx.scores(spark, sf), path)
    df = io.read_predictions(spark, path, calibrate="minmax")
    return df.select("model", "split", "enrollment_id", "score")


@query("a7_gather_predictions", with_ctes(rounded("""
SELECT CAST(model AS VARCHAR) AS model, split, enrollment_id, CASE WHEN model < 8 THEN score * 2 ELSE score END AS score
FROM scores""", ["model", "split", "enrollment_id"], ["score"])))
def a7_gather_predictions(spark, sf):
    """Two folders; the second holds models 0-7 again with doubled
    scores and wins for them."""
    s = fx.scores(spark, sf)
    first, second = scratch_dir(spark, "gather1"), scratch_dir(spark, "gather2")
    io.write_predictions(s, first)
    io.write_predictions(s.where(F.col("model") < 8).withColumn("score", F.col("score") * 2), second)
    return io.gather_predictions(spark, [first, second], calibrate=None).select(
        "model", "split", "enrollment_id", "score")


@query("a8_write_answers", with_ctes(rounded(
    "SELECT enrollment_id, 1.0 / (1.0 + exp(-avg(score))) AS score FROM cal WHERE split = 'test' "
    "GROUP BY enrollment_id", ["enrollment_id"], ["score"]), MINMAX_CTE))
def a8_write_answers(spark, sf):
    """Uniform blend of the test split written as ``id,score`` and read back."""
    b = blend.uniform_blend(cal_scores(spark, sf).where(F.col("split") == "test"))
    path = scratch_dir(spark, "answers")
    io.write_answers(b, path)
    return spark.read.csv(path, schema="enrollment_id long, score double")


@query("a9_write_rescaled_answers", with_ctes(rounded("""
SELECT enrollment_id, CASE WHEN max(s) OVER () = min(s) OVER () THEN 0
       ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END AS score FROM (
  SELECT enrollment_id, avg(score) AS s FROM cal WHERE split = 'test' GROUP BY enrollment_id) t""",
    ["enrollment_id"], ["score"]), MINMAX_CTE))
def a9_write_rescaled_answers(spark, sf):
    """Blended test scores min-max rescaled, written, read back."""
    b = blend.uniform_blend(cal_scores(spark, sf).where(F.col("split") == "test"), apply_sigmoid=False)
    path = scratch_dir(spark, "rescaled")
    io.write_rescaled_answers(b, path)
    return spark.read.csv(path, schema="enrollment_id long, score double")


@query("a10_dump_table", with_ctes("""
SELECT enrollment_id, n_records, online_day, n_video_object, n_problem_object, n_chapter_object,
       n_sequential_object FROM activity"""))
def a10_dump_table(spark, sf):
    """A10: an intermediate feature table stored as parquet and reloaded."""
    act = activity.total_activity(fx_log(spark, sf)).select(
        "enrollment_id", "n_records", "online_day", "n_video_object", "n_problem_object",
        "n_chapter_object", "n_sequential_object")
    return io.dump_table(act, scratch_dir(spark, "dump"))
