"""File readers and writers in the reference's formats (A1-A3, A5-A10,
A13), as Spark reads and writes (no per-file driver loops)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mooclens.operators.objects import explode_children
from mooclens.operators.scale import minmax_calibrate, rank_calibrate

LOG_SCHEMA = "enrollment_id int, time string, source string, event string, object string"
ENROLLMENT_SCHEMA = "enrollment_id int, username string, course_id string"
TRUTH_SCHEMA = "enrollment_id int, label int"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
SPLITS = ["blend", "val", "test"]


def read_log_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1 input: log CSV with header; time parsed as a naive timestamp."""
    df = spark.read.csv(path, header=True, schema=LOG_SCHEMA)
    return df.withColumn("time", F.to_timestamp("time", TIME_FORMAT))


def read_enrollment_csv(spark: SparkSession, path: str) -> DataFrame:
    """A3: enrollment CSV with header; the first column is the key."""
    return spark.read.csv(path, header=True, schema=ENROLLMENT_SCHEMA)


def read_object_csv(spark: SparkSession, path: str) -> DataFrame:
    """A2: object file, five comma fields per line (course_id, module_id,
    category, children, start). The children rule of ``explode_children``
    also drops the header line (its 'children' field has no blank)."""
    f = F.split(F.trim(F.col("value")), ",")
    lines = spark.read.text(path).select(
        F.try_element_at(f, F.lit(1)).alias("course_id"),
        F.try_element_at(f, F.lit(2)).alias("module_id"),
        F.try_element_at(f, F.lit(3)).alias("category"),
        F.coalesce(F.try_element_at(f, F.lit(4)), F.lit("")).alias("children"),
        F.try_element_at(f, F.lit(5)).alias("release_time"),
    )
    return explode_children(lines)


def read_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """A5: ``id,label`` without header."""
    return spark.read.csv(path, header=False, schema=TRUTH_SCHEMA)


def write_answers(df: DataFrame, path: str, id_col: str = "enrollment_id", score_col: str = "score") -> None:
    """``id,score`` lines without header (one CSV folder)."""
    df.select(id_col, score_col).write.mode("overwrite").csv(path, header=False)


def write_rescaled_answers(df: DataFrame, path: str, id_col: str = "enrollment_id", score_col: str = "score") -> None:
    """Min-max rescale the scores (K2), then A8."""
    scaled = minmax_calibrate(df.withColumn("_g", F.lit(0)), ["_g"], score_col)
    write_answers(scaled, path, id_col, score_col)


def write_predictions(scores: DataFrame, path: str) -> None:
    """Score files for many models and splits: one folder per (model,
    split) holding ``id,score`` rows (the long table's partitioned form)."""
    (scores.select("model", "split", F.col("enrollment_id").alias("id"), "score")
     .write.mode("overwrite").partitionBy("model", "split").csv(path, header=True))


def read_predictions(spark: SparkSession, path: str, exclude: list | None = None,
                     calibrate: str | None = "minmax") -> DataFrame:
    """Score files of many models -> long table (model, split,
    enrollment_id, score).

    Accepts the partitioned layout of ``write_predictions`` or flat files
    named ``<model>_<split>.csv``. Header rows (``ID``) are skipped; only
    models that have a blend file are kept; ``exclude`` drops models by
    name; scores are calibrated per (model, split) on reading ('minmax',
    'rank' or None).
    """
    raw = spark.read.option("recursiveFileLookup", "true").csv(path, header=False, schema="id string, score string")
    src = F.input_file_name()
    part_model = F.regexp_extract(src, r"model=([^/]+)/", 1)
    part_split = F.regexp_extract(src, r"split=([^/]+)/", 1)
    flat_model = F.regexp_extract(src, r"/([^/]+)_(blend|val|test)\.csv$", 1)
    flat_split = F.regexp_extract(src, r"/([^/]+)_(blend|val|test)\.csv$", 2)
    df = raw.select(
        F.when(part_model != "", part_model).otherwise(flat_model).alias("model"),
        F.when(part_split != "", part_split).otherwise(flat_split).alias("split"),
        "id", "score",
    ).where((F.upper(F.col("id")) != "ID") & (F.col("split").isin(*SPLITS)))
    df = df.select("model", "split", F.col("id").cast("long").alias("enrollment_id"),
                   F.col("score").cast("double").alias("score"))
    with_blend = df.where(F.col("split") == "blend").select("model").distinct()
    df = df.join(with_blend, "model", "left_semi")
    if exclude:
        df = df.where(~F.col("model").isin(*[str(m) for m in exclude]))
    if calibrate == "minmax":
        df = minmax_calibrate(df, ["model", "split"])
    elif calibrate == "rank":
        df = rank_calibrate(df, ["model", "split"])
    return df


def gather_predictions(spark: SparkSession, paths: list[str], **kw) -> DataFrame:
    """Read several prediction folders; for each (model, split) the
    folder listed last wins, as when later copies overwrite earlier ones."""
    parts = [read_predictions(spark, p, calibrate=None).withColumn("_prio", F.lit(i))
             for i, p in enumerate(paths)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    winner = df.groupBy("model", "split").agg(F.max("_prio").alias("_prio"))
    df = df.join(winner, ["model", "split", "_prio"], "left_semi").drop("_prio")
    cal = kw.get("calibrate", "minmax")
    if cal == "minmax":
        df = minmax_calibrate(df, ["model", "split"])
    elif cal == "rank":
        df = rank_calibrate(df, ["model", "split"])
    return df


def dump_table(df: DataFrame, path: str) -> DataFrame:
    """A10: store an intermediate table (parquet) and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_weights(weights: DataFrame, path: str) -> None:
    """Linear model as a table (model, idx, feature, w)."""
    weights.write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
