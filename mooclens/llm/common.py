"""Shared helpers: table readers, shared-folder intermediates, registry."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mooclens.session import ensure_checkpoint_dir

#: A word: a maximal run of anything but ASCII white space (space, \t..\r).
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it
    (a local session started elsewhere; on a cluster --py-files does it)."""
    import mooclens

    root = os.path.dirname(os.path.dirname(os.path.abspath(mooclens.__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the folder that spark.checkpoint.dir names
    and read it back. Later jobs start from files that every executor can
    read, so a lost executor never forces the work before them again."""
    ship(df.sparkSession)
    path = os.path.join(
        ensure_checkpoint_dir(df.sparkSession), "mooclens-llm", f"{name}-{uuid.uuid4().hex}"
    )
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: str = "text"):
    """Number of words of a string column; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: str, folds: int):
    """crc32 of the id's decimal text, modulo ``folds`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def least_hashes(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The ``most`` rows of each key (not null) with the least hashes of
    order[0], ties by ``order``. Rows are counted in 4096 ranges of the hash
    first, so that only those of the ranges needed are sorted in one task."""
    cut = rows.withColumn("_hash", F.xxhash64(order[0])).withColumn("_range", F.shiftright("_hash", 52))
    counts = cut.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    lower = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(lower), F.lit(0))).where(F.col("_before") < most)
    few = cut.join(needed.select(key, "_range"), [key, "_range"])
    place = F.row_number().over(Window.partitionBy(key).orderBy("_hash", *order))
    return few.withColumn("_n", place).where(F.col("_n") <= most).select(*rows.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
