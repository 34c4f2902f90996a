"""SparkSession construction and shared configuration helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Tunables read from the Spark conf so a job (or a test) can change them
# without code changes.
HOT_ROWS_KEY = "mooclens.prefix.hotGroupRows"
BUCKETS_KEY = "mooclens.prefix.buckets"
BROADCAST_ROWS_KEY = "mooclens.broadcast.maxRows"

DEFAULTS = {
    HOT_ROWS_KEY: 4_000_000,
    BUCKETS_KEY: 256,
    BROADCAST_ROWS_KEY: 200_000,
}


def conf_int(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key, str(DEFAULTS[key])))


def builder(master: str | None = None, shuffle_partitions: int | None = None):
    """Session builder with the settings every job here relies on.

    AQE re-plans joins from measured sizes (so small derived tables become
    broadcast joins without hints) and splits skewed shuffle partitions.
    """
    b = SparkSession.builder.appName("mooclens")
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("MOOCLENS_DRIVER_MEMORY", "16g"),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
        "spark.sql.autoBroadcastJoinThreshold": "32MB",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    return b


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    spark = builder(master, shuffle_partitions).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder and is
    only read here. A local session (tests, single machine) without one
    gets a fresh folder under /tmp.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; name a shared folder for checkpoints"
            )
        configured = tempfile.mkdtemp(prefix="mooclens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df, name: str):
    """Write ``df`` as parquet in the shared checkpoint folder and read it
    back: cuts the lineage (recomputation after an executor loss starts
    from the files) and lets later readers prune columns."""
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "mooclens-tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
