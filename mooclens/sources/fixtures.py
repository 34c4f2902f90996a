"""Input tables derived from the driver's parquet files.

The reference consumes click-stream CSVs (log, enrollment, object, truth),
score files and sparse ranking rows. The test tables are TPC-H-ish plus an
``events`` stream, so each input shape is derived from them with the rules
in FIXTURES.md. Both Spark (here) and DuckDB (``mooclens.plans.oracle``)
build the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mooclens.operators.objects import explode_children


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click log as the log CSV would hold it, plus username and course.

    One course per ``k % 5``; course c's log stops at 2024-01-11 + 3c days
    so that later activity of the same user exists (look-ahead feature).
    An event after its course's end belongs to the first course that still
    runs (the last, course 9, has no end), so every event is kept.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    ev = ev.withColumn("k", _k())
    ts = F.col("ts").cast("timestamp")
    # course c still runs on day d after 2024-01-11 if 3c > d
    days = F.datediff(ts.cast("date"), F.lit("2024-01-11").cast("date"))
    runs = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(days / 3) + 1)).cast("bigint")
    course = F.greatest(F.col("k") % 5, runs)
    src = F.when(F.col("event_type").isin("click", "view", "purchase"), "browser").otherwise("server")
    evt = (
        F.when(F.col("event_type") == "view", "video")
        .when(F.col("event_type") == "click", "problem")
        .when(F.col("event_type") == "purchase", "access")
        .when(F.col("event_type") == "signup", "nagivate")
        .otherwise("discussion")
    )
    return ev.select(
        "event_id",
        (F.col("user_id") * 10 + course).alias("enrollment_id"),
        F.col("user_id").alias("username"),
        F.concat(F.lit("c"), course.cast("string")).alias("course_id"),
        ts.alias("time"),
        ts.cast("date").alias("date"),
        src.alias("source"),
        evt.alias("event"),
        F.concat(F.lit("o"), F.col("k").cast("string")).alias("object"),
        "k",
    )


def enrollment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_log(spark, sf_dir).select("enrollment_id", "username", "course_id").distinct()


def object_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course structure rows with the blank-separated children field.

    Chapters list two children with a trailing blank (so the reference's
    split keeps both); other categories have no children.
    """
    ks = raw_log(spark, sf_dir).select("k").distinct()
    kk = F.col("k")
    cat = (
        F.when(kk % 4 == 0, "chapter")
        .when(kk % 4 == 1, "sequential")
        .when(kk % 4 == 2, "video")
        .otherwise("problem")
    )
    children = F.when(
        kk % 4 == 0,
        F.concat(F.lit("o"), (kk + 1).cast("string"), F.lit(" o"), (kk + 2).cast("string"), F.lit(" ")),
    ).otherwise(F.lit(""))
    return ks.select(
        F.concat(F.lit("o"), kk.cast("string")).alias("module_id"),
        F.concat(F.lit("c"), (kk % 5).cast("string")).alias("course_id"),
        cat.alias("category"),
        children.alias("children"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object table after the children split (one row per child)."""
    return explode_children(object_raw(spark, sf_dir))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrollment(spark, sf_dir).select(
        "enrollment_id", F.when(F.col("enrollment_id") % 3 == 0, 1).otherwise(0).alias("label")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long score table: 64 "models" x one score per id, three splits."""
    emb = table(spark, sf_dir, "embeddings")
    vid = F.col("vec_id")
    return emb.select(
        vid.alias("enrollment_id"),
        F.posexplode("embedding").alias("model", "score"),
        F.when(vid % 5 < 2, "blend").when(vid % 5 == 2, "val").otherwise("test").alias("split"),
        F.when(F.col("label") >= 5, 1).otherwise(0).alias("label"),
    ).select(
        "enrollment_id", F.col("model").cast("int").alias("model"),
        F.col("score").cast("double").alias("score"), "split", "label",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem rows numbered inside each order (the order is the query)."""
    # named before the window: what reads the rows by query finds them shuffled by it
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "qid")
    w = Window.partitionBy("qid").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
    )
    return li.select(
        "qid",
        F.row_number().over(w).cast("int").alias("row_id"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, row_id, label, score): labels 0-5 from quantity, score = price."""
    return lines(spark, sf_dir).select(
        "qid", "row_id",
        F.floor(F.col("l_quantity") / 10).cast("int").alias("label"),
        F.col("l_extendedprice").alias("score"),
    )


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sparse rows (qid, row_id, idx, value), zeros left out."""
    # one pass over the numbered lines gives all their entries
    columns = ((1, "l_quantity"), (2, "l_discount"), (3, "l_tax"))
    entries = F.array(*[F.struct(F.lit(i).alias("idx"), F.col(c).alias("value")) for i, c in columns])
    return lines(spark, sf_dir).select("qid", "row_id", F.inline(entries)).where(F.col("value") != 0)


def sparse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-row label and qid for the sparse rows (label = ranking label)."""
    return ranking(spark, sf_dir).select("qid", "row_id", F.col("label").cast("double").alias("label"))
