"""Skew-safe scans equal plain windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from mooclens.operators.prefix import BUCKET, prefix_sums, previous_value, row_numbers, with_buckets


def _data(spark, n=400, groups=3, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(groups), float(rnd.randrange(50)), rnd.random()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g int, k double, v double")


def test_row_numbers_hot_equals_window(hot):
    df = _data(hot)
    ours = {r["id"]: r["rn"] for r in row_numbers(df, ["g"], ["k", "id"]).collect()}
    w = Window.partitionBy("g").orderBy("k", "id")
    ref = {r["id"]: r["rn"] for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
    assert ours == ref


def test_prefix_sums_range_ties_hot(hot):
    df = _data(hot)
    ours = {r["id"]: round(r["s"], 9) for r in
            prefix_sums(df, ["g"], ["k"], {"s": F.col("v")}, ties="range").collect()}
    w = Window.partitionBy("g").orderBy("k").rangeBetween(Window.unboundedPreceding, 0)
    ref = {r["id"]: round(r["s"], 9) for r in df.select("id", F.sum("v").over(w).alias("s")).collect()}
    assert ours == ref


def test_exclusive_prefix_hot(hot):
    df = _data(hot)
    ours = {r["id"]: r["c"] for r in
            prefix_sums(df, ["g"], ["k", "id"], {"c": F.lit(1)}, inclusive=False).collect()}
    assert sorted(ours.values())[:3] == [0, 0, 0]
    w = Window.partitionBy("g").orderBy("k", "id")
    ref = {r["id"]: r["rn"] - 1 for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
    assert ours == ref


def test_previous_value_hot(hot):
    df = _data(hot).dropDuplicates(["g", "k"])
    ours = {r["id"]: r["p"] for r in previous_value(df, ["g"], "k", "k", "p").collect()}
    w = Window.partitionBy("g").orderBy("k")
    ref = {r["id"]: r["p"] for r in df.select("id", F.lag("k").over(w).alias("p")).collect()}
    assert ours == ref


def test_equal_leading_keys_are_split(hot):
    """90% of a group equal in the leading key: no range holds them all, and
    the positions stay those of one window. Text keys need no cast."""
    rows = [("a", "same" if i % 10 else f"k{i:03d}", i) for i in range(2000)] + [(None, None, i) for i in range(2)]
    df = hot.createDataFrame(rows, "g string, k string, id long")
    split, cut = with_buckets(df, ["g"], ["k", "id"])
    sizes = [r["count"] for r in split.groupBy("g", BUCKET).count().collect()]
    assert cut and max(sizes) < 900
    ours = {(r["g"], r["id"]): r["rn"] for r in row_numbers(df, ["g"], ["k", "id"]).collect()}
    w = Window.partitionBy("g").orderBy("k", "id")
    assert ours == {(r["g"], r["id"]): r["rn"] for r in df.select("g", "id", F.row_number().over(w).alias("rn")).collect()}
