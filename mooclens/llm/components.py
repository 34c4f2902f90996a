"""Connected components by distributed union-find: every round hooks each
node and its neighbours to the least node seen (large star, then small
star) until only stars are left. Edges never leave the executors; the driver
sees a count and a checksum for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _hook(edges: DataFrame, undirected: bool) -> DataFrame:
    """Neighbours (v) of each node (u) are tied to the least of them and u.
    The least comes from an aggregate that combines before the shuffle, and
    the join can be split, so a node with very many edges is no hot group."""
    if undirected:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = pairs.join(least, "u")
    if undirected:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b), label being the
    least node of its component. Nodes without links are not listed."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _state(edges)
    while True:
        edges = stored(_hook(_hook(edges, True), False), "edges")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    lonely = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(lonely)
