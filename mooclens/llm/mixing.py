"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target of words. A document is taken floor(ratio)
times, ratio = target / source size, and once more with probability
frac(ratio). Which documents get the extra copy is decided by the cube
method: inclusion probabilities move along the null space of the balancing
constraints (documents, words) until they are 0 or 1.

Scale: the flight runs in blocks of (source, hash block); each block ends
with at most two undecided documents, which form the blocks of the next
level. A level shrinks its input by ``block_rows`` / 2, so three levels
serve 10**9 documents and no task ever holds more than one block. Only
(ids, size, probability) are shuffled, never texts. The number of levels
comes from the largest source's count.

Edge cases: null texts and texts without words have size 0 and are taken 0
words; null source is a source of its own, last in order; a source with no
words has target 0; an empty table gives an empty result; repeated rows
count as documents of their own; extra columns pass through ``repeated``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mooclens.llm.common import stored, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK_ROWS = 2000
#: Documents, the smallest of a source's last block, that the landing decides
#: together with the two that the flight leaves.
LANDING = 10

_STATE = "doc_id long, source string, size long, dup long, copies int, p double, block long"


def targets(sizes: pd.DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> pd.DataFrame:
    """Targets of the sources (columns source, source_size, documents).

    One row for each distinct source. Order is by code point, null last.
    Shares stop at ``most`` times the source's size; the excess goes to the
    others by weight until none is above.
    """
    rows = sizes.assign(key=[(s is None, s or "") for s in sizes["source"]])
    rows = rows.sort_values("key").drop(columns="key").reset_index(drop=True)
    w = np.array([weights[i % len(weights)] for i in range(len(rows))])
    size = rows["source_size"].to_numpy(float)
    left, out, open_ = share * size.sum(), np.zeros(len(rows)), np.ones(len(rows), bool)
    while open_.any():
        want = left * w / w[open_].sum()
        over = open_ & (want > most * size)
        if not over.any():
            out[open_] = want[open_]
            break
        out[over] = most * size[over]
        left -= out[over].sum()
        open_ &= ~over
    return rows.assign(target=out)


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube flight for the constraints (documents, words).

    Three undecided units have a one-dimensional null space: moving p along
    u keeps sum(p) and sum(p * size). One of two steps, drawn so that the
    expectation of p stays, decides at least one unit. Ends with at most
    two undecided units.
    """
    p = p.copy()
    hold: list[int] = []
    draws = rng.random(len(p) + 1)
    for i in np.flatnonzero((p > 0) & (p < 1)):
        hold.append(int(i))
        if len(hold) < 3:
            continue
        a, b, c = (float(size[k]) for k in hold)
        u = (c - b, a - c, b - a) if not a == b == c else (1.0, -1.0, 0.0)
        up = down = math.inf
        for k, d in zip(hold, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
            elif d < 0:
                up, down = min(up, p[k] / -d), min(down, (1 - p[k]) / -d)
        step = up if draws[i] * (up + down) < down else -down
        for k, d in zip(hold, u, strict=True):
            x = p[k] + step * d
            p[k] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
        hold = [k for k in hold if 0 < p[k] < 1]
    return p


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Decide the last units: the subset whose words come nearest to their
    expectation, then the one of nearest count, then the first of them."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    subsets = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    words = np.abs(subsets @ size[open_] - size[open_] @ p[open_]).round(6)
    count = np.abs(subsets.sum(axis=1) - p[open_].sum()).round(6)
    out = p.copy()
    out[open_] = subsets[np.lexsort((count, words))[0]]
    return out


def _level(last: bool, seed: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        # large documents first: those left undecided are small
        block = block.sort_values(["size", "doc_id", "dup"], ascending=[False, True, True], kind="stable")
        size, p = block["size"].to_numpy(float), block["p"].to_numpy(float).copy()
        rng = np.random.default_rng([seed, len(block), int(size.sum()), int(block["block"].iloc[0])])
        if last:
            # the smallest documents wait for the landing
            flown = max(0, len(p) - LANDING)
            p[:flown] = flight(size[:flown], p[:flown], rng)
            p = landing(size, p)
        else:
            p = flight(size, p, rng)
        return block.assign(p=p)

    return run


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block_rows=BLOCK_ROWS, seed=17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target,
    copies (0, 1, 2...), taken = copies * size."""
    spark = docs.sparkSession
    # ``dup`` numbers equal documents, which are alike in all that counts
    sized = docs.select("doc_id", F.col("source"), word_count().alias("size"))
    sized = stored(sized, "mix-sizes")
    per_source = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents")
    )
    # one row per source: names of sources, not documents
    table = targets(per_source.toPandas(), weights, share, most)
    schema = "source string, source_size long, documents long, target double"
    rows = [tuple(None if x is None else x for x in r) for r in table.itertuples(index=False, name=None)]
    goals = stored(spark.createDataFrame([(s, int(z), int(n), float(t)) for s, z, n, t in rows], schema), "mix-goals")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = (
        sized.withColumnRenamed("source", "s")
        .join(goals, F.col("s").eqNullSafe(F.col("source")))
        .drop("s")
        .withColumn("ratio", F.least(ratio, F.lit(float(most))))
    )
    whole = F.floor("ratio")
    state = joined.select(
        "doc_id",
        "source",
        "size",
        F.monotonically_increasing_id().alias("dup"),
        whole.cast("int").alias("copies"),
        (F.col("ratio") - whole).alias("p"),
        F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("documents") / block_rows)).cast("long").alias("block"),
    )
    largest = int(table["documents"].max()) if len(table) else 0
    levels, n = 1, largest / block_rows
    while n > 1:
        levels, n = levels + 1, n * 2 / block_rows
    decided, todo = [], state
    for level in range(levels):
        last = level == levels - 1
        if last:
            todo = todo.withColumn("block", F.lit(0).cast("long"))
        done = stored(todo.groupBy("source", "block").applyInPandas(_level(last, seed + level), _STATE), "mix-level")
        fixed = (F.col("p") <= 0) | (F.col("p") >= 1)
        decided.append(done.where(fixed))
        # pairs left by block_rows / 2 blocks make one block of the next level
        todo = done.where(~fixed).withColumn("block", F.floor(F.col("block") / (block_rows // 2)).cast("long"))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    copies = (F.col("copies") + F.col("p")).cast("int")
    return (
        out.withColumnRenamed("source", "s")
        .join(goals.drop("documents"), F.col("s").eqNullSafe(F.col("source")))
        .drop("s")
        .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as ``mix`` takes it,
    with the columns of ``docs``. Rows that agree in (doc_id, source, size)
    are exchangeable; the mix's copies are dealt to them in row order."""
    plan = mix(docs, **options)
    key = ["doc_id", "source", "size"]
    by_key = lambda c: F.row_number().over(Window.partitionBy(*key).orderBy(c))
    picks = plan.select(*(F.col(k).alias(f"_{k}") for k in key), "copies").withColumn(
        "_n", F.row_number().over(Window.partitionBy("_doc_id", "_source", "_size").orderBy(F.desc("copies")))
    )
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", word_count().alias("size"))
    rows = rows.withColumn("_n2", by_key(F.xxhash64("_row")))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key] + [F.col("_n") == F.col("_n2")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    taken = rows.join(picks.where(F.col("copies") > 0), cond)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
