"""Hard-negative pair mining (N6, C9, H12) and the pairwise logistic
ranker on mined pairs (N7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooclens.operators.prefix import row_numbers
from mooclens.operators.sizing import maybe_broadcast


#: Modulus and factors of the draws: plain arithmetic that any engine repeats.
PRIME, FACTOR, STRIDES = 2147483647, 48271, (16807, 69621, 630360016)
#: A block holds 2^BLOCK_BITS neighbouring rows of a class.
BLOCK_BITS = 15
#: Pairs whose vectors are laid side by side at once.
PAIRS = 2048


def _draw(row: Column, turn: Column, place: Column, seed: int) -> Column:
    """A number in 0..PRIME-1 for (row, repeat, place): two rounds of a
    multiplicative generator; every product stays under 2^63."""
    def one(x):
        return (x % PRIME) * FACTOR % PRIME

    first = one(row * STRIDES[0] + seed)
    return one(one(first + turn * STRIDES[1]) + place * STRIDES[2])


def hard_negative_pairs(df: DataFrame, id_col: str = "id", vec: str = "x", label: str = "label",
                        n_candidates: int = 20, repeats: int = 1, seed: int = 0) -> DataFrame:
    """For every row, ``repeats`` times, draw ``n_candidates`` distinct
    rows of the opposite class and keep the L2-nearest one (the least id of
    equals).

    Rows of each class are numbered 0..M-1 by id, without their vectors (the
    skew-safe numbering: a class is a huge group). The class is cut into as
    many strata as there are draws, floor(t M / n) to floor((t + 1) M / n),
    and draw t takes one row of stratum t, each row and draw its own: distinct
    rows, drawn without replacement, and neighbours share no run of them. With
    M <= n every row is a candidate. Each class is cut into blocks of
    neighbours and into slices; a row's vector goes once to each block that it
    draws from, a block once to each slice of the other class, so a vector
    travels at most about twice as often as it draws, and seldom when blocks
    are few. Where they meet the nearest of the block is kept, and only the
    nearest one's vector is fetched. Vectors are compared as doubles; those of
    unequal length or with a null have a null distance, the least of all. Rows
    without a label or id take no part; a class without an opposite gives no
    rows. Returns (id, repeat, other_id, x1, x2, y) with y the row's own label.
    """
    base = df.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    base = base.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_c"), F.col(vec).alias("_x"))
    vectors = base.select("_id", "_x")
    numbered = row_numbers(base.select("_id", "_c"), ["_c"], ["_id"], "_pos").withColumn("_pos", F.col("_pos") - 1)
    sizes = base.groupBy("_c").agg(F.count(F.lit(1)).alias("_own"))
    opposite = sizes.select((1 - F.col("_c")).alias("_c"), F.col("_own").alias("_m"))
    rows = numbered.join(maybe_broadcast(sizes.join(opposite, "_c")), "_c").join(vectors, "_id")
    rows = rows.withColumn("_x", F.col("_x").cast("array<double>"))

    def slice_rows(drawn_from):
        """Rows of a slice, from the size of the class it draws from."""
        return F.greatest(F.lit(1 << BLOCK_BITS), F.ceil(drawn_from / (n_candidates * repeats)))

    def block(pos):
        return F.shiftright(pos, BLOCK_BITS)

    k = F.least(F.lit(n_candidates).cast("long"), F.col("_m"))

    def place(repeat, t):
        low, high = (F.floor((t + d) * F.col("_m") / k) for d in (0, 1))
        return low + _draw(F.col("_pos"), repeat.cast("long"), t, seed) % (high - low)

    draws = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.transform(
        F.sequence(F.lit(0).cast("long"), k - 1), lambda t: F.struct(r.alias("repeat"), place(r, t).alias("place")))))
    asking = rows.select("_id", "_c", F.floor(F.col("_pos") / slice_rows(F.col("_m"))).alias("_s"), F.col("_x").alias("_x1"), draws.alias("_d"))
    asking = asking.select("*", F.explode(F.array_distinct(F.transform("_d", lambda d: block(d["place"])))).alias("_b"))
    here = F.filter("_d", lambda d: block(d["place"]) == F.col("_b"))
    within = (1 << BLOCK_BITS) - 1
    asking = asking.select("_c", "_b", "_s", "_id", "_x1", F.transform(here, lambda d: d["repeat"]).alias("repeat"),
                           F.transform(here, lambda d: d["place"].bitwiseAND(within).cast("int")).alias("at"))
    slices = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_m") / slice_rows(F.col("_own"))) - 1)
    held = rows.select((1 - F.col("_c")).alias("_c"), block(F.col("_pos")).alias("_b"), F.explode(slices).alias("_s"),
                       F.col("_id").alias("other_id"), F.col("_x").alias("_x2"), F.col("_pos").bitwiseAND(within).cast("int").alias("at"))
    kind = base.schema["_id"].dataType.simpleString()
    near = asking.groupBy("_c", "_b", "_s").cogroup(held.groupBy("_c", "_b", "_s")).applyInArrow(
        _nearest, f"_id {kind}, repeat int, _c int, _d double, other_id {kind}")
    best = near.groupBy("_id", "repeat", "_c").agg(F.min(F.struct("_d", "other_id")).alias("_n"))
    best = best.select("_id", "repeat", "_c", "_n.other_id")
    out = best.join(vectors.withColumnRenamed("_x", "x1"), "_id").join(
        vectors.select(F.col("_id").alias("other_id"), F.col("_x").alias("x2")), "other_id")
    return out.select(F.col("_id").alias(id_col), "repeat", "other_id", "x1", "x2", F.col("_c").alias("y"))


def _nearest(asking: pa.Table, held: pa.Table) -> pa.Table:
    """The nearest of the rows of a block that each row drew, by repeat: the
    first in order of place, which is that of ids, of equals."""
    held = held.take(pc.sort_indices(held.column("at")))
    places = held.column("at").to_numpy()
    drawn = asking.column("at").combine_chunks()
    row, at = pc.list_parent_indices(drawn).to_numpy(), drawn.flatten().to_numpy()
    repeat = asking.column("repeat").combine_chunks().flatten().to_numpy()
    # rows of one id share their vectors: a place may have several
    first, end = np.searchsorted(places, at), np.searchsorted(places, at, "right")
    n = end - first
    row, repeat = np.repeat(row, n), np.repeat(repeat, n)
    other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n - first, n)
    d, known = _distances(asking.column("_x1"), row, held.column("_x2"), other)
    order = np.lexsort((other, d, known, repeat, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (repeat[order][1:] != repeat[order][:-1])
    best = order[new]
    own = asking.select(["_id", "_c"]).take(pa.array(row[best]))
    columns = [own.column("_id"), pa.array(repeat[best], pa.int32()), own.column("_c"),
               pa.array(d[best], mask=~known[best]), held.column("other_id").take(pa.array(other[best]))]
    return pa.table(columns, ["_id", "repeat", "_c", "_d", "other_id"])


def _distances(x1: pa.ChunkedArray, i: np.ndarray, x2: pa.ChunkedArray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L2 distances of the vectors i of x1 and j of x2, summed up in order of
    the components, and which there are: not with nulls or unequal lengths."""
    (size1, *flat1), (size2, *flat2) = _lists(x1), _lists(x2)
    sizes = size1[i]
    d, known = np.zeros(len(i)), (sizes == size2[j]) & (sizes >= 0)
    for size in np.unique(sizes[known & (sizes > 0)]):
        (place1, m1), (place2, m2) = _matrix(size1, *flat1, size), _matrix(size2, *flat2, size)
        pairs = np.flatnonzero(known & (sizes == size))
        for a in range(0, len(pairs), PAIRS):
            some = pairs[a:a + PAIRS]
            apart = m1[place1[i[some]]] - m2[place2[j[some]]]
            d[some] = np.sqrt(np.cumsum(apart * apart, axis=1)[:, -1])
    return d, known


def _lists(x: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes (-1: null, or with a null), starts and components of vectors."""
    x = x.combine_chunks()
    size = pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64)
    start, flat = np.cumsum(size) - size, x.flatten()
    size[x.is_null().to_numpy(zero_copy_only=False)] = -1
    if flat.null_count:
        size[pc.list_parent_indices(x).to_numpy()[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return size, start, flat.to_numpy(zero_copy_only=False)


def _matrix(sizes: np.ndarray, start: np.ndarray, flat: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of one size as a matrix, and the row of each there."""
    rows = np.flatnonzero(sizes == size)
    place = np.zeros(len(sizes), np.int64)
    place[rows] = np.arange(len(rows))
    return place, flat[start[rows][:, None] + np.arange(size)]


def pairwise_logistic(pairs: DataFrame, reg: float = 0.0, max_iter: int = 100):
    """N7 re-aimed to a linear scorer: P(y = 1) = sigmoid(s(x1) - s(x2))
    with s(x) = w.x, i.e. a logistic regression without intercept on
    x1 - x2. Returns the fitted weights (list)."""
    d = pairs.select(array_to_vector(F.zip_with("x1", "x2", lambda a, b: a - b)).alias("features"),
                     F.col("y").cast("double").alias("label"))
    m = LogisticRegression(fitIntercept=False, regParam=reg, maxIter=max_iter).fit(d)
    return [float(v) for v in m.coefficients]
