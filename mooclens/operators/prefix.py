"""Exact ordered scans inside groups without single-task windows.

A window ``partitionBy(g).orderBy(o)`` sends each group to one task. When a
group is hot (one key may hold a third of all rows) that task becomes the
job. The helpers here first count group sizes; if no group exceeds
``mooclens.prefix.hotGroupRows`` they use the plain window. Otherwise each
hot group is cut into ranges of its whole order tuple by quantiles of a row
sample (equal leading keys are told apart by the next ones), the window runs per (group, range) and a small per-range table supplies the
carry-in (running totals, previous values) from earlier ranges.

The bounds are checkpointed (reliable checkpoint in spark.checkpoint.dir)
so recomputation after an executor loss sees the same ranges. The range
number is a pure function of the key, so equal keys share a range and
results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mooclens.session import BUCKETS_KEY, HOT_ROWS_KEY, conf_int, ensure_checkpoint_dir

BUCKET = "_bkt"
#: Rows sampled for each range of a hot group.
SAMPLED = 32


def _join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal ``keys`` where NULL equals NULL; the keys of ``left``
    stay. A NULL group is a group like any other."""
    other = right.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in keys:
        cond = cond & left[c].eqNullSafe(other[f"_k_{c}"])
    return left.join(other, cond, how).drop(*[f"_k_{c}" for c in keys])


def _order_tuple(order: str | list[str]) -> Column:
    return F.struct(*[F.col(c) for c in ([order] if isinstance(order, str) else order)])


def _hot_bounds(df: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame | None:
    """Per-hot-group range splitters of the order tuple or None if no group
    is hot. A group's number of ranges follows from its rows, up to the
    configured most; the splitters are quantiles of a row sample of a size
    that does not grow with the group."""
    spark = df.sparkSession
    threshold = conf_int(spark, HOT_ROWS_KEY)
    most = max(2, conf_int(spark, BUCKETS_KEY))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > threshold)
    if hot.isEmpty():
        return None
    wanted = F.greatest(F.lit(2), F.least(F.lit(most), F.ceil(4.0 * F.col("_n") / threshold))).cast("int")
    hot = hot.withColumn("_b", wanted)
    n, sample = F.size("_s"), SAMPLED * F.col("_b")
    bounds = (
        _join_same(df.select(*keys, _order_tuple(order).alias("_p1_order")), hot, keys, "inner")
        .where(F.rand(1) * F.col("_n") < sample)
        .groupBy(*keys, "_b")
        .agg(F.sort_array(F.collect_list("_p1_order")).alias("_s"))
        .select(*keys, F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.col("_b") - 1),
            lambda i: F.get("_s", F.floor(i * n / F.col("_b")).cast("int")))).alias("_bounds"))
    )
    ensure_checkpoint_dir(spark)
    bounds = bounds.checkpoint(eager=True)
    # Hot groups number at most rows / threshold; broadcast only when the
    # bounds table is small, else let the (skew-aware) shuffle join run.
    if bounds.count() * most <= 1_000_000:
        bounds = F.broadcast(bounds)
    return bounds


def with_buckets(df: DataFrame, keys: list[str], order: str | list[str], small: bool = False) -> tuple[DataFrame, bool]:
    """Add ``_bkt``: 0 for ordinary groups, key range number inside hot groups.
    ``order`` is a column or the whole order tuple; rows equal in it share a
    range. ``small=True`` states that no group can be hot (skips the size check)."""
    bounds = None if small else _hot_bounds(df, keys, order)
    if bounds is None:
        return df.withColumn(BUCKET, F.lit(0)), False
    out = _join_same(df, bounds, keys, "left").withColumn("_p1_order", _order_tuple(order))
    b = F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(F.size(F.filter("_bounds", lambda x: x < F.col("_p1_order"))))
    return out.withColumn(BUCKET, b).drop("_bounds", "_p1_order"), True


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    order_cols: list[str],
    sums: dict[str, Column],
    inclusive: bool = True,
    ties: str = "rows",
    small: bool = False,
    prebucketed: bool | None = None,
) -> DataFrame:
    """Add running sums of the ``sums`` expressions inside each group.

    Rows are ordered by ``order_cols``, which also drive the ranges.
    ``inclusive`` includes the current row. ``ties='range'`` gives rows with
    equal order keys the same value (RANGE frame on the first order
    column, which must then be the only one); ``'rows'`` needs a unique
    order for deterministic output.
    """
    tmp = {name: f"_v_{i}" for i, name in enumerate(sums)}
    base = df.select("*", *[expr.alias(tmp[n]) for n, expr in sums.items()])
    ordered = [F.col(c) for c in order_cols]

    def frame(spec):
        if ties == "range":
            end = Window.currentRow if inclusive else -1
            if not inclusive:
                raise ValueError("exclusive sums with ties='range' are not supported")
            return spec.orderBy(*ordered).rangeBetween(Window.unboundedPreceding, end)
        end = Window.currentRow if inclusive else -1
        return spec.orderBy(*ordered).rowsBetween(Window.unboundedPreceding, end)

    if prebucketed is None:
        bucketed, split = with_buckets(base, keys, order_cols, small)
    else:  # ``df`` already carries _bkt from an earlier with_buckets call
        bucketed, split = base, prebucketed
    if not split:
        w = frame(Window.partitionBy(*keys))
        out = base.select("*", *[F.coalesce(F.sum(tmp[n]).over(w), F.lit(0)).alias(n) for n in sums])
        return out.drop(*tmp.values())
    totals = bucketed.groupBy(*keys, BUCKET).agg(*[F.sum(tmp[n]).alias(tmp[n]) for n in sums])
    wb = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, BUCKET, *[F.coalesce(F.sum(tmp[n]).over(wb), F.lit(0)).alias(f"_c_{tmp[n]}") for n in sums]
    )
    joined = _join_same(bucketed, carry, keys + [BUCKET], "inner")
    w = frame(Window.partitionBy(*keys, BUCKET))
    out = joined.select(
        *df.columns,
        *[(F.col(f"_c_{tmp[n]}") + F.coalesce(F.sum(tmp[n]).over(w), F.lit(0))).alias(n) for n in sums],
    )
    return out


def row_numbers(df: DataFrame, keys: list[str], order_cols: list[str], name: str = "rn",
                small: bool = False) -> DataFrame:
    """1-based position inside each group under a unique ``order_cols`` order."""
    out = prefix_sums(df, keys, order_cols, {name: F.lit(1).cast("long")}, inclusive=True, small=small)
    return out


def previous_value(df: DataFrame, keys: list[str], order_col: str, value_col: str, name: str,
                   small: bool = False, prebucketed: bool | None = None) -> DataFrame:
    """Value of ``value_col`` at the previous row in ``order_col`` order.

    Among rows with equal order keys the previous row is any one of them,
    so use it where ties carry equal values (e.g. the order key itself).
    """
    if prebucketed is None:
        bucketed, split = with_buckets(df, keys, order_col, small)
    else:
        bucketed, split = df, prebucketed
    if not split:
        w = Window.partitionBy(*keys).orderBy(order_col)
        return df.withColumn(name, F.lag(value_col).over(w))
    last = bucketed.groupBy(*keys, BUCKET).agg(F.max_by(value_col, order_col).alias("_last"))
    wb = Window.partitionBy(*keys).orderBy(BUCKET)
    carry = last.select(*keys, BUCKET, F.lag("_last").over(wb).alias("_carry"))
    joined = _join_same(bucketed, carry, keys + [BUCKET], "inner")
    w = Window.partitionBy(*keys, BUCKET).orderBy(order_col)
    prev = F.when(F.row_number().over(w) == 1, F.col("_carry")).otherwise(F.lag(value_col).over(w))
    return joined.select(*df.columns, prev.alias(name))
