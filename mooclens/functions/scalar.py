"""Scalar column expressions shared by the operators.

All are compositions of built-in functions, so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of", "safe_div", "sigmoid", "epoch_micros", "seconds_between",
    "whole_days_between", "days_since", "index_in", "binarize", "l2_distance",
    "count_when", "sum_when",
]


def col_of(c) -> Column:
    if isinstance(c, str):
        return F.col(c)
    if isinstance(c, Column):
        return c
    return F.lit(c)


def safe_div(a, b) -> Column:
    """a / b with x/0 and 0/0 mapped to 0 (the reference's inf/NaN -> 0)."""
    return F.coalesce(F.try_divide(col_of(a).cast("double"), col_of(b).cast("double")), F.lit(0.0))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_of(x)))


def epoch_micros(ts) -> Column:
    """Microseconds since the epoch of a timestamp (NTZ input is cast first)."""
    return F.unix_micros(col_of(ts).cast("timestamp"))


def seconds_between(later, earlier) -> Column:
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(1_000_000.0)


def whole_days_between(later, earlier) -> Column:
    """int(seconds / 86400), truncated toward zero."""
    return ((epoch_micros(later) - epoch_micros(earlier)) / F.lit(86_400_000_000.0)).cast("int")


def days_since(d, ref) -> Column:
    return F.datediff(col_of(d), col_of(ref))


def index_in(values: list[str], c, strict: bool = True) -> Column:
    """0-based position of c in a fixed list; raises (strict) or NULL when absent."""
    pos = (F.array_position(F.array(*[F.lit(v) for v in values]), col_of(c)) - 1).cast("int")
    if strict:
        return F.when(pos >= 0, pos).otherwise(
            F.raise_error(F.concat(F.lit("unknown value: "), col_of(c).cast("string")))
        )
    return F.when(pos >= 0, pos)


def binarize(c) -> Column:
    return (col_of(c) > 0).cast("int")


def l2_distance(a, b) -> Column:
    sq = F.zip_with(col_of(a), col_of(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def count_when(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def sum_when(cond: Column, value) -> Column:
    return F.sum(F.when(cond, col_of(value)).otherwise(F.lit(0)))


def seeded(col: str, seed: int) -> Column:
    """A number in 0..2^52-1 from a column's text and a seed: the first 13
    hexadecimal digits of MD5("seed:text"), which any engine repeats; exact as
    a double. NULL counts as a text of its own."""
    text = F.coalesce(F.col(col).cast("string"), F.lit("\0"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
