"""Registered queries: one Spark callable (spark, sf_dir) -> DataFrame per
operator, with the DuckDB oracle statement where one exists.

Double columns are rounded to 6 decimals on both sides so that the
order-insensitive value hash does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # log times are naive wall-clock times: evaluate them in UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return round_doubles(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def round_doubles(df: DataFrame, decimals: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append((F.round(F.col(f.name).cast("double"), decimals) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


@lru_cache(maxsize=1)
def load_all():
    """Import the modules that register queries."""
    from mooclens.plans import (  # noqa: F401
        queries_features,
        queries_io,
        queries_models,
        queries_ranking,
        queries_scoring,
    )
    return True
