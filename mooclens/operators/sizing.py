"""Size checks guarding broadcast joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.session import BROADCAST_ROWS_KEY, conf_int


def maybe_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when it provably has at most ``max_rows`` rows.

    The check reads at most max_rows + 1 rows (a bounded job). Beyond the
    bound the frame is returned unhinted and the join shuffles (AQE may
    still switch to broadcast from measured sizes).
    """
    spark = df.sparkSession
    limit = max_rows if max_rows is not None else conf_int(spark, BROADCAST_ROWS_KEY)
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df
