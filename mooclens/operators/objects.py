"""Course structure (object) table: children split (A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_children(objects: DataFrame) -> DataFrame:
    """One row per child, as the reference's object reader builds it.

    An empty children field keeps the row (child ''); otherwise the field
    is split on single blanks and the token after the last blank is
    dropped, so ``'a b '`` gives a, b and ``'a b'`` gives only a. Exact
    duplicate rows are removed.
    """
    ch = F.coalesce(F.col("children"), F.lit(""))
    parts = F.split(ch, " ")
    kids = F.when(ch == "", F.array(F.lit(""))).otherwise(F.slice(parts, 1, F.size(parts) - 1))
    cols = [c for c in objects.columns if c != "children"]
    out = objects.select(*cols, F.explode(kids).alias("children"))
    return out.select(*objects.columns).distinct()
