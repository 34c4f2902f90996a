"""A membership filter of fixed size, built in Spark, applied before a
shuffle. It lets through every row that has a partner and drops most that
have none; the join after it decides. Its 8 MB bound does not depend on the
data: with very many values it lets more through, and nothing is lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26
_PAGE = 32768  # bits of a bitmap that Spark's aggregate makes


class Members:
    """Holds for all values of a long column, and for few others."""

    def __init__(self, values: DataFrame, column: str):
        # values are hashes or ids: their low bits are spread enough
        slot = F.col(column).bitwiseAND(F.lit((1 << BITS) - 1))
        pages = (
            values.select(slot.alias("slot"))
            .groupBy(F.floor(F.col("slot") / _PAGE).alias("page"))
            .agg(F.bitmap_construct_agg(F.col("slot") % _PAGE).alias("bits"))
        )
        self.packed = np.zeros((1 << BITS) // 8, np.uint8)
        for page, bits in pages.collect():  # at most 2048 rows of 4 KB
            self.packed[page * (_PAGE // 8) : (page + 1) * (_PAGE // 8)] = np.frombuffer(bits, np.uint8)

    def hold(self, values: np.ndarray) -> np.ndarray:
        s = values & ((1 << BITS) - 1)
        return (self.packed[s >> 3] >> (s & 7) & 1).astype(bool)

    def of(self, df: DataFrame, column: str) -> DataFrame:
        """Rows of ``df`` whose ``column`` may be a member."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                yield t.filter(pa.array(self.hold(t.column(column).to_numpy())))

        return df.mapInArrow(run, df.schema)
