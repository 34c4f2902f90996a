"""Document fingerprints: one-permutation MinHash, packed b-bit form.

Shingles are windows of five words, with the incomplete windows at the
text's start, so that short texts have as many shingles as words. All
shingle hashes of a text are binned once; empty bins borrow by optimal
densification; the low ``BITS`` bits of each bin are packed and written as
hex. The likeness of two fingerprints is the share of agreeing bins, less
the agreement that chance gives (2**-BITS), scaled to 0..1.

Edge cases: null and wordless texts have no shingle and the all-zero
fingerprint with a leading marker ``-``; two such texts have likeness 1, such a text
and any other 0. Equal texts have equal fingerprints.

``edited_pairs`` needs each text's successor by doc_id. Documents are cut
into ranges of doc_id by quantiles (the driver holds four numbers for each
shuffle partition);
the first document of each range is also sent to the range before it, so
one shuffle of the texts suffices and every range is a stream. Null ids
come first; rows with equal ids are in order of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.llm.common import shuffle_partitions, ship
from mooclens.llm.onepermutation import bin_minima, densified
from mooclens.llm.textnum import as_bytes, chunks, mix, windows, word_hashes

BINS = 128
BITS = 8
WIDTH = 5

#: Stands for a null id, which comes before all others.
_NULL_KEY = -(2**63)


def packed(texts: list[bytes], bins: int = BINS, width: int = WIDTH) -> np.ndarray:
    """Matrix (texts, bins) of the low-order bits; row of zeros and a last
    column 0 for a text without words, last column 1 otherwise."""
    out = np.zeros((len(texts), bins + 1), np.uint8)
    for a, b in chunks(texts):
        hashes, bounds = word_hashes(texts[a:b], lower=False)
        shingles, bounds = windows(hashes, bounds, width, padded=True)
        for i in range(b - a):
            s = np.unique(shingles[bounds[i] : bounds[i + 1]])
            if len(s):
                # the bin takes the hash's top, so its low bits are mixed anew
                out[a + i, :bins] = (mix(densified(*bin_minima(s, bins), bins)) & np.uint64(0xFF)).astype(np.uint8)
                out[a + i, bins] = 1
    return out


def written(row: np.ndarray) -> str:
    return row[:-1].tobytes().hex() if row[-1] else "-" + row[:-1].tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bias-corrected likeness, row by row."""
    chance = 2.0**-BITS
    agree = (x[:, :-1] == y[:, :-1]).mean(axis=1)
    fit = np.clip((agree - chance) / (1 - chance), 0, 1)
    return np.where((x[:, -1] == 1) & (y[:, -1] == 1), fit, (x[:, -1] == y[:, -1]).astype(float))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with the column ``fingerprint``; a column of that
    name is replaced."""
    docs = docs.drop("fingerprint")
    schema = docs.withColumn("fingerprint", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = packed(as_bytes(batch.column(text)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([written(r) for r in prints], pa.string())], [*batch.schema.names, "fingerprint"]
            )

    return docs.mapInArrow(run, schema)


_EDITED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
_EDITED_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
_FLUSH_CHARS = 1 << 20


def _compared(rows: list[tuple], following: list[str]) -> pa.RecordBatch:
    """Result rows for (doc_id, text) whose next texts are ``following``."""
    texts = [t for _, t in rows]
    edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for t, nxt in zip(texts, following, strict=True)]
    raw = [e.encode() for e in edited]
    # the next text is the row after, but for the last row of the run
    own = packed([t.encode() for t in texts] + [following[-1].encode()])
    other = packed(raw)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in raw], pa.string()),
            pa.array([written(r) for r in own[:-1]], pa.string()),
            pa.array([written(r) for r in other], pa.string()),
            pa.array(likeness(own[:-1], other), pa.float64()),
            pa.array(likeness(own[:-1], own[1:]), pa.float64()),
        ],
        schema=_EDITED,
    )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk sorted rows (range, guest, doc_id, text): each row of a range is
    paired with the row after it; a guest only closes its range."""
    held: list[tuple] = []
    at, chars, closed = None, 0, False
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(4)]
        for rng, guest, doc_id, text in zip(*cols, strict=True):
            text = text or ""
            if rng != at:
                at, held, chars, closed = rng, [], 0, False
            if closed:
                continue
            if held and (guest or chars >= _FLUSH_CHARS):
                yield _compared(held, [t for _, t in held[1:]] + [text])
                held, chars = [], 0
            closed = bool(guest)
            if not closed:
                held.append((doc_id, text))
                chars += len(text)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, with likenesses."""
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select(F.coalesce("doc_id", F.lit(_NULL_KEY)).alias("key"))
    pieces = 4 * shuffle_partitions(spark)
    steps = [i / pieces for i in range(1, pieces)]
    cuts = keyed.select(F.percentile_approx("key", steps, 20 * pieces)).first()[0]
    if cuts is None:
        return spark.createDataFrame([], _EDITED_DDL)
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right")).astype("int32")

    firsts = keyed.groupBy(range_of("key").alias("range")).agg(F.min("key").alias("first")).orderBy("range").collect()
    opens = np.array([r["first"] for r in firsts], np.int64)
    before = np.array([firsts[k - 1]["range"] for k in range(len(firsts))], np.int32)

    @F.pandas_udf("array<int>")
    def ranges_of(key: pd.Series) -> pd.Series:
        """Own range and, for the first key of a range, the one before."""
        k = key.to_numpy()
        own = np.searchsorted(cuts, k, side="right")
        at = np.minimum(np.searchsorted(opens, k), len(opens) - 1)
        guest = opens[at] == k
        return pd.Series([[o, before[i]] if g else [o] for o, g, i in zip(own, guest, at, strict=True)])

    dealt = (
        docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_NULL_KEY)).alias("key"))
        .select("doc_id", "text", "key", F.posexplode(ranges_of("key")).alias("guest", "range"))
        .repartition(shuffle_partitions(spark), "range")
        .sortWithinPartitions("range", "guest", "key", "text")
    )
    return dealt.select("range", "guest", "doc_id", "text").mapInArrow(_ranges, _EDITED_DDL)
