"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct shingles of ``width`` words (A-Z
lowered); one with fewer words has its whole sequence as the only shingle.
The sketch has one register for each of ``BINS`` buckets: of the bucket's
least hash, the count of leading zeros (6 bits) and the next 10 bits.
Empty buckets borrow by optimal densification. Bands of six registers make
the candidates (``BINS`` / 6 bands: a pair at similarity 0.8 is missed with
probability below 10**-8); agreeing registers, corrected for collisions,
estimate the similarity; what passes is confirmed on whole sets.

Equal sets are one node (64-bit content digest), so thousands of copies
cost one sketch. See ``near`` for how groups are found without all pairs.

Edge cases: a null text, or one without words, has an empty set, no links
and itself as component; rows with equal ids count as one document each and
share components by their texts; a null id never is a component's name
unless all ids of its component are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.llm.bitmap import Members
from mooclens.llm.common import stored
from mooclens.llm.near import grouped
from mooclens.llm.onepermutation import bin_minima, densified
from mooclens.llm.textnum import as_bytes, chunks, mix, parts, windows, word_hashes

BINS = 384
BAND = 6
MANTISSA_BITS = 10
PERCENT = 80
_SEED = np.uint64(0x5BD1E995A7)


def registers(filled: np.ndarray, minima: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Compressed registers of all bins, uint16."""
    at = minima * np.uint64(bins)  # place within the bin, modulo 2**64
    bits = np.frexp(at.astype(np.float64))[1]
    zeros = np.clip(64 - bits, 0, 63).astype(np.uint64)
    shift = np.maximum(bits - 1 - MANTISSA_BITS, 0).astype(np.uint64)
    mantissa = (at >> shift) & np.uint64((1 << MANTISSA_BITS) - 1)
    return densified(filled, (zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16), bins)


def band_keys(regs: np.ndarray, band: int = BAND) -> np.ndarray:
    """64-bit key for each band of each row of registers."""
    rows, bins = regs.shape
    parts = regs[:, : bins // band * band].reshape(rows, -1, band).astype(np.uint64)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(band):
        key = mix(key * np.uint64(65599) + parts[:, :, k])
    return key.view(np.int64)


def chance(na: np.ndarray, nb: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Probability that registers of different minima agree: equal leading
    zeros under both sets' loads, and equal mantissas."""
    i = np.arange(64)
    load = lambda n: np.maximum(np.asarray(n, float), 1)[:, None] / bins + 1
    at = lambda n: (1 - 2.0 ** -(i + 1)) ** load(n) - (1 - 2.0**-i) ** load(n)
    return (at(na) * at(nb)).sum(axis=1) * 2.0**-MANTISSA_BITS


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    for a, b in chunks(texts):
        hashes, bounds = windows(*word_hashes(texts[a:b], lower=True), width)
        for i in range(b - a):
            yield np.unique(hashes[bounds[i] : bounds[i + 1]])


def digest(s: np.ndarray) -> int:
    """Content id of a set, as a signed 64-bit number."""
    return int(mix(s ^ _SEED).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.int64())


def _digests(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in parts(batches, "text"):
            ids, sizes, regs = [], [], []
            for s in shingle_sets(as_bytes(t.column("text")), width):
                ids.append(digest(s))
                sizes.append(len(s))
                regs.append(registers(*bin_minima(s, BINS)).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [t.column("row"), t.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(regs, pa.binary())],
                ["row", "doc_id", "n", "node", "regs"],
            )

    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, n long, node long, regs binary")


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, BINS)
            keys = band_keys(regs)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.reshape(-1))
            yield pa.RecordBatch.from_arrays([*t.columns, lists], [*t.schema.names, "keys"])

    return nodes.select("node", "n", "regs").mapInArrow(run, "node long, n long, regs binary, keys array<long>")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id
    (the least doc_id reachable by links), kept (it is that one) and row,
    the xxhash64 of doc_id and text."""
    table = stored(_digests(docs, width), "hmh-digests")
    full = table.where("n > 0")
    nodes = stored(full.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n").alias("n")), "hmh-nodes")
    # one signature for each node: that of the row with its least id
    lead = nodes.select("node", F.coalesce("least", F.lit(-1)).alias("_id"))
    regs = (
        full.withColumn("_id", F.coalesce("doc_id", F.lit(-1)))
        .join(lead, ["node", "_id"], "left_semi")
        .dropDuplicates(["node"])
    )
    items = _keyed(regs)

    def sets_of(asked: DataFrame) -> DataFrame:
        ids = nodes.join(asked, "node", "left_semi").select(F.coalesce("least", F.lit(-1)).alias("_id"), "node")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in parts(batches, "text"):
                sets = list(shingle_sets(as_bytes(t.column("text")), width))
                ids = np.array([digest(s) for s in sets], np.int64)
                same = ids == t.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[same]), pa.array([s.tobytes() for s, k in zip(sets, same, strict=True) if k], pa.binary())],
                    ["node", "set"],
                )

        texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), "text")
        texts = Members(ids, "_id").of(texts, "_id").join(ids, "_id")
        return texts.select("node", "text").mapInArrow(run, "node long, set binary").dropDuplicates(["node"])

    labels = grouped(items, sets_of, BINS, BAND, percent, chance)
    named = labels.join(nodes.select("node", "least"), "node")
    names = named.join(named.groupBy("label").agg(F.min("least").alias("component")), "label").select("node", "component")
    by_node = nodes.select("node", "least").join(names, "node", "left").select("node", F.coalesce("component", "least").alias("component_id"))
    found = full.join(by_node, "node").select("row", "doc_id", "n", "component_id")
    empty = table.where("n = 0").select("row", "doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(empty).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row"
    )
