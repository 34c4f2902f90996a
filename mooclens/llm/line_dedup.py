"""Fuzzy line de-duplication by MinHash.

Lines (split at \\n) are judged whatever their length; blank ones stay. A
line's set is its character shingles (windows of ``WIDTH`` code points, A-Z
lowered; a shorter line is its only shingle). One-permutation signatures
are banded in rows of ``BAND``; candidates whose set sizes and registers
allow it are confirmed by exact Jaccard >= 0.8 on whole shingle sets, and
union-find over the links keeps one line of each component: the first by
(doc_id, line number). Equal lines (lowered, trimmed) are one node.

Sixteen bands of five miss a pair at 0.8 with probability 0.0017, at 0.85
with 0.0001; equal lines are never missed.

Edge cases: null text stays null; empty texts and lines stay; rows equal in
doc_id and text are one document and all come out alike; null ids come
last in order. A document whose lines all go gets the empty text. An empty
table gives no rows. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.llm.bitmap import Members
from mooclens.llm.common import stored
from mooclens.llm.hyperminhash import band_keys
from mooclens.llm.near import grouped
from mooclens.llm.onepermutation import probe_ranks
from mooclens.llm.textnum import LOWER, Layout, as_bytes, chunks, mix, parts

#: Code points of the shortest line to judge.
MIN_CHARS = 1
#: One changed character leaves a line of 49 characters or more above the threshold.
WIDTH = 5
BINS = 80
BAND = 5
#: Bits of a hash that tell a bin's hashes apart; the rest number the bins of a
#: chunk's lines.
TOP = 37
#: Lines of more windows are counted on whole hashes: TOP bits would begin to collide.
COUNTED = 2000
PERCENT = 80
_STRIP = bytes([0x20, *range(0x09, 0x0E)])


def judged(text: bytes, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, bytes]]:
    """(line number, trimmed line with A-Z lowered) of the lines to judge."""
    for k, line in enumerate(text.split(b"\n")):
        if len(line) < min_chars:
            continue
        line = line.strip(_STRIP)
        if len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode()) >= min_chars):
            yield k, line.lower()


def line_id(line: bytes) -> int:
    h = xxhash.xxh64_intdigest(line, 42)
    return h - (1 << 64) if h >> 63 else h


def shingle_sets(lines: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Ascending distinct hashes of each line's character windows; a line
    shorter than the window is its only shingle."""
    for a, b in chunks(lines):
        lay = Layout(lines[a:b])
        prefix = lay.prefix()
        starts = np.flatnonzero((lay.buf & 0xC0) != 0x80)  # code points
        at = np.searchsorted(starts, lay.begin)
        for i in range(b - a):
            own = starts[at[i] : at[i + 1]]  # with the space that ends it
            n = max(1, len(own) - width)
            first, last = own[:n], own[width : width + n] if len(own) > width else own[-1:]
            yield np.unique(lay.span_hashes(first, last, prefix))


def signatures(lines: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of each line, and its registers: 16 bits of each
    bin's least window hash, empty bins densified. All lines at once."""
    lay = Layout(lines)
    starts = np.flatnonzero((lay.buf & 0xC0) != 0x80)  # code points, and the space after each line
    at = np.searchsorted(starts, lay.begin)
    own = np.repeat(np.arange(len(lines)), np.diff(at))
    place = np.arange(len(starts)) - at[own]
    size = np.diff(at)[own] - 1
    window = np.flatnonzero(place <= np.maximum(size - width, 0))
    last = np.minimum(window + width, at[own[window]] + size[window])
    h = lay.span_hashes(starts[window], starts[last])
    slot = own[window].astype(np.uint64) * np.uint64(BINS) + (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32))
    # one sort of (bin, top of the hash) puts each bin's least hash first
    ordered = np.sort(slot << np.uint64(TOP) | h >> np.uint64(64 - TOP))
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    count = np.bincount((ordered[new] >> np.uint64(TOP)).astype(np.int64) // BINS, minlength=len(lines))
    cuts = np.searchsorted(own[window], np.arange(len(lines) + 1))
    for i in np.flatnonzero(np.diff(cuts) > COUNTED):
        count[i] = len(np.unique(h[cuts[i] : cuts[i + 1]]))
    slot = ordered >> np.uint64(TOP)
    first = np.concatenate([[True], slot[1:] != slot[:-1]])
    least, full = np.zeros(len(lines) * BINS, np.uint64), np.zeros(len(lines) * BINS, bool)
    least[slot[first]], full[slot[first]] = ordered[first] & np.uint64((1 << TOP) - 1), True
    least, full = least.reshape(-1, BINS), full.reshape(-1, BINS)
    # each empty bin asks the others in its own order (as in densified)
    order = np.argsort(probe_ranks(BINS), axis=1)
    out, (line, empty) = least.copy(), np.nonzero(~full)
    for turn in range(BINS):
        if not len(line):
            break
        ask = order[empty, turn]
        fits = full[line, ask]
        out[line[fits], empty[fits]] = least[line[fits], ask[fits]]
        line, empty = line[~fits], empty[~fits]
    return count, (mix(out) >> np.uint64(48)).astype(np.uint16)


def _occurrences(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line, node) of the judged lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in parts(batches, "text"):
            out = []
            for row, doc, text in zip(t.column("row").to_pylist(), t.column("doc_id").to_pylist(), as_bytes(t.column("text")), strict=True):
                out += [(row, doc, k, line_id(line)) for k, line in judged(text)]
            cols = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                ["row", "doc_id", "line", "node"],
            )

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, line int, node long")


def _signatures(docs: DataFrame) -> DataFrame:
    """(node, n, regs) of the judged lines, n the size of the shingle set;
    repeats within a part once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in parts(batches, "text"):
            lines = {line_id(line): line for text in as_bytes(t.column("text")) for _, line in judged(text)}
            nodes, texts = list(lines), list(lines.values())
            for a, b in chunks(texts):
                sizes, regs = signatures(texts[a:b])
                blobs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BINS), b - a, [None, pa.py_buffer(regs.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a:b], pa.int64()), pa.array(sizes), blobs.cast(pa.binary())], ["node", "n", "regs"])

    return docs.select("text").mapInArrow(run, "node long, n long, regs binary")


def _keyed(signatures: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, BINS)
            keys = band_keys(regs, BAND)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.reshape(-1))
            yield pa.RecordBatch.from_arrays([*t.columns, lists], [*t.schema.names, "keys"])

    return signatures.mapInArrow(run, "node long, n long, regs binary, keys array<long>")


def chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Different minima agree in their 16 stored bits by chance."""
    return np.full(len(na), 2.0**-16)


def line_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, label) of lines that are near another line."""
    signatures = stored(_signatures(docs), "line-signatures")

    def sets_of(asked: DataFrame) -> DataFrame:
        wanted = Members(asked, "node")

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in parts(batches, "text"):
                found = {line_id(line): line for text in as_bytes(t.column("text")) for _, line in judged(text)}
                may = wanted.hold(np.fromiter(found, np.int64, len(found)))
                found = {k: line for (k, line), held in zip(found.items(), may.tolist(), strict=True) if held}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["node", "set"]
                )

        texts = docs.select("text").mapInArrow(lines, "node long, set binary")
        return texts.join(asked, "node", "left_semi").dropDuplicates(["node"])

    def unpack(lines: list[bytes]) -> list[np.ndarray]:
        return list(shingle_sets(lines))

    # lines travel as they are, their larger sets are made where they are compared
    return grouped(_keyed(signatures), sets_of, BINS, BAND, percent, chance, unpack=unpack)


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(row, doc_id, removed): for documents (row, doc_id, text) with
    repeated lines, the line numbers that go."""
    seen = stored(_occurrences(docs), "line-occurrences")
    labels = line_groups(docs, percent)
    # the first place of each node, then of each component
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "line")
    nodes = seen.groupBy("node").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = nodes.join(labels, "node", "left").where("n > 1 or label is not null")
    nodes = stored(nodes.withColumn("label", F.coalesce("label", "node")), "line-nodes")
    kept = nodes.groupBy("label").agg(F.min("first").alias("kept"))
    fate = nodes.join(kept, "label").select("node", F.col("kept.row").alias("kept_row"), F.col("kept.line").alias("kept_line"))
    gone = seen.join(fate, "node").where(~((F.col("row") == F.col("kept_row")) & (F.col("line") == F.col("kept_line"))))
    return gone.groupBy("row", "doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` (all its columns) with repeated lines taken out of
    ``text``, and n_lines and removed_lines (the line numbers that went, from 0),
    which replace columns of those names."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), doc_id.alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row"))
    gone = removed_lines(rows.select("row", "doc_id", "text"), percent).select(F.col("row").alias("_row"), F.col("doc_id").alias("_id"), "removed")
    joined = rows.join(gone, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    lines = F.split("text", "\n", -1)
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("removed", i)), "\n")
    own = [c for c in docs.columns if c not in ("n_lines", "removed_lines")]
    # the document's columns are unpacked last: theirs may be any names
    out = joined.select(
        "doc",
        F.struct(
            F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest).alias("text"),
            F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
            F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"),
        ).alias("new"),
    )
    return out.select(
        *[F.col("new" if c == "text" else "doc").getField(c).alias(c) for c in own], F.col("new.n_lines"), F.col("new.removed_lines")
    )
