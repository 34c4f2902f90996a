"""Packing token sequences by exact-complement hashing, then best fit.

Documents are tokenised whole; those longer than a sequence are cut into
full pieces and a rest. Which lengths share a sequence depends only on how
many pieces have each length, a table of at most ``size`` numbers, however
large the corpus. From it the plan is made: for the longest open length,
indexes of single, pair and triple sums give combinations that fill its gap
exactly, used as often as the available counts allow; what has no exact
complement is packed by best fit, in batches too. The plan's runs are
bounded by the number of lengths as each run uses up one length.

Pieces find their place by their rank among the pieces of equal length.
Ranks are counted in hash buckets, so a length that a third of all pieces
share is no hot group.

Edge cases: a null or empty text is the end id alone; equal rows are packed
each; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mooclens.llm.common import ship, stored
from mooclens.llm.textnum import Layout, as_bytes, chunks, parts

SIZE = 4096
END_ID = 1
BUCKET_ROWS = 200_000
#: A worker forgets the ids of its distinct words when they take more bytes,
#: and at the end of each task: what stays of a task is the tokenizer alone.
WORD_BYTES = 16 << 20
#: Words of a line for the tokenizer, and of the lines it is given at once: a
#: word alone costs it more than twice the time, and what it returns is large.
LINE_WORDS, TOLD_WORDS = 64, 8192

_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids of texts by way of their distinct words.

    For a tokenizer that drops white space and starts a new token at each
    word, a text's ids are its words' ids in order, so every distinct word
    is encoded once and kept, by hash, for later chunks of the task. Words are split at ASCII white space only; anything else in a
    word is left to the tokenizer."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.clear()

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.at, self.size, self.flat))

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes, ascending
        self.at = np.zeros(0, np.int64)  # where a word's ids are in flat
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and the number of each word's ids. Words go
        to the tokenizer in lines; where a token begins tells its word."""
        lines = [words[a : a + LINE_WORDS] for a in range(0, len(words), LINE_WORDS)]
        flat, size = [], []
        for line, e in zip(lines, self.tok.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ends = np.cumsum([len(w) + 1 for w in line])
            begins = np.fromiter((a for a, _ in e.offsets), np.int64, len(e))
            flat.append(np.array(e.ids, np.uint32))
            size.append(np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(line)))
        return np.concatenate(flat), np.concatenate(size)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        found = [self._encoded([w.decode() for w in words[a : a + TOLD_WORDS]]) for a in range(0, len(words), TOLD_WORDS)]
        flat, size = (np.concatenate(x) for x in zip(*found, strict=True))
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, flat])
        to = np.searchsorted(self.keys, hashes)
        self.keys, self.at, self.size = (np.insert(x, to, y) for x, y in ((self.keys, hashes), (self.at, at), (self.size, size)))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32) and bounds by text."""
        lay = Layout(texts)
        start, end = lay.words()
        distinct, first, which = np.unique(lay.span_hashes(start, end), return_index=True, return_inverse=True)
        if self.nbytes() > WORD_BYTES:
            self.clear()
        new = first[~np.isin(distinct, self.keys, assume_unique=True)]
        if len(new):
            raw = lay.buf.tobytes()
            words = [raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            self._learn(lay.span_hashes(start[new], end[new]), words)
        own = np.searchsorted(self.keys, distinct)[which]
        size = self.size[own]
        ends = np.cumsum(size)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[own] - (ends - size), size)
        bounds = np.concatenate([[0], ends])[np.searchsorted(start, lay.begin)]
        return self.flat[take], bounds


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    """One for each worker."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        for batch in parts(batches, "text"):
            texts = as_bytes(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b in chunks(texts, 2 << 20):
                ids, bounds = tok.encode(texts[a:b])
                rows = []
                for i in range(b - a):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    for n, at in enumerate(range(0, len(own), size)):
                        part = own[at : at + size]
                        rows.append((doc_ids[a + i], n, at, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES
                )
        tok.clear()

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, _PIECES_DDL)


def _fill(have: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One to three available lengths that sum to ``gap``, longest first."""

    def pair(g: int, most: int) -> tuple[int, int] | None:
        low = np.arange(max(1, g - most), g // 2 + 1)
        ok = low[(have[low] > 0) & (have[g - low] > 0) & ((low * 2 != g) | (have[low] > 1))]
        return (int(g - ok[0]), int(ok[0])) if len(ok) else None

    if have[gap]:
        return (gap,)
    if found := pair(gap, gap):
        return found
    top = np.flatnonzero(have[: gap + 1])[::-1]
    for a in top.tolist():
        if a * 3 < gap:
            break
        have[a] -= 1
        found = pair(gap - a, a) if gap - a >= 2 else None
        have[a] += 1
        if found:
            return (a, *found)
    return None


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths of a sequence, how many such sequences) for
    ``counts[length]`` pieces of each length up to len(counts) - 1."""
    size = len(counts) - 1
    have = counts.copy()
    runs = []
    while len(open_ := np.flatnonzero(have)):
        items = [int(open_[-1])]
        gap = size - items[0]
        have[items[0]] -= 1
        while gap:
            if exact := _fill(have, gap):
                for x in exact:
                    have[x] -= 1
                items += exact
                break
            # no complement yet: the longest that fits opens a new gap
            fits = np.flatnonzero(have[: gap + 1])
            if not len(fits):
                break
            x = int(fits[-1])
            items.append(x)
            have[x] -= 1
            gap -= x
        need = np.bincount(items, minlength=size + 1)
        used = np.flatnonzero(need)
        more = int((have[used] // need[used]).min())
        have[used] -= more * need[used]
        runs.append((tuple(items), 1 + more))
    return runs


def _slots(runs: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """A row for each item of each run: pieces of ``length`` with ranks from
    ``first`` go to sequences from ``sequence``, at ``offset``."""
    rows, used, sequence = [], {}, 0
    for items, times in runs:
        offset = 0
        for x in items:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def ranked(rows: DataFrame, key: str, order: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``rank`` (from 0) among those of equal ``key``, counted
    in hash buckets of about ``bucket_rows``: no task holds a whole key. Keys
    must be few (lengths are at most ``SIZE``), as their counts are broadcast."""
    per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
    cut = rows.join(F.broadcast(per_key), key).withColumn(
        "_bucket", F.pmod(F.xxhash64(*order), F.ceil(F.col("_all") / bucket_rows)).cast("long")
    )
    per_bucket = cut.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    by_bucket = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.withColumn("_before", F.coalesce(F.sum("_rows").over(by_bucket), F.lit(0))).drop("_rows")
    inside = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1
    # else the window would take a partitioning by the key alone
    return cut.repartition(key, "_bucket").withColumn("_inside", inside).join(before, [key, "_bucket"]).withColumn("rank", F.col("_before") + F.col("_inside")).drop("_all", "_bucket", "_inside", "_before")


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``cut`` (pieces with doc_id, piece, length) with sequence_id, offset."""
    cut = stored(cut, "pack-pieces")
    counts = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``size`` rows
        counts[r["length"]] = r["count"]
    slots = _slots(plan(counts))
    key = slots["length"].to_numpy(np.int64) << 44 | slots["first"].to_numpy(np.int64)
    first, sequence, offset = (slots[c].to_numpy(np.int64) for c in ("first", "sequence", "offset"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(key, length.to_numpy(np.int64) << 44 | rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy(np.int64) - first[at], "offset": offset[at]})

    return (
        ranked(cut, "length", ["doc_id", "piece", "ids_crc32"])
        .withColumn("_to", place("length", "rank"))
        .select("*", "_to.sequence_id", "_to.offset")
        .drop("_to", "rank")
    )
