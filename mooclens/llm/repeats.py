"""Removal of repeated passages by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``ANCHOR`` =
7 words. A passage of 13 words or more that two documents share holds one
whole reference block of either of them, wherever it starts, so looking up
every rolling window of 7 words among the blocks misses none. Hits are
extended word by word: a window of 13 words around a hit is compared with
all windows of 13 words that hold a hit, and runs of those that also start
in a document of a smaller id merge into the maximal repeats that go.

How it runs: texts are kept in chunks of about 8 MB, a table bucketed by
chunk. A chunk asks hash buckets for its distinct rolling windows (four
bytes each, whatever their number of occurrences) and says which of them are
its blocks; a bucket answers a bit for each: a block somewhere, and asked
for by two documents. Windows of 13 words around hits then ask, with 96 bits
and their least doc_id in the chunk, whether a smaller one is elsewhere.
Buckets are numbered by the count of words, so a task's memory is bounded by
the chunk or the bucket; a passage that a third of all documents share is one
entry of each chunk. Only narrow keys are shuffled, never text or pairs.

Edge cases: null text has no words; documents of fewer than 13 words stay
whole; a null doc_id is greater than every other; rows of one doc_id do not
remove each other's words, and a window repeated inside one document stays.
Very long texts are chunks of their own, ending a chunk early. Other columns
than doc_id and text are not read, whatever their names. An empty table gives
no rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.llm.common import shuffle_partitions, ship, stored
from mooclens.llm.textnum import BASE, INVERSE, Layout, as_bytes, mix, parts
from mooclens.session import ensure_checkpoint_dir

WIDTH = 13
ANCHOR = 7
CHUNK = 8 << 20
#: Words of the corpus for each hash bucket, of blocks and of windows.
BLOCK_BUCKET = 4 << 20
WINDOW_BUCKET = 2 << 20
LAST = np.iinfo(np.int64).max
_SECOND = np.uint64(0xA24BAED4963EE407)


def _bucketed(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by chunk: joining
    answers to it moves the answers only."""
    spark = df.sparkSession
    table = f"repeats_chunks_{uuid.uuid4().hex}"
    path = os.path.join(ensure_checkpoint_dir(spark), "mooclens-llm", table)
    writer = df.write.bucketBy(shuffle_partitions(spark), "chunk").option("compression", "zstd").option("path", path)
    writer.saveAsTable(table, format="parquet")
    return spark.table(table)


def _chunked(docs: DataFrame) -> DataFrame:
    """Chunks of documents: ids, texts, and the number of bytes."""

    def packed(number: int, ids: list, texts: list) -> pa.RecordBatch:
        row = [[TaskContext.get().partitionId() << 24 | number], [sum(map(len, texts))], [ids], [texts]]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["chunk", "bytes", "ids", "texts"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, texts = 0, 0, [], []
        for t in parts(batches, "text", CHUNK):
            for i, x in zip(t.column("doc_id").to_pylist(), as_bytes(t.column("text")), strict=True):
                ids.append(i)
                texts.append(x)
                held += len(x) + 16  # many empty texts fill a chunk too
                if held >= CHUNK:
                    yield packed(number, ids, texts)
                    number, held, ids, texts = number + 1, 0, [], []
        if ids:
            yield packed(number, ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "chunk long, bytes long, ids array<long>, texts array<binary>")


class _Rolling:
    """Hashes of all windows of a sequence of word hashes, for any width."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        powers, inverses = np.full(n + 1, BASE, np.uint64), np.full(n + 1, INVERSE, np.uint64)
        powers[0] = inverses[0] = 1
        self.inverses = np.cumprod(inverses, dtype=np.uint64)
        powers = np.cumprod(powers, dtype=np.uint64)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers[:n], out=self.prefix[1:])

    def at(self, start: np.ndarray, width: int) -> np.ndarray:
        return mix((self.prefix[start + width] - self.prefix[start]) * self.inverses[start])


def _slices(first_hash: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets in sorted hashes: their upper 32 bits decide."""
    number = ((first_hash >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(number, np.arange(buckets + 1, dtype=np.uint64))


class Chunk:
    """A chunk's words, rolling windows and what it asks for."""

    def __init__(self, row):
        self.ids = [None if x is None or x != x else int(x) for x in row.ids]
        self.lay = Layout([bytes(x) for x in row.texts])
        self.start, self.end = self.lay.words()
        self.bounds = np.searchsorted(self.start, self.lay.begin)
        self.counts = np.diff(self.bounds)
        self.words = self.lay.span_hashes(self.start, self.end)
        doc = np.array([LAST if x is None else x for x in self.ids], np.int64)
        self.doc = np.repeat(doc, self.counts)
        self.left = np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.words))  # words from here to the end
        self.whole = np.repeat(self.counts, self.counts) >= WIDTH
        self.place = np.arange(len(self.words)) - np.repeat(self.bounds[:-1], self.counts)

    def blocks(self) -> None:
        """Distinct rolling windows in order of their hashes (``keys``), and
        of each whether it is a block here and whether two documents have it."""
        self.at = np.flatnonzero(self.whole & (self.left >= ANCHOR))
        found = _Rolling(self.words).at(self.at, ANCHOR)
        order = np.argsort(found, kind="stable")
        ranked = found[order]
        head = np.ones(len(ranked), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        first = np.flatnonzero(head)
        self.keys = ranked[first]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(head) - 1
        if len(first):
            block, docs = (self.place[self.at] % ANCHOR == 0)[order], self.doc[self.at][order]
            self.block = np.logical_or.reduceat(block, first)
            self.shared = np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first)
        else:
            self.block = self.shared = np.zeros(0, bool)

    def windows(self, hit: np.ndarray) -> None:
        """Windows of 13 words that hold a hit: distinct ones in order of
        their hashes, each with its least document here."""
        mark = np.zeros(len(self.words) + 1, np.int64)
        mark[self.at + 1] = hit[self.which]
        total = np.cumsum(mark)
        start = np.flatnonzero(self.left >= WIDTH)
        self.begin = start[total[start + WIDTH - ANCHOR + 1] > total[start]]
        one = _Rolling(self.words).at(self.begin, WIDTH)
        two = (_Rolling(mix(self.words ^ _SECOND)).at(self.begin, WIDTH) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        head = np.ones(len(one), bool)
        head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(head)
        self.one, self.two = one[first], two[first]
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(head) - 1
        self.least = np.minimum.reduceat(self.doc[self.begin][order], first) if len(first) else np.zeros(0, np.int64)

    def kept(self, earlier: np.ndarray) -> pd.DataFrame:
        """The documents without the words of windows that start earlier."""
        gone = self.begin[earlier[self.kind] | (self.doc[self.begin] > self.least[self.kind])]
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WIDTH, -1)
        out = np.cumsum(edge)[:-1] > 0
        stays = np.flatnonzero(~out)
        inside = np.zeros(len(self.lay.buf) + 1, np.int8)
        inside[self.start[stays]] = 1
        inside[self.end[stays] + 1] -= 1  # a word and the white space after it
        inside = np.cumsum(inside, dtype=np.int8)[:-1].astype(bool)
        text = self.lay.buf.copy()
        text[self.end[stays]] = 0x20
        at = np.concatenate([[0], np.cumsum(inside)])[self.lay.begin]
        joined = text[inside].tobytes()
        change = np.diff(np.concatenate([[0], out.astype(np.int8), [0]]))
        # a passage that ends a document and one that begins the next are two
        cut = np.intersect1d(self.bounds[1:-1], np.flatnonzero(out[1:] & out[:-1]) + 1) if len(out) else np.zeros(0, np.int64)
        begins = np.sort(np.concatenate([np.flatnonzero(change == 1), cut]))
        ends = np.sort(np.concatenate([np.flatnonzero(change == -1), cut]))
        of = np.searchsorted(begins, self.bounds)
        removed = np.concatenate([[0], np.cumsum(out)])[self.bounds]
        spans = [
            [{"start": int(a - lo), "end": int(b - lo)} for a, b in zip(begins[i:j], ends[i:j], strict=True)]
            for lo, i, j in zip(self.bounds[:-1], of[:-1], of[1:], strict=True)
        ]
        return pd.DataFrame(
            {
                "doc_id": pd.array(self.ids, "Int64"),
                "n_words": self.counts,
                "n_removed": np.diff(removed),
                "removed": spans,
                "kept": [joined[a : max(a, b - 1)].decode() for a, b in zip(at[:-1], at[1:], strict=True)],
            }
        )


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)


def _block_requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for row in t.to_pandas().itertuples(index=False):
                c = Chunk(row)
                c.blocks()
                cut = _slices(c.keys, buckets)
                low = c.keys.astype(np.uint32)
                rows = [
                    (b, row.chunk, int(j - i), low[i:j].tobytes(), _bits(c.block[i:j]), _bits(c.shared[i:j]))
                    for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True))
                    if j > i
                ]
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "n", "keys", "block", "shared"])

    return run


_ANSWER = "level int, bucket int, chunk long, n long, bits binary"


def _answers(level: int, asked: pd.DataFrame, said: np.ndarray) -> pd.DataFrame:
    at = np.concatenate([[0], np.cumsum(asked["n"])])
    bits = [_bits(said[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
    return pd.DataFrame({"level": level, "bucket": asked["bucket"], "chunk": asked["chunk"], "n": asked["n"], "bits": bits})


def _block_answers(asked: pd.DataFrame) -> pd.DataFrame:
    """A bit for each window asked for: it is a block of a document and two
    documents have it."""
    keys = np.frombuffer(b"".join(asked["keys"]), np.uint32)
    block = np.concatenate([_unbits(x, n) for x, n in zip(asked["block"], asked["n"], strict=True)])
    shared = np.concatenate([_unbits(x, n) for x, n in zip(asked["shared"], asked["n"], strict=True)])
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(first, len(ranked)))
    hit = np.logical_or.reduceat(block[order], first) & ((sizes > 1) | np.logical_or.reduceat(shared[order], first))
    said = np.empty(len(keys), bool)
    said[order] = np.repeat(hit, sizes)
    return _answers(1, asked, said)


def _answered(answers: pd.DataFrame, level: int) -> np.ndarray:
    own = answers[answers["level"] == level].sort_values("bucket")
    return np.concatenate([np.zeros(0, bool), *(_unbits(x, n) for x, n in zip(own["bits"], own["n"], strict=True))])


_ASKED = ["bucket", "chunk", "n", "one", "two", "least"]


def _window_requests(buckets: int):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in chunk.itertuples(index=False):
            c = Chunk(row)
            c.blocks()
            c.windows(_answered(answers, 1))
            cut = _slices(c.one, buckets)
            rows += [
                (b, row.chunk, j - i, c.one[i:j].tobytes(), c.two[i:j].tobytes(), c.least[i:j].tobytes())
                for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True))
                if j > i
            ]
        return pd.DataFrame(rows, columns=_ASKED)

    return run


def _window_answers(asked: pd.DataFrame) -> pd.DataFrame:
    """A bit for each window asked for: it starts in a document smaller than
    the least that the asking chunk knows."""
    one = np.frombuffer(b"".join(asked["one"]), np.uint64)
    two = np.frombuffer(b"".join(asked["two"]), np.uint32)
    least = np.frombuffer(b"".join(asked["least"]), np.int64)
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    sizes = np.diff(np.append(first, len(a)))
    said = np.empty(len(one), bool)
    said[order] = np.repeat(np.minimum.reduceat(least[order], first), sizes) < least[order]
    return _answers(2, asked, said)


def _remove(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    out = []
    for row in chunk.itertuples(index=False):
        c = Chunk(row)
        c.blocks()
        c.windows(_answered(answers, 1))
        out.append(c.kept(_answered(answers, 2)))
    return pd.concat(out) if out else pd.DataFrame({n: [] for n in ("doc_id", "n_words", "n_removed", "removed", "kept")})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, removed (spans
    of words, end exclusive) and kept (the words that stay, joined by one
    space)."""
    spark = docs.sparkSession
    ship(spark)
    chunks = _bucketed(_chunked(docs))
    words = (chunks.agg(F.sum("bytes")).first()[0] or 0) // 6
    asked = chunks.mapInArrow(
        _block_requests(int(words // BLOCK_BUCKET) + 1), "bucket int, chunk long, n long, keys binary, block binary, shared binary"
    )
    each = chunks.groupBy("chunk")
    ones = stored(asked.groupBy("bucket").applyInPandas(_block_answers, _ANSWER), "repeats-blocks")
    asked = each.cogroup(ones.groupBy("chunk")).applyInPandas(
        _window_requests(int(words // WINDOW_BUCKET) + 1), "bucket int, chunk long, n long, one binary, two binary, least binary"
    )
    twos = stored(asked.groupBy("bucket").applyInPandas(_window_answers, _ANSWER), "repeats-windows")
    return each.cogroup(ones.unionByName(twos).groupBy("chunk")).applyInPandas(
        _remove, "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"
    )
