"""Katz backoff language model: learn n-gram counts, score every text.

P(w | v) = d(c) c(v, w) / c(v)         if the pair was seen c > 0 times,
         = alpha(v) P(w)               otherwise;
P(w)     = d(c) c(w) / N               if the word was seen,
         = what is left over           for the class of all unseen words.

d are Good-Turing discounts up to Katz's cutoff ``CUTOFF``, from the counts
of counts. Larger counts lose half a count, so that a context all of whose
successors are frequent still leaves something to other words; so do all
counts where a small corpus gives no Good-Turing discounts. alpha(v) normalises each context exactly:
(1 - sum of seen P(w | v)) / (1 - sum of P(w) over the w seen after v).
Contexts never seen have alpha 1. A text's tokens are its words (A-Z
lowered) and one end, which is also the context of the first word.

Scale. Texts are tokenised once into chunks of some 16 MB: the chunk's
distinct words (64-bit hashes) and the tokens as numbers of them, in a
table bucketed by chunk. Counts travel the other way round from a join of
tokens: a chunk asks each hash bucket for the words, later for the pairs,
that it holds, once each and with its own training counts (so a frequent
word or pair costs one entry a chunk); the bucket adds up and answers in
the same order. The answers, tables bucketed by chunk too, hold all counts
and context sums that the chunk's tokens need, and each chunk then scores
its tokens by the recursion above. Work and tables grow with the corpus;
the driver sees counts of counts only.

Edge cases: null and empty texts are one end token; rows of equal id are
scored each; a row whose ``train`` is null is not learned from; without
training tokens every score is 0 tokens' worth of knowledge: all words are
of the unseen class with probability 1; an empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.llm.common import shuffle_partitions, ship
from mooclens.llm.textnum import as_bytes, chunks, parts, word_hashes
from mooclens.session import ensure_checkpoint_dir

CHUNK = 16 << 20
CUTOFF = 5
#: What counts above the cutoff lose.
LESS = 0.5
#: Hash that stands for the end of a text.
END = np.uint64(0x7F4A7C159E3779B9)


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unzip(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by chunk, so that
    the joins by chunk move nothing."""
    spark = df.sparkSession
    table = f"katz_{name}_{uuid.uuid4().hex}"
    path = os.path.join(ensure_checkpoint_dir(spark), "mooclens-llm", table)
    writer = df.write.bucketBy(shuffle_partitions(spark), "chunk").option("compression", "zstd").option("path", path)
    writer.saveAsTable(table, format="parquet")
    return spark.table(table)


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _chunked(docs: DataFrame) -> DataFrame:
    """Chunks: ids and train flags of their documents, distinct words in
    order of their hashes, and the tokens as numbers of those words."""

    def packed(number: int, ids: list, train: list, hashes: list, sizes: list) -> pa.RecordBatch:
        words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        row = [
            [TaskContext.get().partitionId() << 24 | number],
            [ids],
            [train],
            [np.concatenate(sizes).astype(np.uint32).tobytes()],
            [words.tobytes()],
            [tokens.astype(np.uint32).tobytes()],
        ]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["chunk", "ids", "train", "sizes", "words", "tokens"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, train, hashes, sizes = 0, 0, [], [], [], []
        for t in parts(batches, "text"):
            texts = as_bytes(t.column("text"))
            doc_ids, flags = t.column("doc_id").to_pylist(), t.column("train").to_pylist()
            for a, b in chunks(texts):
                found, bounds = word_hashes(texts[a:b], lower=True)
                hashes.append(np.insert(found, bounds[1:], END))
                sizes.append(np.diff(bounds) + 1)
                ids += doc_ids[a:b]
                train += flags[a:b]
                held += sum(map(len, texts[a:b]))
                if held >= CHUNK:
                    yield packed(number, ids, train, hashes, sizes)
                    number, held, ids, train, hashes, sizes = number + 1, 0, [], [], [], []
        if ids:
            yield packed(number, ids, train, hashes, sizes)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "train")
    schema = "chunk long, ids array<long>, train array<boolean>, sizes binary, words binary, tokens binary"
    return rows.mapInArrow(run, schema)


class Chunk:
    """A chunk's arrays, unpacked."""

    def __init__(self, row):
        self.words = np.frombuffer(row.words, np.uint64)
        self.tokens = np.frombuffer(row.tokens, np.uint32).astype(np.int64)
        self.sizes = np.frombuffer(row.sizes, np.uint32).astype(np.int64)
        self.learned = np.repeat(np.array([bool(x) for x in row.train]), self.sizes)
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]  # an end precedes each text
        self.before[0] = np.searchsorted(self.words, END)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.learned], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (context, word) codes in order, and each token's place."""
        return np.unique(self.before * len(self.words) + self.tokens, return_inverse=True)


# ---- answers: (chunk, level, bucket, counts, sums), and statistics in rows of chunk -1
_ANSWER = "chunk long, level int, bucket int, counts binary, sums binary"


def _statistics(level: int, bucket: int, counts: np.ndarray) -> tuple:
    """Types, tokens, and counts of counts up to the cutoff and one more."""
    few = np.bincount(counts[counts <= CUTOFF + 1], minlength=CUTOFF + 2)[: CUTOFF + 2]
    return (-1, level, bucket, np.array([(counts > 0).sum(), counts.sum(), *few[1:]], np.int64).tobytes(), b"")


def _totals(answers: DataFrame) -> np.ndarray:
    total = np.zeros(CUTOFF + 3, np.int64)
    for r in answers.where("chunk = -1").select("counts").collect():  # one row a bucket
        total += np.frombuffer(r["counts"], np.int64)
    return total


def discounts(total: np.ndarray) -> np.ndarray:
    """Counts after discounting, for counts up to the cutoff."""
    n = np.concatenate([[0], total[2:]]).astype(float)
    k = CUTOFF
    r = np.arange(k + 1)
    out = np.zeros(k + 1)
    if (n[1 : k + 2] > 0).all() and (a := (k + 1) * n[k + 1] / n[1]) < 1:
        out[1:] = r[1:] * ((r[1:] + 1) * n[2 : k + 2] / (r[1:] * n[1 : k + 1]) - a) / (1 - a)
    if not ((out[1:] > 0) & (out[1:] < r[1:])).all():
        out[1:] = r[1:] - LESS
    return out


def discounted(counts: np.ndarray, few: np.ndarray) -> np.ndarray:
    return np.where(counts <= CUTOFF, few[np.minimum(counts, CUTOFF)], counts - LESS)


class Words:
    """P(w) from counts."""

    def __init__(self, total: np.ndarray):
        self.types, self.n = int(total[0]), int(total[1])
        self.few = discounts(total)
        low = total[2 : CUTOFF + 2]
        many = self.n - (low * np.arange(1, CUTOFF + 1)).sum() - LESS * (self.types - low.sum())
        self.unseen = 1 - ((low * self.few[1:]).sum() + many) / self.n if self.n else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.few) / max(self.n, 1), self.unseen)


def _word_requests(buckets: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples(index=False):
            c = Chunk(row)
            counts, cuts = c.word_counts(), np.searchsorted(_bucket_of(c.words, buckets), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[b], cuts[b + 1])
                out.append((b, row.chunk, c.words[own].tobytes(), _zip(counts[own].astype(np.uint32))))
        return pd.DataFrame(out, columns=["bucket", "chunk", "words", "counts"])

    return run


def _word_answers(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    words = [np.frombuffer(w, np.uint64) for w in rows["words"]]
    counts = np.concatenate([_unzip(c, np.uint32) for c in rows["counts"]])
    _, which = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(which, counts).astype(np.int64)
    answer = total[which]
    cuts = np.cumsum([0, *map(len, words)])
    out = [
        (chunk, 1, key[0], _zip(answer[i:j].astype(np.uint64)), b"")
        for chunk, i, j in zip(rows["chunk"], cuts[:-1], cuts[1:], strict=True)
    ]
    return pd.DataFrame([*out, _statistics(1, key[0], total)], columns=["chunk", "level", "bucket", "counts", "sums"])


def _answered(rows: pd.DataFrame, level: int) -> pd.DataFrame:
    return rows[rows["level"] == level].sort_values("bucket")


def _word_totals(answers: pd.DataFrame) -> np.ndarray:
    return np.concatenate([_unzip(x, np.uint64) for x in _answered(answers, 1)["counts"]]).astype(np.int64)


def _pair_requests(buckets: int):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in chunk.itertuples(index=False):
            c = Chunk(row)
            known = _word_totals(answers)
            codes, place = c.pairs()
            counts = np.bincount(place[c.learned], minlength=len(codes)).astype(np.uint32)
            v, w = codes // len(c.words), codes % len(c.words)
            cuts = np.searchsorted(_bucket_of(c.words[v], buckets), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[b], cuts[b + 1])
                context, runs = np.unique(v[own], return_counts=True)
                # 48 bits tell the successors of one context apart
                short = c.words[w[own]] >> np.uint64(16)
                out.append(
                    (
                        b,
                        row.chunk,
                        c.words[context].tobytes(),
                        _zip(runs.astype(np.uint32)),
                        (short >> np.uint64(16)).astype(np.uint32).tobytes(),
                        (short & np.uint64(0xFFFF)).astype(np.uint16).tobytes(),
                        _zip(known[w[own]].astype(np.uint64)),
                        _zip(counts[own]),
                    )
                )
        return pd.DataFrame(out, columns=["bucket", "chunk", "contexts", "runs", "high", "low", "known", "counts"])

    return run


def _pair_answers(words: Words):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        runs = [_unzip(x, np.uint32).astype(np.int64) for x in rows["runs"]]
        contexts = [np.frombuffer(x, np.uint64) for x in rows["contexts"]]
        _, context = np.unique(np.concatenate(contexts), return_inverse=True)
        v = np.repeat(context, np.concatenate(runs))
        high = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["high"]]).astype(np.int64)
        low = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["low"]]).astype(np.int64)
        order = np.lexsort((high << 16 | low, v))
        same = np.concatenate([[False], (np.diff(v[order]) == 0) & (np.diff((high << 16 | low)[order]) == 0)])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(~same) - 1
        total = np.bincount(which, np.concatenate([_unzip(x, np.uint32) for x in rows["counts"]])).astype(np.int64)
        first = order[~same]  # one entry of each distinct pair
        owner = v[first]
        known = np.concatenate([_unzip(x, np.uint64) for x in rows["known"]])[first].astype(np.int64)
        seen = total > 0
        n = int(context.max()) + 1
        # of each context: how many successors have count 1..cutoff, the
        # larger counts after discounting, and P(w) summed over those seen
        sums = np.zeros((n, CUTOFF + 2))
        for r in range(1, CUTOFF + 1):
            sums[:, r - 1] = np.bincount(owner[total == r], minlength=n)
        many = total > CUTOFF
        sums[:, CUTOFF] = np.bincount(owner[many], total[many] - LESS, minlength=n)
        sums[:, CUTOFF + 1] = np.bincount(owner[seen], words.probability(known[seen]), minlength=n)
        answer = total[which]
        out, at, c_at = [], 0, 0
        for chunk, own_runs, own_contexts in zip(rows["chunk"], runs, contexts, strict=True):
            size = int(own_runs.sum())
            own = answer[at : at + size]
            lacking = np.add.reduceat(own == 0, np.cumsum(own_runs) - own_runs) > 0
            asked = context[c_at : c_at + len(own_contexts)][lacking]
            out.append((chunk, 2, key[0], _zip(own.astype(np.uint64)), _zip(sums[asked])))
            at, c_at = at + size, c_at + len(own_contexts)
        return pd.DataFrame([*out, _statistics(2, key[0], total)], columns=["chunk", "level", "bucket", "counts", "sums"])

    return run


def backoff(sums: np.ndarray, context_counts: np.ndarray, few: np.ndarray) -> np.ndarray:
    """alpha of contexts from their sums and counts."""
    used = (sums[:, :CUTOFF] @ few[1:] + sums[:, CUTOFF]) / np.maximum(context_counts, 1)
    free = 1 - sums[:, CUTOFF + 1]
    return np.where(context_counts > 0, (1 - used) / np.maximum(free, 1e-300), 1.0)


_SCORES = (
    "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _scorer(words: Words, few: np.ndarray):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in chunk.itertuples(index=False):
            c = Chunk(row)
            known = _word_totals(answers)
            level = _answered(answers, 2)
            codes, place = c.pairs()
            pair = np.concatenate([_unzip(x, np.uint64) for x in level["counts"]]).astype(np.int64)
            v, w = codes // len(c.words), codes % len(c.words)
            sums = np.concatenate([_unzip(x, np.float64).reshape(-1, CUTOFF + 2) for x in level["sums"]])
            lacking = np.unique(v[pair == 0])  # contexts in order: those with sums
            alpha = np.ones(len(c.words))
            alpha[lacking] = backoff(sums, known[lacking], few)
            p = words.probability(known)
            log = np.log10(np.where(pair > 0, discounted(pair, few) / np.maximum(known[v], 1), alpha[v] * p[w]))
            base = np.log10((known + 0.5) / (words.n + 0.5 * (words.types + 1)))
            at = np.cumsum(c.sizes) - c.sizes
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array([None if x is None or x != x else int(x) for x in row.ids], "Int64"),
                        "train": [bool(x) for x in row.train],
                        "n_tokens": c.sizes,
                        "n_known": np.add.reduceat((known[c.tokens] > 0).astype(np.int64), at),
                        "train_tokens": words.n,
                        "base_score": np.add.reduceat(base[c.tokens], at),
                        "score": np.add.reduceat(log[place], at),
                    }
                )
            )
        if not out:
            return pd.DataFrame({n: [] for n in ("doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score")})
        return pd.concat(out)

    return run


def scores(docs: DataFrame, train) -> DataFrame:
    """One row for each document: doc_id, train, n_tokens, n_known,
    train_tokens, base_score (smoothed word frequencies), score (Katz), both
    log10 of the text's probability. ``train``: condition for learning."""
    spark = docs.sparkSession
    ship(spark)
    buckets = shuffle_partitions(spark)
    table = _bucketed(_chunked(docs.withColumn("train", F.coalesce(train, F.lit(False)))), "chunks")
    each = table.groupBy("chunk")
    asked = each.applyInPandas(_word_requests(buckets), "bucket int, chunk long, words binary, counts binary")
    ones = _bucketed(asked.groupBy("bucket").applyInPandas(_word_answers, _ANSWER), "words")
    words = Words(_totals(ones))
    own = ones.where("chunk >= 0").groupBy("chunk")
    schema = "bucket int, chunk long, contexts binary, runs binary, high binary, low binary, known binary, counts binary"
    asked = each.cogroup(own).applyInPandas(_pair_requests(buckets), schema)
    twos = _bucketed(asked.groupBy("bucket").applyInPandas(_pair_answers(words), _ANSWER), "pairs")
    few = discounts(_totals(twos))
    both = ones.unionByName(twos).where("chunk >= 0").groupBy("chunk")
    return each.cogroup(both).applyInPandas(_scorer(words, few), _SCORES)
