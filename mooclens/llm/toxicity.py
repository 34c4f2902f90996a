"""Toxicity by the nearest labelled examples in exact TF-IDF cosine.

Learning (from labelled rows that the caller allows):

* At most ``EXAMPLES`` labelled documents of either class, least hashes of
  the id first, whole texts: the documented bound of the classifier.
* Terms are runs of letters, A-Z lowered, and their first 4 and 5 bytes, so
  that inflected and compounded forms meet. Those that tell the classes apart
  (log-likelihood ratio and odds ratio on the examples) make the vocabulary, at most
  ``TERMS``. Their inverse document frequencies count all documents.
* Example vectors ((1 + ln tf) * idf, length 1) go into an inverted index
  in blocks of ``BLOCK`` examples with the block's greatest weight per term.

Search: block bounds sum the block maxima over a text's terms; blocks are
scored in order of their bounds until the bound falls below the worst of
the ``K`` best. The result is exact, ties by example number.

Score: votes weighted by 1 / (0.1 + distance) and by how many documents an
example of its class stands for, with a prior vote of the toxic share, mapped to a probability by a monotone fit
on the examples' own leave-one-out votes. A text without any vocabulary
term scores the smoothed toxic share of such examples.

Edge cases: null and empty texts have no terms; several labels of one id
count as toxic if any is; null labels and ids are not learned; without
examples of either class, every score is the smoothed toxic share (0 if
there is none); rows of equal ids are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.llm.common import least_hashes, stored
from mooclens.llm.textnum import NOT_LETTERS, Layout, as_bytes, chunks, mix, parts

EXAMPLES = 4096
TERMS = 1024
LEAST_G2 = 28.0
LEAST_ODDS = 4.0
PREFIXES = (4, 5)
BLOCK = 64
K = 15
#: Weight of the classes' shares among the votes: far neighbours count little.
PRIOR = 10.0


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Signed hashes of all terms, and bounds by text: the words, and for
    words longer than that their first ``PREFIXES`` bytes."""
    lay = Layout(texts, lower=True)
    prefix = lay.prefix()
    start, end = lay.words(NOT_LETTERS)
    owner = [lay.text_of(start)]
    hashes = [lay.span_hashes(start, end, prefix)]
    for n in PREFIXES:
        long = start[end - start > n]
        owner.append(lay.text_of(long))
        hashes.append(mix(lay.span_hashes(long, long + n, prefix) + np.uint64(n)))
    by_text = np.argsort(np.concatenate(owner), kind="stable")
    bounds = np.searchsorted(np.concatenate(owner)[by_text], np.arange(len(texts) + 1))
    return np.concatenate(hashes)[by_text].view(np.int64), bounds


def _term_counts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct terms of each text, and how often."""
    for a, b in chunks(texts):
        hashes, bounds = _terms(texts[a:b])
        for i in range(b - a):
            yield np.unique(hashes[bounds[i] : bounds[i + 1]], return_counts=True)


def _known(texts: list[bytes], vocabulary: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions in the vocabulary, counts) of each text."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(vocabulary):
        return [none] * len(texts)
    out = []
    for a, b in chunks(texts):
        hashes, bounds = _terms(texts[a:b])
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        hit = np.flatnonzero(vocabulary[at] == hashes)
        ends = np.searchsorted(hit, bounds)
        for i in range(b - a):
            found = at[hit[ends[i] : ends[i + 1]]]
            out.append(np.unique(found, return_counts=True) if len(found) else none)
    return out


class BlockMaxIndex:
    """Example vectors in blocks, with each block's greatest term weights."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray]], doc_ids, toxic, stands_for):
        self.vocabulary, self.idf = vocabulary, idf
        vectors = [self.vector(*e) for e in examples]
        # examples that share their heaviest term are neighbours in the index
        heaviest = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
        order = np.lexsort((doc_ids, [len(t) for t, _ in vectors], heaviest))
        order = order[[heaviest[i] >= 0 for i in order]] if len(order) else order
        self.vectors = [vectors[i] for i in order]
        self.doc_ids, self.toxic = np.asarray(doc_ids, np.int64)[order], np.asarray(toxic, float)[order]
        self.weight = np.array([stands_for[int(y)] for y in self.toxic])
        blocks = -(-len(order) // BLOCK)
        self.most = np.zeros((len(vocabulary), blocks))
        lists: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
        for e, (terms, w) in enumerate(self.vectors):
            for t, x in zip(terms.tolist(), w.tolist(), strict=True):
                lists[t].append((e, x))
                self.most[t, e // BLOCK] = max(self.most[t, e // BLOCK], x)
        self.posts = [(np.array([e for e, _ in p], np.int64), np.array([x for _, x in p])) for p in lists]
        self.starts = [np.searchsorted(e, np.arange(blocks + 1) * BLOCK) for e, _ in self.posts]
        zero = [int(toxic[i]) for i, h in enumerate(heaviest) if h < 0]
        total = sum(stands_for[y] for y in zero)
        self.share = share = sum(stands_for[int(y)] for y in toxic if y) / max(1.0, sum(stands_for[int(y)] for y in toxic))
        self.no_terms = (sum(stands_for[y] for y in zero if y) + share) / (total + 1)
        self.votes, self.chances = np.array([0.5]), np.array([share])

    def vector(self, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.idf[terms]
        return terms, w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int = K, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine above 0, and their cosines."""
        bound = w @ self.most[terms]
        best_e, best_s, worst = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best_e) == k and bound[b] < worst - 1e-12):
                break
            score = np.zeros(BLOCK)
            for t, x in zip(terms, w, strict=True):
                i, j = self.starts[t][b], self.starts[t][b + 1]
                score[self.posts[t][0][i:j] - b * BLOCK] += x * self.posts[t][1][i:j]
            hit = np.flatnonzero(score > 0)
            hit = hit[hit + b * BLOCK != without]
            best_e, best_s = np.append(best_e, hit + b * BLOCK), np.append(best_s, score[hit])
            keep = np.lexsort((best_e, -best_s.round(12)))[:k]
            best_e, best_s = best_e[keep], best_s[keep]
            worst = best_s[-1] if len(best_s) else 0.0
        return best_e, best_s

    def vote(self, examples: np.ndarray, cosines: np.ndarray) -> float:
        w = self.weight[examples] / (0.1 + np.maximum(0, 1 - cosines))
        return float(((w * self.toxic[examples]).sum() + PRIOR * self.share) / (w.sum() + PRIOR))

    def calibrate(self) -> None:
        """Monotone map from votes to toxic shares, fitted on the examples'
        votes without themselves; neighbours in order are pooled while their
        shares fall."""
        votes = [(self.vote(*found), e) for e, v in enumerate(self.vectors) if len((found := self.nearest(*v, without=e))[0])]
        pools: list[list[float]] = []
        for v, e in sorted(votes):
            pools.append([self.weight[e] * v, self.weight[e] * self.toxic[e], self.weight[e]])
            while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][2] < 5):
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
        if pools:
            self.votes = np.array([p[0] / p[2] for p in pools])
            self.chances = np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])

    def score(self, terms: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if len(terms):
            found, cosines = self.nearest(*self.vector(terms, n))
            if len(found):
                return float(np.interp(self.vote(found, cosines), self.votes, self.chances)), found, cosines
        return self.no_terms, np.zeros(0, np.int64), np.zeros(0)


def examples(docs: DataFrame, labels: DataFrame, learn, most: int = EXAMPLES) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, toxic, text) of the examples, and how many labelled
    documents an example of each class stands for. ``learn``: a condition
    on documents."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    usable = docs.where(learn & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = stored(marked.join(usable.select("doc_id").distinct(), "doc_id"), "tox-labelled")
    ids = stored(least_hashes(known, "toxic", ["doc_id"], most), "tox-sample")
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    texts = usable.join(ids, "doc_id").select("doc_id", "toxic", "text")
    return stored(texts.dropDuplicates(["doc_id"]), "tox-examples"), {y: totals[y] / chosen[y] for y in chosen}


def vocabulary(texts: DataFrame, terms: int = TERMS) -> np.ndarray:
    """Hashes of the terms that tell the classes apart, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            found = list(_term_counts(as_bytes(t.column("text"))))
            sizes = [len(x) for x, _ in found]
            toxic = np.repeat(np.array(t.column("toxic").to_pylist(), np.int64), sizes)
            flat = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(toxic)], ["term", "toxic"])

    totals = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    pos, neg = float(totals.get(1, 0)), float(totals.get(0, 0))
    if not pos or not neg:
        return np.zeros(0, np.int64)
    counts = texts.mapInArrow(run, "term long, toxic long").groupBy("term").agg(
        F.sum("toxic").cast("double").alias("p"), F.sum(1 - F.col("toxic")).cast("double").alias("q")
    )
    p, q, n = F.col("p"), F.col("q"), pos + neg

    def cell(seen, row, column):
        return F.when(seen > 0, 2 * seen * F.log(seen * n / (row * column))).otherwise(0.0)

    rest, with_term = n - p - q, p + q
    g2 = cell(p, with_term, F.lit(pos)) + cell(q, with_term, F.lit(neg)) + cell(pos - p, rest, F.lit(pos)) + cell(neg - q, rest, F.lit(neg))
    odds = F.abs(F.log((p + 0.5) * (neg - q + 0.5) / ((q + 0.5) * (pos - p + 0.5))))
    best = counts.select("term", g2.alias("g2")).where((F.col("g2") >= LEAST_G2) & (odds >= float(np.log(LEAST_ODDS))))
    return np.sort(np.array([r["term"] for r in best.orderBy(F.desc("g2"), "term").limit(terms).collect()], np.int64))


def frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each vocabulary term occurs; documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in parts(batches, "text"):
            n = np.zeros(len(terms) + 1, np.int64)
            for at, _ in _known(as_bytes(t.column("text")), terms):
                n[at] += 1
            n[-1] = t.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["term", "n"])

    total = np.zeros(len(terms) + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[r["term"]] = r["n"]
    return total[:-1], int(total[-1])


def learn(docs: DataFrame, labels: DataFrame, condition) -> BlockMaxIndex:
    """Index of labelled examples, for ``scored``."""
    texts, stands_for = examples(docs, labels, condition)
    terms = vocabulary(texts)
    counts, n = frequencies(docs, terms)
    rows = texts.toPandas().sort_values("doc_id")  # the bounded sample
    vectors = _known([x.encode() if isinstance(x, str) else b"" for x in rows["text"]], terms)
    index = BlockMaxIndex(terms, np.log((n + 1) / (counts + 0.5)), vectors, rows["doc_id"].to_numpy(), rows["toxic"].to_numpy(), stands_for)
    index.calibrate()
    return index


def scored(docs: DataFrame, index: BlockMaxIndex, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, all by default) with score and
    evidence, which replace columns of those names. Evidence lists doc_id,
    label and cosine of the nearest examples."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "evidence")]
    shared = docs.sparkSession.sparkContext.broadcast(index)
    near_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
    near_ddl = "array<struct<doc_id: bigint, toxic: int, cosine: double>>"
    # the row as one column: its own columns may have any names
    rows = docs.select(F.struct(*keep).alias("doc"), "text")
    schema = rows.select("doc", F.lit(0.0).alias("score"), F.lit(None).cast(near_ddl).alias("evidence")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for t in parts(batches, "text"):
            scores, near = [], []
            for terms, n in _known(as_bytes(t.column("text")), index.vocabulary):
                s, found, cosines = index.score(terms, n)
                scores.append(s)
                near.append(
                    [
                        {"doc_id": int(index.doc_ids[e]), "toxic": int(index.toxic[e]), "cosine": float(c)}
                        for e, c in zip(found[:3], cosines[:3], strict=True)
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [t.column("doc"), pa.array(scores, pa.float64()), pa.array(near, near_type)], ["doc", "score", "evidence"]
            )

    found = rows.mapInArrow(run, schema)
    return found.select(*[F.col("doc").getField(c).alias(c) for c in keep], "score", "evidence")
