"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree (contexts of up to
three bytes) is learned once and frozen. A byte's code length is that of
the longest context that has seen it; every shorter step costs the escape
code of the context left (method C: a context seen N times with D different
successors escapes with probability D / (N + D)). The language whose tree
codes the whole text in the fewest bits is predicted; the score is its
posterior under equal priors, 2**-bits normalised over the languages.

As the statistics are frozen, the code length of every (context, byte) seen
in any language is worked out once; scoring a text is one table look-up a
byte. Bytes are mapped to 64 symbols: the 63 commonest of the training
texts (A-Z lowered, white space as space, digits as 0) and the rest.

Learning takes a bounded, documented sample: at most ``DOCS`` whole texts
for each language, least hashes of the id first. The trees are bounded by
64**4 contexts and are sent to the executors as one broadcast.

Edge cases: null texts and those without a letter give ``und`` and score 0;
so does every text if nothing can be learned; languages in null are not
learned; equal code lengths go to the first language by name; an empty
table gives no rows; rows without id are scored, not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.llm.common import least_hashes, stored
from mooclens.llm.textnum import LOWER, SPACES, as_bytes, chunks, parts

DOCS = 2000
SYMBOLS = 64
ORDER = 3
GAP = b" " * ORDER

_FOLD = LOWER.copy()
_FOLD[SPACES] = 0x20
_FOLD[ord("0") : ord("9") + 1] = ord("0")


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with a gap before each text, and the texts' starts."""
    buf = _FOLD[np.frombuffer(GAP + GAP.join(texts), np.uint8)] if texts else np.zeros(0, np.uint8)
    sizes = np.fromiter((len(t) + ORDER for t in texts), np.int64, len(texts))
    return buf, np.cumsum(sizes) - sizes + ORDER


def _grams(buf: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Code of each byte after its three predecessors; 0 for the first."""
    s = symbol[buf].astype(np.int32)
    code = s.copy()
    for k in range(1, ORDER + 1):
        code[k:] += s[:-k] << (6 * k)
    return code


def sample(docs: DataFrame, learn, docs_per_lang: int = DOCS) -> DataFrame:
    """(lang, text) of the rows to learn from. ``learn``: a condition."""
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = least_hashes(usable.select("doc_id", "lang"), "lang", ["doc_id"], docs_per_lang)
    # a stored table of known size: Spark broadcasts it if that is small
    ids = stored(ids.select("doc_id", "lang").distinct(), "ppm-sample")
    return usable.select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"]).select("lang", "text")


class Trees:
    """Frozen code lengths (bits) of all languages."""

    def __init__(self, symbol: np.ndarray, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.symbol = symbol
        self.langs = sorted(counts)
        self.known = np.unique(np.concatenate([g for g, _ in counts.values()])) if counts else np.zeros(0, np.int64)
        self.bits = np.zeros((len(self.known), len(self.langs)), np.float32)
        self.short = np.zeros((SYMBOLS**ORDER, len(self.langs)), np.float32)  # by the last two bytes and this one
        self.leave = np.zeros((SYMBOLS**ORDER, len(self.langs)), np.float32)  # by the three bytes before
        for j, lang in enumerate(self.langs):
            grams, times = counts[lang]
            bits = np.full(SYMBOLS, np.log2(SYMBOLS))
            for k in range(ORDER):  # contexts of k bytes
                seen = np.bincount(grams % SYMBOLS ** (k + 1), times, SYMBOLS ** (k + 1)).reshape(-1, SYMBOLS)
                bits = self._coded(seen, bits)
            self.short[:, j] = bits
            total = np.bincount(grams // SYMBOLS, times, SYMBOLS**ORDER)
            kinds = np.bincount(grams // SYMBOLS, minlength=SYMBOLS**ORDER)
            used = total > 0
            self.leave[used, j] = -np.log2(kinds[used] / (total + kinds)[used])
            at = np.searchsorted(self.known, grams)
            self.bits[:, j] = self.leave[self.known // SYMBOLS, j] + self.short[self.known % SYMBOLS**ORDER, j]
            self.bits[at, j] = -np.log2(times / (total + kinds)[grams // SYMBOLS])
        self.place = None

    @staticmethod
    def _coded(seen: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Code lengths for contexts (rows) from counts and from the code
        lengths of the contexts one byte shorter."""
        total, kinds = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = -np.log2(seen / (total + kinds))
        # row r of the longer contexts ends with row r % len(shorter rows)
        back = np.tile(shorter.reshape(-1, SYMBOLS), (len(seen) // (shorter.size // SYMBOLS), 1))
        return np.where(seen > 0, own, leave + back).reshape(-1)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) under each language."""
        if self.place is None:
            self.place = np.full(SYMBOLS ** (ORDER + 1), -1, np.int32)
            self.place[self.known] = np.arange(len(self.known), dtype=np.int32)
        out = np.zeros((len(texts), len(self.langs)))
        for a, b in chunks(texts, 1 << 19):
            buf, begin = _buffer(texts[a:b])
            code = _grams(buf, self.symbol)
            at = self.place[code]
            bits = self.bits[at]
            new = np.flatnonzero(at < 0)
            bits[new] = self.leave[code[new] >> 6] + self.short[code[new] & (SYMBOLS**ORDER - 1)]
            sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(bits, axis=0, dtype=np.float64)])
            ends = begin + [len(t) for t in texts[a:b]]
            out[a:b] = sums[ends] - sums[begin]
        return out


def learn(texts: DataFrame) -> Trees:
    """Trees of the languages of (lang, text)."""

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in parts(batches, "text"):
            n = np.bincount(_buffer(as_bytes(t.column("text")))[0], minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n)], ["byte", "n"])

    texts = stored(texts, "ppm-texts")
    common = texts.mapInArrow(symbols, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "byte")
    symbol = np.zeros(256, np.int64)
    for k, r in enumerate(common.where("n > 0").limit(SYMBOLS - 1).collect()):
        symbol[r["byte"]] = k + 1

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in parts(batches, "text"):
            langs = np.array(t.column("lang").to_pylist())
            texts = as_bytes(t.column("text"))
            for lang in np.unique(langs):
                own = [x for x, k in zip(texts, langs == lang, strict=True) if k]
                for a, b in chunks(own):
                    buf, begin = _buffer(own[a:b])
                    inside = np.ones(len(buf), bool)
                    for k in range(1, ORDER + 1):
                        inside[begin - k] = False
                    code, n = np.unique(_grams(buf, symbol)[inside], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(lang)] * len(code)), pa.array(code.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                    )

    counted = texts.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # contexts of the bounded sample
    return Trees(symbol, {k: (g["gram"].to_numpy(), g["n"].to_numpy()) for k, g in table.groupby("lang")})


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        names = np.array([*trees.langs, "und"], object)
        for t in parts(batches, "text"):
            lettered = t.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            n = len(lettered)
            best, score = np.full(n, len(names) - 1), np.zeros(n)
            if len(names) > 1 and n:
                bits = trees.lengths(as_bytes(t.column("text")))
                low = bits.argmin(axis=1)
                share = 1 / np.exp2(np.minimum(0, bits.min(axis=1)[:, None] - bits)).sum(axis=1)
                best, score = np.where(lettered, low, best), np.where(lettered, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [t.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lettered)
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
