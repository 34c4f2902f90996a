import collections
import math
import zlib

from mooclens.llm import katz
from mooclens.llm.common import fold
from pyspark.sql import functions as F

from .brute import words

K = katz.CUTOFF


def plain(rows):
    """Scores by the recursion on dictionaries, and a check that every
    context's probabilities sum to 1 over the words and the unseen class."""
    texts = [(d, words(t) + [None]) for d, t in rows]
    train = [t for d, t in texts if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    one, two, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for t in train:
        v = None
        for w in t:
            one[w] += 1
            two[v, w] += 1
            after[v].add(w)
            v = w
    n = sum(one.values())

    def rule(counts):
        m = collections.Counter(counts.values())
        try:
            a = (K + 1) * m[K + 1] / m[1]
            d = {r: r * ((r + 1) * m[r + 1] / (r * m[r]) - a) / (1 - a) for r in range(1, K + 1)}
            good = all(m[r] for r in range(1, K + 2)) and a < 1 and all(0 < d[r] < r for r in d)
        except ZeroDivisionError:
            good = False
        return lambda c: d[c] if good and c <= K else c - 0.5

    d1, d2 = rule(one), rule(two)
    p1 = {w: d1(c) / n for w, c in one.items()}
    unseen = 1 - sum(p1.values())
    alpha = {v: (1 - sum(d2(two[v, w]) / one[v] for w in after[v])) / (1 - sum(p1[w] for w in after[v])) for v in after}
    for v in list(after)[:40]:
        rest = unseen + sum(p for w, p in p1.items() if w not in after[v])
        assert abs(sum(d2(two[v, w]) / one[v] for w in after[v]) + alpha[v] * rest - 1) < 1e-9
    out = []
    for d, t in texts:
        v, score = None, 0.0
        for w in t:
            c = two.get((v, w), 0)
            score += math.log10(d2(c) / one[v] if c else alpha.get(v, 1.0) * p1.get(w, unseen))
            v = w
        base = sum(math.log10((one.get(w, 0) + 0.5) / (n + 0.5 * (len(one) + 1))) for w in t)
        out.append((str(d), len(t), sum(w in one for w in t), n, round(base, 4), round(score, 4)))
    return sorted(out)


def test_against_plain_python(awkward, monkeypatch):
    got = katz.scores(awkward, fold("doc_id", 5) != 1).collect()
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    keep = ("n_tokens", "n_known", "train_tokens")
    assert sorted((str(r["doc_id"]), *(r[k] for k in keep), round(r["base_score"], 4), round(r["score"], 4)) for r in got) == plain(rows)


def test_beats_word_frequencies_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = katz.scores(docs, fold("doc_id", 5) != 1).where(~F.col("train")).agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > held[0]


def test_nothing_to_learn(spark, nothing, awkward):
    assert katz.scores(nothing, F.lit(True)).count() == 0
    r = katz.scores(awkward.where("doc_id = 3"), F.lit(False)).first()
    assert r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0
