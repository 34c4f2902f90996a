import numpy as np
import pandas as pd
from mooclens.llm import mixing

from .brute import words


def plain_targets(sizes, weights=(3, 1, 2), share=1.5):
    """Water filling, one source at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > 2 * sizes[s]]
        if not over:
            return capped | {s: left * w[s] / total for s in free}
        for s in over:
            capped[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)


def test_targets_stop_at_twice_the_size():
    sizes = {"a": 10, "b": 1000, None: 300, "c": 0}
    got = mixing.targets(pd.DataFrame({"source": list(sizes), "source_size": list(sizes.values()), "documents": 1}))
    expect = plain_targets(sizes)
    assert {s: round(t, 6) for s, t in zip(got["source"], got["target"], strict=True)} == {s: round(t, 6) for s, t in expect.items()}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 900, 500).astype(float), np.full(500, 0.37)
    out = mixing.flight(size, p, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-3


def test_flight_is_unbiased():
    size, p = np.array([1.0, 5, 2, 9, 4, 7, 3, 8]), np.full(8, 0.5)
    mean = np.mean([mixing.flight(size, p, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert abs(mean - p).max() < 0.05


def test_mix_meets_targets(awkward):
    rows = mixing.mix(awkward, block_rows=10).collect()
    again = mixing.mix(awkward.repartition(3), block_rows=10).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["copies"], str(r["source"]))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    texts = awkward.select("doc_id", "text", "source").collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(t["doc_id"]), len(words(t["text"]))) for t in texts)
    sizes = {}
    for t in texts:
        sizes[t["source"]] = sizes.get(t["source"], 0) + len(words(t["text"]))
    expect = plain_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - expect[s]) < 1e-6 and r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - expect[s]) <= max(r["size"] for r in own)


def test_repeated_gives_the_copies(awkward):
    plan = {}
    for r in mixing.mix(awkward).collect():
        k = (r["doc_id"], r["source"], r["size"])
        plan[k] = plan.get(k, 0) + r["copies"]
    out = mixing.repeated(awkward)
    assert out.columns == awkward.columns
    got = {}
    for r in out.collect():
        k = (r["doc_id"], r["source"], len(words(r["text"])))
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in plan.items() if n}


def test_empty_table(nothing):
    assert mixing.mix(nothing).count() == 0
    assert mixing.repeated(nothing).count() == 0
