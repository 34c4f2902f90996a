"""One-shuffle sweeps and the ranking SVM's elimination with refits."""

import numpy as np
import pyarrow as pa
import pytest

from mooclens.operators import rank, ranksvm
from mooclens.operators.ranksvm import RankSVMBatch


def plain(group, label, key, value, margin, direction):
    sign = 1 if direction == "plus" else -1
    count, total = [], []
    for i in range(len(key)):
        on = (group == group[i]) & (sign * label > sign * label[i]) & (sign * key < sign * key[i] + margin)
        count.append(on.sum())
        total.append(value[on].sum())
    return np.array(count), np.array(total)


@pytest.mark.parametrize("seed", range(8))
def test_dominance(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 300))
    group = np.sort(rng.integers(0, 5, n))
    group = np.unique(group, return_inverse=True)[1]
    label = rng.integers(0, rng.integers(1, 40), n).astype(float)
    key, value = np.round(rng.normal(size=n), 1), rng.normal(size=n)
    level = rank.dense_levels(group, label)
    for g in set(group):
        own = sorted(set(label[group == g]))
        assert [own.index(y) + 1 for y in label[group == g]] == level[group == g].tolist()
    for margin in (0.0, 0.5, 1.0):
        for d in ("plus", "minus"):
            got, expect = rank.dominance(group, level, key, value, margin, d), plain(group, label, key, value, margin, d)
            assert (got[0] == expect[0]).all() and np.allclose(got[1], expect[1], atol=1e-12)


def test_whole_queries_stay_together(monkeypatch):
    monkeypatch.setattr(rank, "SWEEP_ROWS", 7)
    q = [None, None, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 3, 3, 3, 4, 4, 5, 6, 6, 6, 6, 6]
    c = ["x"] * 12 + ["y", "y", "z"] + ["x"] * 8
    batches = [pa.RecordBatch.from_pydict({"q": pa.array(q[i : i + 4], pa.int64()), "c": c[i : i + 4]}) for i in range(0, len(q), 4)]
    found = [(t.to_pydict(), g.tolist()) for t, g in rank._whole_queries(iter(batches), ["q", "c"])]
    assert sum((x["q"] for x, _ in found), []) == q
    seen = set()
    for x, g in found:
        keys = list(zip(x["q"], x["c"]))
        assert not seen & set(keys)
        seen |= set(keys)
        assert [keys[i] == keys[i - 1] for i in range(1, len(keys))] == [g[i] == g[i - 1] for i in range(1, len(g))]


def matrix(spark, seed=3, rows=70, queries=2):
    rng = np.random.default_rng(seed)
    names = [f"f{k}" for k in range(5)]
    data = []
    for i in range(rows):
        y = int(rng.integers(0, 3))
        x = rng.normal(size=5) + np.array([1.0, 0.5, 0.0, -0.2, 0.0]) * y
        data.append((i % queries, i, min(y, 1), *map(float, x)))
    schema = "qid long, row_id long, label int, " + ", ".join(f"{n} double" for n in names)
    df = spark.createDataFrame(data, schema)
    return df.where("row_id % 3 <> 0"), df.where("row_id % 3 = 0"), names


def test_hot_queries_give_the_same(spark, hot):
    train, _, names = matrix(spark)
    batch = RankSVMBatch(train, names)
    assert not batch.small
    w = np.array([0.4, -0.2, 0.1, 0.3, 0.0])
    s = np.array([0.1, 0.5, -0.3, 0.2, 0.9])
    split = batch.values([(0, 2.0, w), (4, 1.0, s)]), batch.curvatures([(0, 2.0, w, s)])
    batch.small = True
    one = batch.values([(0, 2.0, w), (4, 1.0, s)]), batch.curvatures([(0, 2.0, w, s)])
    for c in (0, 4):
        assert split[0][c][0] == pytest.approx(one[0][c][0], rel=1e-10) and np.allclose(split[0][c][1], one[0][c][1], rtol=1e-9)
    assert np.allclose(split[1][0], one[1][0], rtol=1e-9)


def auc(w, valid):
    rows = valid.collect()
    s = {r["row_id"]: sum(v * r[f] for f, v in w.items()) for r in rows}
    pos, neg = ([s[r["row_id"]] for r in rows if r["label"] == y] for y in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def cold(train, own, C=1.0):
    """Newton on all pairs, from zero."""
    rows = train.collect()
    x = np.array([[r[f] for f in own] for r in rows])
    d = np.array([x[i] - x[j] for i, a in enumerate(rows) for j, b in enumerate(rows) if a["qid"] == b["qid"] and a["label"] > b["label"]])
    w = np.zeros(len(own))
    value = lambda w: w @ w / 2 + C * (np.maximum(0, 1 - d @ w) ** 2).sum()
    for _ in range(60):
        short = np.maximum(0, 1 - d @ w)
        g, on = w - 2 * C * d.T @ short, d[short > 0]
        step, length = -np.linalg.solve(np.eye(len(own)) + 2 * C * on.T @ on, g), 1.0
        while value(w + length * step) > value(w) and length > 1e-12:
            length /= 2
        w = w + length * step
    return dict(zip(own, w))


def test_round_equals_cold_fits(spark):
    train, valid, names = matrix(spark)
    fits = [cold(train, [n for n in names if n != f]) for f in names]
    batch = RankSVMBatch(train, names)
    w, hessian, first = ranksvm._full_fit(batch, 1.0, 1e-8)
    assert np.allclose(w, list(cold(train, names).values()), atol=1e-6)
    warm = ranksvm.refit_without(batch, 1.0, w, hessian, [0, 1, 2, 3, 4], np.ones(5), first, 1e-8)
    for k in range(5):
        assert np.allclose(warm[k], [fits[k].get(n, 0.0) for n in names], atol=1e-6) and warm[k][k] == 0
    got = {r["dropped"]: r["auc"] for r in ranksvm.removal_round(train, valid, names, 1.0, eps=1e-8).collect()}
    assert got == pytest.approx({f: auc(w, valid) for f, w in zip(names, fits)}, abs=1e-12)


def cold_loop(train, valid, names, rule):
    """The loop with every fit from zero."""
    kept, history = list(names), []
    previous = auc(cold(train, kept), valid)
    best = (previous, list(kept))
    while len(kept) > 1:
        found = [auc(cold(train, [n for n in kept if n != f]), valid) for f in kept]
        k = found.index(max(found))
        history.append((len(history) + 1, kept[k], found[k]))
        gained = found[k] > previous
        if rule == "until_no_gain" and not gained:
            break
        kept = kept[:k] + kept[k + 1 :]
        previous = found[k]
        if previous > best[0]:
            best = (previous, list(kept))
        if rule == "keep_last" and not gained:
            break
    return (best[1] if rule == "exhaust_keep_best" else kept), history


@pytest.mark.parametrize("rule", ["until_no_gain", "keep_last", "exhaust_keep_best"])
def test_whole_loop_equals_cold_fits(spark, rule):
    train, valid, names = matrix(spark, seed=5, queries=1)
    kept, history, w = ranksvm.backward_elimination(train, valid, names, 1.0, rule, eps=1e-6)
    expect = cold_loop(train, valid, names, rule)
    assert kept == expect[0] == list(w)
    assert [h[:2] for h in history] == [h[:2] for h in expect[1]]
    assert [h[2] for h in history] == pytest.approx([h[2] for h in expect[1]], abs=1e-12)


def test_giving_up_keeps_the_best(spark):
    train, valid, names = matrix(spark, seed=8)
    batch = RankSVMBatch(train, names)
    w, hessian, first = ranksvm._full_fit(batch, 1.0, 1e-9)
    all_fits = ranksvm.refit_without(batch, 1.0, w, np.eye(5) * 50, list(range(5)), np.ones(5), first, 1e-9)
    some = ranksvm.refit_without(batch, 1.0, w, np.eye(5) * 50, list(range(5)), np.ones(5), first, 1e-9, valid)
    score = lambda x: auc(dict(zip(names, x)), valid)
    best = max(range(5), key=lambda k: score(all_fits[k]))
    assert best in some and set(some) <= set(all_fits)


def test_blocks_of_whole_queries_give_the_same_without_a_shuffle(spark, monkeypatch):
    train, _, names = matrix(spark, queries=10)
    train = train.selectExpr("nullif(qid, 3) AS qid", "row_id", "label", *names).coalesce(1)
    batch = RankSVMBatch(train, names)
    blocks = [r["q"] for r in batch.base.select("q").collect()]
    assert batch.whole and sum(map(len, blocks)) == train.count()
    held = [q for b in blocks for q in set(b)]
    assert len(held) == len(set(held)) == 10  # each query in one block
    w, s = np.array([0.4, -0.2, 0.1, 0.3, 0.0]), np.array([0.1, 0.5, -0.3, 0.2, 0.9])
    with monkeypatch.context() as m:
        m.setattr(batch, "_sweeps", None)
        m.setattr(batch, "_xt", None)
        one = batch.values([(0, 2.0, w), (4, 1.0, s)]), batch.curvatures([(0, 2.0, w, s)])
    batch.whole = False
    other = batch.values([(0, 2.0, w), (4, 1.0, s)]), batch.curvatures([(0, 2.0, w, s)])
    for c in (0, 4):
        assert one[0][c][0] == pytest.approx(other[0][c][0], rel=1e-10) and np.allclose(one[0][c][1], other[0][c][1], rtol=1e-9)
    assert np.allclose(one[1][0], other[1][0], rtol=1e-9)


def test_great_queries_are_swept_in_packs(spark, monkeypatch):
    """Queries over several blocks, some of them in one group: the same as
    in whole blocks, and no row is shuffled by itself."""
    train, _, names = matrix(spark, rows=300, queries=4)
    train = train.selectExpr("nullif(qid, 3) AS qid", "row_id", "label", *names).repartition(3)
    w, s = np.array([0.4, -0.2, 0.1, 0.3, 0.0]), np.array([0.1, 0.5, -0.3, 0.2, 0.9])
    asked = lambda b: (b.values([(0, 2.0, w), (4, 1.0, s)]), b.curvatures([(0, 2.0, w, s)]))
    one = asked(RankSVMBatch(train, names))
    monkeypatch.setattr(ranksvm, "WHOLE_ROWS", 5)
    batch = RankSVMBatch(train, names)
    assert batch.small and not batch.whole and batch.base.count() == 3  # each with rows of each query
    for name in ("_narrow", "_sweeps", "_xt"):
        monkeypatch.setattr(batch, name, None)
    for groups in (1, 3):
        batch.groups = groups
        packs = asked(batch)
        for c in (0, 4):
            assert packs[0][c][0] == pytest.approx(one[0][c][0], rel=1e-10) and np.allclose(packs[0][c][1], one[0][c][1], rtol=1e-9)
        assert np.allclose(packs[1][0], one[1][0], rtol=1e-9)


def test_a_block_holds_whole_queries(monkeypatch):
    monkeypatch.setattr(ranksvm, "BLOCK_ROWS", 4)
    monkeypatch.setattr(ranksvm.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 2})()))
    q = [None, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3, 4, 5]
    rows = pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int64()), "level": pa.array(range(len(q)), pa.int32()), "x": pa.array([[float(i)] for i in range(len(q))])})
    found = [b.to_pylist()[0] for b in ranksvm._whole_blocks(iter([rows.slice(0, 7), rows.slice(7)]))]
    assert [b["q"] for b in found] == [[None, 1, 1, 2, 2, 2], [3] * 6, [4, 5]]
    assert [b["block"] for b in found] == [2 << 32, 2 << 32 | 1, 2 << 32 | 2]
    assert [np.frombuffer(b["x"]).tolist() for b in found] == [[float(i) for i in b["level"]] for b in found]
