import random

import numpy as np
import pytest
from mooclens.llm import hyperminhash, line_dedup, near
from mooclens.llm.components import components

from .brute import Union, near_components, removed_lines, shingles
from .conftest import prose


@pytest.mark.parametrize("width", [2, 5])
def test_components_against_all_pairs(awkward, width):
    got = hyperminhash.near_duplicates(awkward, width=width).collect()
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    known = [r for r in rows if r[0] is not None]
    expect = near_components(known, width)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == expect[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = sorted(len(shingles(t, width)) for _, t in rows)
    assert sorted(r["n_shingles"] for r in got) == sizes


def chained(rng, n):
    """Texts each near the one before; the ends are far apart."""
    w = prose(rng, 60).split(" ")
    out = []
    for i in range(n):
        w = list(w)
        w[(7 * i) % 60] = f"link{i}"
        out.append(" ".join(w))
    return out


def test_chains_and_hot_groups(spark, monkeypatch):
    """Large groups without a common centre, and blocks of a hot bucket."""
    monkeypatch.setattr(near, "BLOCK", 7)
    rng = random.Random(11)
    texts = chained(rng, 60)
    base = prose(rng, 80).split(" ")
    for i in range(80):
        w = list(base)
        for k in rng.sample(range(80), 3):
            w[k] = f"edit{i}x{k}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == near_components(sorted(rows), 2)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    bins = hyperminhash.BINS
    for share in (0.3, 0.8):
        errors = []
        for _ in range(60):
            both, one, two = (rng.integers(0, 2**64, int(n), dtype=np.uint64) for n in (2000 * share, 1000 * (1 - share), 1000 * (1 - share)))
            a, b = np.unique(np.concatenate([both, one])), np.unique(np.concatenate([both, two]))
            ra, rb = (hyperminhash.registers(*hyperminhash.bin_minima(s, bins)) for s in (a, b))
            c = hyperminhash.chance([len(a)], [len(b)])[0]
            errors.append(((ra == rb).mean() - c) / (1 - c) - len(both) / (len(both) + len(one) + len(two)))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04


def test_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    union = Union(range(600))
    for a, b in links:
        union.tie(a, b)
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: union.find(x) for a, b in links if a != b for x in (a, b)}


def test_lines_against_all_pairs(awkward):
    out = line_dedup.dedup_lines(awkward)
    assert out.columns == [*awkward.columns, "n_lines", "removed_lines"]
    rows = {(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect() if r["doc_id"] is not None}
    once = [r for r in rows if sum(d == r[0] for d, _ in rows) == 1]  # ids with one text
    alone = awkward.where("doc_id is not null and doc_id <> 209")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(alone).collect()}
    for d, gone in removed_lines(sorted(once, key=lambda r: r[0])).items():
        text = dict(once)[d]
        assert got[d]["removed_lines"] == gone
        lines = (text or "").split("\n")
        assert got[d]["text"] == (None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
        assert got[d]["n_lines"] == (0 if text is None else len(lines))
    assert out.count() == awkward.count()


def test_fuzzy_lines_and_repeats(spark):
    rng = random.Random(6)
    long = prose(rng, 50)
    near_ = long.replace(long.split(" ")[20], "x", 1)
    rows = [(1, f"{long}\nshort"), (2, f"own line of the second text, long enough to count\n{near_}\nshort"), (3, near_.upper())]
    rows += [(i, f"{long}\n{prose(rng, 12)}") for i in range(10, 60)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expect = removed_lines(rows)
    assert {d: r["removed_lines"] for d, r in got.items()} == expect
    assert got[2]["removed_lines"] == [1, 2] and got[3]["text"] == "" and all(expect[i] == [0] for i in range(10, 60))


def test_empty_tables(nothing):
    assert hyperminhash.near_duplicates(nothing).count() == 0
    assert line_dedup.dedup_lines(nothing).count() == 0


@pytest.mark.parametrize("size", [30, 60, 100])
def test_one_changed_character_or_word(spark, size):
    """Copies of short lines with one edit, against all pairs at the width in use."""
    rng = random.Random(size)
    rows, chars, words = [], [], []
    for i in range(60):
        line = prose(rng, size)[: size - 4] + " end"
        k = size // 2
        one = line[:k] + "#" + line[k + 1 :]
        w = line.split(" ")
        w[len(w) // 2] = "q" * len(w[len(w) // 2])
        rows += [(3 * i, line), (3 * i + 1, one), (3 * i + 2, " ".join(w))]
        chars.append(3 * i + 1)
        words.append((3 * i + 2, len(w[len(w) // 2])))
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == removed_lines(rows, width=line_dedup.WIDTH)
    if size >= 60:
        assert all(got[d] == [0] for d in chars)
    if size >= 100:
        assert all(got[d] == [0] for d, n in words if n <= 6)


def test_short_lines(spark):
    """Equal short lines go, whatever their length; blank ones stay."""
    rows = [(1, "Subscribe to our list now\n\nyes"), (2, "one\n  subscribe to our LIST now\n\n"), (3, "Yes \ntwo\n \nyet"), (4, "\n")]
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == removed_lines(rows) == {1: [], 2: [1], 3: [0], 4: []}


def test_signature_counts_distinct_windows():
    rng = random.Random(8)
    lines = [b"ab", b"abababababab", b"x" * 5000, prose(rng, 40).encode(), prose(rng, 3000).encode()]
    sizes, regs = line_dedup.signatures(lines)
    assert sizes.tolist() == [len(s) for s in line_dedup.shingle_sets(lines)] and regs.shape == (5, line_dedup.BINS)


def test_isolated_items_of_a_hot_group(spark, monkeypatch):
    """Texts that share buckets with very many others but are linked with
    few or none: every link is found, and only few pairs leave the buckets."""
    rnd = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(160):
        words = list(base)
        for at in rnd.choice(150, int(rnd.integers(1, 16)), replace=False):
            words[at] = f"x{d}_{at}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written = []
    plain = near.stored
    monkeypatch.setattr(near, "stored", lambda df, name, *a: written.append((name, out := plain(df, name, *a))) or out)
    monkeypatch.setattr(near, "ELEMENTS", 9000)
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(docs, width=2).collect()}
    assert got == near_components(rows, 2)
    assert len(set(got.values())) > 1
    most = max(df.count() for name, df in written if name in ("near-likely", "near-links"))
    assert most < 10 * len(rows)
