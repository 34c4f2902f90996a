import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from mooclens.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_places(rows, size):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


@pytest.mark.parametrize("size", [4096, 50])
def test_pieces_and_places(awkward, size):
    tok = Tokenizer.from_file(PATH)
    rows = packing.pack(packing.pieces(awkward, PATH, size), size).collect()
    expect = Counter()
    for d, t in awkward.select("doc_id", "text").collect():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            expect[str(d), n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expect
    used = check_places(rows, size)
    assert used <= -(-sum(r["length"] for r in rows) // size) * 1.03 + 1


def test_empty_table(nothing):
    assert packing.pack(packing.pieces(nothing, PATH)).count() == 0


def test_words_alone_give_the_text(spark):
    tok, own = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["<|endoftext|> x<|startoftext|>y", "don't I'LL ΑΣ Σ it's here 　 é ́", "1234 ١٢ ½ 😀😀"]
    flat, bounds = own.encode([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=0, max_size=200))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65).astype(np.int64)
    used = np.zeros(65, np.int64)
    for items, times in packing.plan(counts.copy()):
        assert sum(items) <= 64
        for x in items:
            used[x] += times
    assert (used == counts).all()


def test_exact_complements_come_first():
    counts = np.zeros(101, np.int64)
    counts[[60, 40, 30, 10, 25]] = [3, 1, 2, 2, 4]
    runs = packing.plan(counts)
    assert sum(times for _, times in runs) == -(-int(counts @ np.arange(101)) // 100)
    assert ((60, 40), 1) in runs or any(sorted(i) == [40, 60] for i, _ in runs)


def test_ranks_of_a_hot_key(spark):
    """One length has nearly all rows: they are dealt by (length, bucket)."""
    rows = spark.range(1000).selectExpr("id as doc_id", "0L as piece", "if(id < 900, 7L, id % 3) as length")
    out = packing.ranked(rows, "length", ["doc_id", "piece"], bucket_rows=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("row_number()") :]
    assert "hashpartitioning(length" in window and "_bucket" in window[window.index("hashpartitioning(length") :].split(")")[0]
    for _, own in out.toPandas().groupby("length"):
        assert sorted(own["rank"]) == list(range(len(own)))


def test_words_go_to_the_tokenizer_in_lines(monkeypatch):
    words = "naïve café été ̈abc don't it's 12ab,cd z z z\u0085 ΑΣ İstanbul ß ﬁ 日本語 한국어 a\x00b \x1c </w> a</w>b …".split(" ") * 40
    tok, told = packing.WordTokenizer(PATH), []

    class Told:
        def encode_batch(self, texts, **kw):
            told.append(len(texts))
            return whole.encode_batch(texts, **kw)

    whole, tok.tok = tok.tok, Told()
    alone = [whole.encode(w, add_special_tokens=False).ids for w in words]
    tok._learn(np.arange(len(words), dtype=np.uint64), [w.encode() for w in words])
    assert [tok.flat[a : a + n].tolist() for a, n in zip(tok.at, tok.size)] == alone
    assert sum(told) == -(-len(words) // packing.LINE_WORDS)
