"""The stages against plain Python versions, and on awkward rows."""

import collections

import corpus_pipeline
import pytest
from mooclens.llm.common import fold
from mooclens.llm import toxicity

from .brute import near_components, removed_lines
from .test_packing import check_places

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{top}/{name}")
        out.append((docs, spark.read.parquet(f"{top}/{name}")))
        docs = out[-1][1]
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out, strict=True))


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_columns_stay(spark, steps):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(out.columns == columns for name, (_, out) in steps.items() if name != "packing")


def test_toxic_documents_go(spark, steps):
    docs, out = steps["toxicity"]
    index = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), fold("doc_id", 5) != 0)
    bad = {r["doc_id"] for r in toxicity.scored(docs, index, keep=["doc_id"]).where("score >= 0.5").collect()}
    assert pairs(out) == [p for p in pairs(docs) if p[0] not in bad]


def test_lines_stay_once(steps):
    docs, out = steps["line_dedup"]
    rows = pairs(docs)
    expect = []
    for (d, t), (_, gone) in zip(rows, sorted(removed_lines(rows).items()), strict=True):
        rest = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or rest.strip():
            expect.append((d, rest))
    assert pairs(out) == expect


def test_one_of_each_group_stays(steps):
    docs, out = steps["near_dedup"]
    rows = pairs(docs)
    component = near_components(rows, 5)
    assert pairs(out) == [(d, t) for d, t in rows if component[d] == d]


def test_mix_takes_and_packing_places(steps):
    docs, out = steps["mixing"]
    taken = collections.Counter(pairs(out))
    assert set(taken) <= set(pairs(docs)) and max(taken.values()) <= 2
    docs, out = steps["packing"]
    rows = out.collect()
    assert check_places(rows, 4096) >= 1
    assert sum(r["piece"] == 0 for r in rows) == docs.count()


def test_awkward_rows_pass_all_stages(spark, awkward, nothing):
    for docs in (awkward, nothing):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "packing":
                assert docs.columns == columns
                docs = docs.checkpoint()
        assert docs.count() >= 0
