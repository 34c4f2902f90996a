"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next stage's docs. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mooclens.llm import hyperminhash, line_dedup, mixing, packing, toxicity
from mooclens.llm.common import fold, read_table, stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from the
    labelled documents outside the held-out fold."""
    learn = F.coalesce(fold("doc_id", 5) != 0, F.lit(False))
    index = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), learn)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")  # its columns may be called score too
    found = toxicity.scored(rows, index, keep=["doc"])
    return found.where("score < 0.5").select("doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has. A document
    all of whose text goes that way is dropped; those that were empty stay."""
    found = line_dedup.dedup_lines(docs)
    emptied = (F.size("removed_lines") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    kept = found.where(~emptied)
    if "n_chars" in docs.columns:
        changed = F.when(F.size("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least
    doc_id. Of rows that agree in doc_id and text one stays."""
    found = hyperminhash.near_duplicates(docs, width=5)
    fate = found.groupBy("row").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    # narrow tables of rows to drop and of rows that are there repeatedly
    fate = stored(fate.where("not kept or rows > 1"), "near-fate")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("doc_id", "text").alias("row"))
    single = rows.join(fate, "row", "left_anti")
    repeated = rows.join(fate.where("kept"), "row", "left_semi").groupBy("row").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return single.select("doc.*").unionByName(repeated.select("doc.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(packing.pieces(docs, TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn, sketch and tokenise: SQL cannot express them. The tests
#: hold each one against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
