"""Registered queries opN_<name>: each applies an operator, with production
parameters, to its whole table and derives the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mooclens.llm import conversations, cover_tree, divergence, fingerprint, hyperminhash, katz, line_dedup, mixing, packing, ppm, repeats, sql, template_extract, toxicity
from mooclens.llm.common import ORACLE, QUERIES, fold, query, read_table  # noqa: F401


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op3_fingerprint")
def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(read_table(spark, sf_dir, "documents"))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=2)


@query("op10_line_dedup")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "removed_lines")


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    trees = ppm.learn(ppm.sample(docs, ~held_out))
    return ppm.identify(docs, trees).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    found = toxicity.scored(docs, toxicity.learn(docs, labels, ~held_out), keep=["doc_id"])
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


@query("op2_cover_tree")
def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op4_katz")
def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 5) == 1, F.lit(False))
    found = katz.scores(read_table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op6_html")
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template_extract.extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op13_repeats", sql.REPEATS)
def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_divergence", sql.DIVERGENCE)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


@query("op12_conversations", sql.CONVERSATIONS)
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(read_table(spark, sf_dir, "conversations"))
