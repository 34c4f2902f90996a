"""Registered ranking and sparse-row queries over the lineitem-derived
ranking fixture (orders are queries, label = floor(quantity / 10))."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from mooclens.operators import metrics, rank, sparse
from mooclens.plans.oracle import rounded, with_ctes
from mooclens.plans.registry import query
from mooclens.session import ensure_checkpoint_dir
from mooclens.sources import fixtures as fx

RK = ["qid", "row_id"]


def ranking(spark, sf, one_query: bool = False):
    r = fx.ranking(spark, sf)
    return r.withColumn("qid", F.lit(0).cast("bigint")) if one_query else r


# ---------------------------------------------------------------- N1, N2

@query("n1_query_sizes", with_ctes("SELECT qid, count(*) AS n FROM ranking GROUP BY qid"))
def n1_query_sizes(spark, sf):
    return rank.query_sizes(fx.ranking(spark, sf))


@query("n2_label_levels", with_ctes(
    "SELECT qid, row_id, label, CAST(dense_rank() OVER (PARTITION BY qid ORDER BY label) AS INTEGER) AS level "
    "FROM ranking"))
def n2_label_levels(spark, sf):
    return rank.label_levels(fx.ranking(spark, sf)).select("qid", "row_id", "label", "level")


# ---------------------------------------------------------------- N3, N4, L3 (self-join oracles)

LEVEL_CTE = {"lv": """
  SELECT qid, row_id, label, score / 10000.0 AS z,
         dense_rank() OVER (PARTITION BY qid ORDER BY label) AS level FROM ranking"""}


@query("n3_margin_violations", with_ctes(rounded("""
SELECT a.qid, a.row_id,
       count(*) FILTER (WHERE b.level > a.level AND b.z < a.z + 1) AS l_plus,
       coalesce(sum(b.z) FILTER (WHERE b.level > a.level AND b.z < a.z + 1), 0) AS gamma_plus,
       count(*) FILTER (WHERE b.level < a.level AND b.z > a.z - 1) AS l_minus,
       coalesce(sum(b.z) FILTER (WHERE b.level < a.level AND b.z > a.z - 1), 0) AS gamma_minus
FROM lv a JOIN lv b ON a.qid = b.qid GROUP BY a.qid, a.row_id""",
    RK + ["l_plus", "l_minus"], ["gamma_plus", "gamma_minus"]), LEVEL_CTE))
def n3_margin_violations(spark, sf):
    """N3 with z = price / 10000 and margin 1."""
    r = fx.ranking(spark, sf).withColumn("z", F.col("score") / 10000.0)
    lv = rank.label_levels(r)
    out = rank.margin_violations(lv, "z")
    return out.select(*RK, "l_plus", "gamma_plus", "l_minus", "gamma_minus")


@query("n4_pair_counts", with_ctes("""
SELECT a.qid, count(*) FILTER (WHERE b.label > a.label) AS n_pairs,
       count(*) FILTER (WHERE b.label > a.label AND b.score < a.score) AS n_discordant
FROM ranking a JOIN ranking b ON a.qid = b.qid GROUP BY a.qid"""))
def n4_pair_counts(spark, sf):
    return rank.pair_counts(fx.ranking(spark, sf))


L3_SQL = """
SELECT 1.0 - sum(nd) / sum(np) AS pairwise_accuracy, avg(1.0 - nd / np) AS mean_query_accuracy,
       CAST(sum(np) AS BIGINT) AS n_pairs, CAST(sum(nd) AS BIGINT) AS n_discordant FROM (
  SELECT a.qid, count(*) FILTER (WHERE b.label > a.label) AS np,
         count(*) FILTER (WHERE b.label > a.label AND b.score < a.score) AS nd
  FROM ranking a JOIN ranking b ON a.qid = b.qid GROUP BY a.qid) t WHERE np > 0"""


@query("l3_pairwise_accuracy", with_ctes(rounded(L3_SQL, ["n_pairs", "n_discordant"],
                                                  ["pairwise_accuracy", "mean_query_accuracy"])))
def l3_pairwise_accuracy(spark, sf):
    return rank.pairwise_accuracy(fx.ranking(spark, sf))


def _one_query_sql() -> str:
    # per-level counts of strictly lower scores, by windows (no pairs)
    levels = range(0, 6)
    below = ", ".join(
        f"count(*) FILTER (WHERE label = {L}) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        f" - count(*) FILTER (WHERE label = {L}) OVER (PARTITION BY score) AS b{L}" for L in levels
    )
    disc = " + ".join(f"CASE WHEN {L} > label THEN b{L} ELSE 0 END" for L in levels)
    return f"""
SELECT 1.0 - nd / np AS pairwise_accuracy, 1.0 - nd / np AS mean_query_accuracy, np AS n_pairs, nd AS n_discordant
FROM (SELECT CAST(sum({disc}) AS BIGINT) AS nd FROM (SELECT label, {below} FROM ranking) x) d,
     (SELECT CAST((sum(c) * sum(c) - sum(c * c)) / 2 AS BIGINT) AS np FROM
        (SELECT label, count(*) AS c FROM ranking GROUP BY label) y) p"""


@query("l3_pairwise_accuracy_one_query", with_ctes(rounded(_one_query_sql(), ["n_pairs", "n_discordant"],
                                                            ["pairwise_accuracy", "mean_query_accuracy"])))
def l3_pairwise_accuracy_one_query(spark, sf):
    """L3 with every row in one query (the blending case: qid 0)."""
    return rank.pairwise_accuracy(ranking(spark, sf, one_query=True))


# ---------------------------------------------------------------- L4 NDCG

NDCG_CTE = {
    "dcg_pos": """
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS pos, label FROM ranking""",
    "idcg_pos": """
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY label DESC, row_id) AS pos, label FROM ranking""",
    "dcg": """
  SELECT qid, pos, sum((pow(2.0, label) - 1) * CASE WHEN pos <= 2 THEN 1.0 ELSE ln(2.0) / ln(pos) END)
         OVER (PARTITION BY qid ORDER BY pos) AS g FROM dcg_pos""",
    "idcg": """
  SELECT qid, pos, sum((pow(2.0, label) - 1) * CASE WHEN pos <= 2 THEN 1.0 ELSE ln(2.0) / ln(pos) END)
         OVER (PARTITION BY qid ORDER BY pos) AS g FROM idcg_pos""",
    "ndcg_q": """
  SELECT d.qid, CASE WHEN max(i.g) FILTER (WHERE i.pos = 1) > 0 THEN avg(d.g / i.g) ELSE 0 END AS ndcg
  FROM dcg d JOIN idcg i ON d.qid = i.qid AND d.pos = i.pos GROUP BY d.qid""",
}


@query("l4_ndcg_per_query", with_ctes(rounded("SELECT * FROM ndcg_q", ["qid"], ["ndcg"]), NDCG_CTE))
def l4_ndcg_per_query(spark, sf):
    return rank.ndcg_per_query(fx.ranking(spark, sf))


@query("l4_mean_ndcg", with_ctes(rounded("SELECT avg(ndcg) AS mean_ndcg, count(*) AS n_queries FROM ndcg_q",
                                          ["n_queries"], ["mean_ndcg"]), NDCG_CTE))
def l4_mean_ndcg(spark, sf):
    return rank.mean_ndcg(fx.ranking(spark, sf))


# ---------------------------------------------------------------- sparse rows: A12, A11, B8, K9, M7, L5

def _num_sql(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


SVM_CTE = {"svm_lines": f"""
  SELECT r.qid, r.row_id,
         CASE WHEN s.feats IS NULL THEN {_num_sql('CAST(r.label AS DOUBLE)')} || ' qid:' || CAST(r.qid AS VARCHAR)
              ELSE {_num_sql('CAST(r.label AS DOUBLE)')} || ' qid:' || CAST(r.qid AS VARCHAR) || ' ' || s.feats END AS line
  FROM ranking r LEFT JOIN (
    SELECT qid, row_id, string_agg(CAST(idx AS VARCHAR) || ':' || {_num_sql('value')}, ' ' ORDER BY idx) AS feats
    FROM sparse GROUP BY qid, row_id) s ON r.qid = s.qid AND r.row_id = s.row_id"""}


@query("a12_svmlight_lines", with_ctes("SELECT qid, row_id, line FROM svm_lines", SVM_CTE))
def a12_svmlight_lines(spark, sf):
    return sparse.to_svmlight_lines(fx.sparse(spark, sf), fx.sparse_labels(spark, sf), RK)


def scratch_dir(spark, name: str) -> str:
    """A fresh folder under the session's checkpoint folder (shared storage
    on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "mooclens-io", f"{name}-{uuid.uuid4().hex}")


@query("a11_parse_svmlight", with_ctes("""
SELECT CAST(r.label AS DOUBLE) AS label, CAST(r.qid AS INTEGER) AS qid, CAST(s.idx AS INTEGER) AS idx, s.value
FROM sparse s JOIN ranking r ON s.qid = r.qid AND s.row_id = r.row_id"""))
def a11_parse_svmlight(spark, sf):
    """A12 then A11: write the rows as text, read and parse them back."""
    path = scratch_dir(spark, "svmlight")
    sparse.to_svmlight_lines(fx.sparse(spark, sf), fx.sparse_labels(spark, sf), RK).select("line") \
        .write.mode("overwrite").text(path)
    rows, entries, rejects = sparse.parse_svmlight(spark.read.text(path))
    return entries.join(rows, "row_id", "inner").select("label", "qid", "idx", "value")


@query("a11_parse_rejects", with_ctes("""
SELECT reason, count(*) AS n FROM (VALUES ('bad label'), ('bad feature token'), ('indices not ascending'),
  ('bad feature token'), ('empty line')) t(reason) GROUP BY reason"""))
def a11_parse_rejects(spark, sf):
    """A11 reject table on malformed lines appended to real rows."""
    good = sparse.to_svmlight_lines(fx.sparse(spark, sf), fx.sparse_labels(spark, sf), RK).select(
        F.col("line").alias("value"))
    bad = spark.createDataFrame(
        [("x 1:2",), ("1 1:a",), ("1 3:1 2:1",), ("1 0:4",), ("   ",)], "value string")
    _, _, rejects = sparse.parse_svmlight(good.unionByName(bad))
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("b8_drop_feature", with_ctes(
    "SELECT qid, row_id, CASE WHEN idx > 2 THEN idx - 1 ELSE idx END AS idx, value FROM sparse WHERE idx <> 2"))
def b8_drop_feature(spark, sf):
    return sparse.drop_feature(fx.sparse(spark, sf), 2)


K9_CTE = {
    "fac": """
  SELECT idx, CASE WHEN c < (SELECT count(*) FROM ranking) THEN least(mn, 0) ELSE mn END AS fmin,
              CASE WHEN c < (SELECT count(*) FROM ranking) THEN greatest(mx, 0) ELSE mx END AS fmax
  FROM (SELECT idx, min(value) AS mn, max(value) AS mx, count(*) AS c FROM sparse GROUP BY idx) t""",
    "full_grid": """
  SELECT r.qid, r.row_id, f.idx, coalesce(s.value, 0) AS value, f.fmin, f.fmax
  FROM ranking r CROSS JOIN fac f
  LEFT JOIN sparse s ON s.qid = r.qid AND s.row_id = r.row_id AND s.idx = f.idx
  WHERE f.fmax <> f.fmin""",
    "scaled": """
  SELECT qid, row_id, idx, CASE WHEN value = fmin THEN -1.0 WHEN value = fmax THEN 1.0
                                ELSE -1.0 + 2.0 * (value - fmin) / (fmax - fmin) END AS value FROM full_grid""",
}


@query("k9_svm_scale", with_ctes(rounded("SELECT * FROM scaled WHERE value <> 0", RK + ["idx"], ["value"]), K9_CTE))
def k9_svm_scale(spark, sf):
    """K9 to [-1, 1], with implicit zeros written where 0 maps elsewhere."""
    entries, rows = fx.sparse(spark, sf), fx.sparse_labels(spark, sf)
    fac = sparse.scale_factors(entries, rows)
    return sparse.apply_scale(entries, rows, fac, RK)


@query("k9_scale_saved_factors", with_ctes(rounded("""
SELECT CAST(NULL AS BIGINT) AS qid, CAST(NULL AS INTEGER) AS row_id, idx, -1.0 + 2.0 * (0 - fmin) / (fmax - fmin) AS value
FROM fac WHERE fmax <> fmin
UNION ALL
SELECT s.qid, s.row_id, s.idx, -1.0 + 2.0 * (s.value - f.fmin) / (f.fmax - f.fmin) FROM sparse s JOIN fac f ON s.idx = f.idx
WHERE f.fmax <> f.fmin AND s.value <> 0""", RK + ["idx"], ["value"]), K9_CTE))
def k9_scale_saved_factors(spark, sf):
    """K9 with factors saved and loaded: scaled entries, and a row without
    qid and row_id for each feature's default."""
    entries, path = fx.sparse(spark, sf), scratch_dir(spark, "factors")
    sparse.save_factors(sparse.scale_factors(entries, fx.sparse_labels(spark, sf)), path)
    scaled, defaults = sparse.scale_sparse(entries, sparse.load_factors(spark, path))
    keys = [F.lit(None).cast(scaled.schema[c].dataType).alias(c) for c in RK]
    return scaled.select(*RK, "idx", "value").unionByName(defaults.select(*keys, "idx", "value"))


@query("k9_scale_labels", with_ctes(rounded("""
SELECT qid, row_id, -1.0 + 2.0 * (label - (SELECT min(label) FROM ranking)) / ((SELECT max(label) FROM ranking) - (SELECT min(label) FROM ranking)) AS label
FROM ranking""", RK, ["label"])))
def k9_scale_labels(spark, sf):
    """K9's optional target scaling to [-1, 1]."""
    return sparse.scale_labels(fx.sparse_labels(spark, sf)).select(*RK, "label")


M7_CTE = {"m7": """
  SELECT r.qid, r.row_id, r.label, coalesce(z, 0) AS z FROM ranking r LEFT JOIN (
    SELECT s.qid, s.row_id, sum(s.value * w.w) AS z FROM sparse s
    JOIN (SELECT idx, 1.0 / avg(value) AS w FROM sparse WHERE idx <= 2 GROUP BY idx) w ON s.idx = w.idx
    GROUP BY s.qid, s.row_id) t ON r.qid = t.qid AND r.row_id = t.row_id"""}


def _m7_frame(spark, sf):
    entries = fx.sparse(spark, sf)
    weights = entries.where(F.col("idx") <= 2).groupBy("idx").agg((1.0 / F.avg("value")).alias("w"))
    rows = fx.ranking(spark, sf)
    z = sparse.linear_scores(entries, weights, RK, rows)
    return z.join(rows.select(*RK, "label"), RK)


@query("m7_linear_scores", with_ctes(rounded("SELECT qid, row_id, z, 1.0 / (1.0 + exp(-z)) AS p FROM m7",
                                              RK, ["z", "p"]), M7_CTE))
def m7_linear_scores(spark, sf):
    """M7 with a 2-feature model (index 3 is beyond the model: ignored)."""
    z = _m7_frame(spark, sf)
    return z.select(*RK, "z", sparse.linear_probability(F.col("z")).alias("p"))


@query("l5_regression_scores", with_ctes(rounded("""
SELECT avg(CASE WHEN round(z) = label THEN 1.0 ELSE 0.0 END) AS accuracy, avg((round(z) - label) * (round(z) - label)) AS mse,
       (count(*) * sum(round(z) * label) - sum(round(z)) * sum(label)) * (count(*) * sum(round(z) * label) - sum(round(z)) * sum(label))
       / ((count(*) * sum(round(z) * round(z)) - sum(round(z)) * sum(round(z)))
          * (count(*) * sum(label * label) - sum(label) * sum(label))) AS r2,
       count(*) AS n FROM m7""", ["n"], ["accuracy", "mse", "r2"]), M7_CTE))
def l5_regression_scores(spark, sf):
    """L5 on rounded M7 decision values against the labels."""
    z = _m7_frame(spark, sf).withColumn("pred", F.round("z"))
    return metrics.regression_scores(z, "pred", "label")


M7_MULTI_CTE = {
    "mw": """
  SELECT c.class, c.idx, c.w - a.w AS w FROM (
    SELECT r.label AS class, s.idx, avg(s.value) AS w FROM sparse s
    JOIN ranking r ON s.qid = r.qid AND s.row_id = r.row_id GROUP BY r.label, s.idx) c
  JOIN (SELECT idx, avg(value) AS w FROM sparse GROUP BY idx) a ON c.idx = a.idx""",
    "mz": """
  SELECT r.qid, r.row_id, k.class, coalesce(t.z, 0) AS z FROM ranking r
  CROSS JOIN (SELECT DISTINCT class FROM mw) k LEFT JOIN (
    SELECT s.qid, s.row_id, mw.class, sum(s.value * mw.w) AS z FROM sparse s JOIN mw ON s.idx = mw.idx
    GROUP BY s.qid, s.row_id, mw.class) t ON r.qid = t.qid AND r.row_id = t.row_id AND k.class = t.class"""}


@query("m7_multiclass_scores", with_ctes(rounded(
    "SELECT qid, row_id, class, z, (1 / (1 + exp(-z))) / sum(1 / (1 + exp(-z))) OVER (PARTITION BY qid, row_id) AS p, "
    "row_number() OVER (PARTITION BY qid, row_id ORDER BY round(z, 9) DESC, class) = 1 AS predicted FROM mz",
    [*RK, "class", "predicted"], ["z", "p"]), M7_MULTI_CTE))
def m7_multiclass_scores(spark, sf):
    """M7 for more than two classes: a weight vector for each label level
    (its mean value less the mean of all)."""
    entries, rows = fx.sparse(spark, sf), fx.ranking(spark, sf)
    labelled = entries.join(rows.select(*RK, F.col("label").alias("class")), RK)
    means = entries.groupBy("idx").agg(F.avg("value").alias("_a"))
    weights = labelled.groupBy("class", "idx").agg(F.avg("value").alias("_w")).join(means, "idx")
    return sparse.multiclass_scores(entries, weights.select("class", "idx", (F.col("_w") - F.col("_a")).alias("w")), RK, rows)
