"""Registered calibration, evaluation and blending queries over the
fixture score table (64 models x ids, three splits)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mooclens.operators import blend, metrics, scale
from mooclens.operators import activity
from mooclens.plans.oracle import rounded, with_ctes
from mooclens.plans.queries_features import fx_log
from mooclens.plans.registry import query
from mooclens.session import materialize
from mooclens.sources import fixtures as fx

KEYS = ["model", "split"]
COLS = ["enrollment_id", "model", "split", "label"]

# AUC by average ranks (Mann-Whitney), an independent formulation of L1.
AUC_SQL = """
SELECT {keys}, CASE WHEN p * n > 0 THEN (rs - p * (p + 1) / 2.0) / (p * n) END AS auc, p AS n_pos, n AS n_neg FROM (
  SELECT {keys}, sum(r) FILTER (WHERE label = 1) AS rs, count(*) FILTER (WHERE label = 1) AS p,
         count(*) FILTER (WHERE label <> 1) AS n FROM (
    SELECT {keys}, label, rank() OVER (PARTITION BY {keys} ORDER BY score)
           + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS r FROM {src}) a
  GROUP BY {keys}) b"""


def auc_sql(src: str, keys: list[str]) -> str:
    return AUC_SQL.format(keys=", ".join(keys), src=src)


MINMAX_CTE = {"cal": """
  SELECT enrollment_id, model, split, label,
         CASE WHEN max(score) OVER w = min(score) OVER w THEN 0
              ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score
  FROM scores WINDOW w AS (PARTITION BY model, split)"""}


def cal_scores(spark, sf):
    return scale.minmax_calibrate(fx.scores(spark, sf), KEYS)


# ---------------------------------------------------------------- K1-K4

@query("k1_rank_calibrate", with_ctes(rounded("""
SELECT enrollment_id, model, split, label,
       (row_number() OVER (PARTITION BY model, split ORDER BY score, enrollment_id) - 1)
       / count(*) OVER (PARTITION BY model, split) AS score FROM scores""", COLS, ["score"])))
def k1_rank_calibrate(spark, sf):
    return scale.rank_calibrate(fx.scores(spark, sf), KEYS).select(*COLS, "score")


@query("k2_minmax_calibrate", with_ctes(rounded("SELECT * FROM cal", COLS, ["score"]), MINMAX_CTE))
def k2_minmax_calibrate(spark, sf):
    return cal_scores(spark, sf).select(*COLS, "score")


@query("k3_range_calibrate", with_ctes(rounded("""
SELECT enrollment_id, model, split, label,
       CASE WHEN max(score) OVER w = min(score) OVER w THEN 0
            ELSE (score - avg(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score
FROM scores WINDOW w AS (PARTITION BY model, split)""", COLS, ["score"])))
def k3_range_calibrate(spark, sf):
    return scale.range_calibrate(fx.scores(spark, sf), KEYS).select(*COLS, "score")


@query("k4_std_calibrate", with_ctes(rounded("""
SELECT enrollment_id, model, split, label,
       CASE WHEN var_pop(score) OVER w = 0 THEN 0 ELSE (score - avg(score) OVER w) / var_pop(score) OVER w END AS score
FROM scores WINDOW w AS (PARTITION BY model, split)""", COLS, ["score"])))
def k4_std_calibrate(spark, sf):
    return scale.std_calibrate(fx.scores(spark, sf), KEYS).select(*COLS, "score")


# ---------------------------------------------------------------- K6 / K7 column scaling

K6_COLS = ["n_records", "online_day", "n_server_wiki_free", "n_browser_video", "n_video_object"]


def _k6_frame(spark, sf):
    act = activity.total_activity(fx_log(spark, sf))
    # an all-zero column exercises the "left untouched" rule
    return act.select("enrollment_id", "n_records", "online_day", F.lit(0).cast("long").alias("n_server_wiki_free"),
                      "n_browser_video", "n_video_object")


def _k6_sql(where: str = "") -> str:
    stats = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, count(*) FILTER (WHERE {c} <> 0) AS nz_{c}"
                      for c in K6_COLS)
    src = ("SELECT enrollment_id, n_records, online_day, 0 AS n_server_wiki_free, n_browser_video, n_video_object "
           "FROM activity")
    cols = ", ".join(
        f"CASE WHEN nz_{c} = 0 THEN CAST({c} AS DOUBLE) WHEN hi_{c} = lo_{c} THEN 0 "
        f"ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END AS {c}" for c in K6_COLS
    )
    body = f"SELECT enrollment_id, {cols} FROM ({src}) a, (SELECT {stats} FROM ({src}) x) s {where}"
    return with_ctes(rounded(body, ["enrollment_id"], K6_COLS))


@query("k6_column_minmax", _k6_sql())
def k6_column_minmax(spark, sf):
    return scale.column_minmax(_k6_frame(spark, sf), K6_COLS)


@query("k7_joint_minmax", _k6_sql("WHERE enrollment_id % 2 = 1"))
def k7_joint_minmax(spark, sf):
    """K7: fit on two parts stacked (odd / even ids), return the odd part."""
    df = _k6_frame(spark, sf)
    parts = {"odd": df.where(F.col("enrollment_id") % 2 == 1), "even": df.where(F.col("enrollment_id") % 2 == 0)}
    return scale.joint_minmax(parts, K6_COLS)["odd"]


# ---------------------------------------------------------------- L1, L2, L6, L7, L11

@query("l1_auc", with_ctes(rounded(auc_sql("scores", KEYS), KEYS + ["n_pos", "n_neg"], ["auc"])))
def l1_auc(spark, sf):
    """L1: exact AUC of every (model, split) in one job."""
    return metrics.auc(fx.scores(spark, sf), KEYS)


@query("l2_auc_by_split", with_ctes(rounded(
    "SELECT model, max(auc) FILTER (WHERE split = 'blend') AS auc_blend, max(auc) FILTER (WHERE split = 'val') "
    "AS auc_val FROM (" + auc_sql("scores", KEYS) + ") a GROUP BY model", ["model"], ["auc_blend", "auc_val"])))
def l2_auc_by_split(spark, sf):
    return metrics.auc_by_split(fx.scores(spark, sf))


FOLD_CTE = {"folds": """
  SELECT enrollment_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY enrollment_id) - 1) % 5 AS INTEGER)
         AS fold FROM truth"""}


@query("l7_stratified_folds", with_ctes("SELECT * FROM folds", FOLD_CTE))
def l7_stratified_folds(spark, sf):
    """L7 unshuffled: position inside the class in id order, mod 5."""
    return metrics.stratified_folds(fx.truth(spark, sf), 5, seed=None)


def draw_sql(col: str, seed: int) -> str:
    """The draw of ``functions.scalar.seeded``."""
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({col} AS VARCHAR)), 1, 13) AS BIGINT)"


@query("l7_stratified_folds_hashed", with_ctes(f"""
SELECT enrollment_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {draw_sql("enrollment_id", 7)}, enrollment_id) - 1)
       % 5 AS INTEGER) AS fold FROM truth"""))
def l7_stratified_folds_hashed(spark, sf):
    """L7 shuffled by seeded draws."""
    return metrics.stratified_folds(fx.truth(spark, sf), 5, seed=7)


SCORE_FOLD_CTE = {"score_folds": """
  SELECT s.model, s.score, s.label, CAST((row_number() OVER (PARTITION BY s.model, s.label ORDER BY s.enrollment_id) - 1)
         % 5 AS INTEGER) AS fold FROM scores s WHERE split = 'blend'"""}


@query("l6_fold_summary", with_ctes(rounded(
    "SELECT model, avg(auc) AS mean, stddev_pop(auc) AS std, min(auc) AS min, max(auc) AS max, "
    "count(auc) AS n_folds FROM (" + auc_sql("score_folds", ["model", "fold"]) + ") a GROUP BY model",
    ["model", "n_folds"], ["mean", "std", "min", "max"]), SCORE_FOLD_CTE))
def l6_fold_summary(spark, sf):
    """AUC per stratified fold of the blend split, summarised per model."""
    s = fx.scores(spark, sf).where(F.col("split") == "blend")
    folded = _folds_per_model(s)
    a = metrics.auc(folded, ["model", "fold"])
    return metrics.fold_summary(a, "auc", ["model"])


def _folds_per_model(s):
    from mooclens.operators.prefix import row_numbers
    r = row_numbers(s.withColumn("_o", F.col("enrollment_id").cast("double")), ["model", "label"],
                    ["_o", "enrollment_id"], "_rn")
    return r.select(*s.columns, ((F.col("_rn") - 1) % 5).cast("int").alias("fold"))


@query("l11_class_weights", with_ctes(rounded(
    "SELECT label, (SELECT count(*) FROM truth) / ((SELECT count(DISTINCT label) FROM truth) * count(*)) AS weight "
    "FROM truth GROUP BY label", ["label"], ["weight"])))
def l11_class_weights(spark, sf):
    return metrics.class_weights(fx.truth(spark, sf))


# ---------------------------------------------------------------- M6, M9, M10, B11, F2

@query("m6_uniform_blend", with_ctes(rounded(
    "SELECT split, enrollment_id, 1.0 / (1.0 + exp(-avg(score))) AS score, count(score) AS n_models "
    "FROM cal GROUP BY split, enrollment_id", ["split", "enrollment_id", "n_models"], ["score"]), MINMAX_CTE))
def m6_uniform_blend(spark, sf):
    return blend.uniform_blend(cal_scores(spark, sf))


REMOVAL_CTE = {**MINMAX_CTE, "removal": """
  SELECT c.model, c.enrollment_id, c.label, (t.s - c.score) / (t.k - 1) AS score
  FROM cal c JOIN (SELECT enrollment_id, sum(score) AS s, count(score) AS k FROM cal WHERE split = 'val'
                   GROUP BY enrollment_id) t ON c.enrollment_id = t.enrollment_id
  WHERE c.split = 'val' AND t.k > 1"""}


@query("m9_removal_round", with_ctes(rounded(
    "SELECT model, auc FROM (" + auc_sql("removal", ["model"]) + ") a", ["model"], ["auc"]), REMOVAL_CTE))
def m9_removal_round(spark, sf):
    """M9, one round for every candidate: AUC of the blend without it."""
    return blend.removal_candidates(cal_scores(spark, sf))


@query("f2_best_removal", with_ctes(rounded(
    "SELECT model, auc FROM (" + auc_sql("removal", ["model"]) + ") a ORDER BY auc DESC, model LIMIT 1",
    ["model"], ["auc"]), REMOVAL_CTE))
def f2_best_removal(spark, sf):
    """the argmax candidate (first model id on ties); a top-1 report."""
    m, val = blend.best_candidate(blend.removal_candidates(cal_scores(spark, sf)))
    return spark.createDataFrame([(int(m), float(val))], "model int, auc double")


ADD_CTE = {**MINMAX_CTE, "addition": """
  SELECT c.model, c.enrollment_id, c.label, (b.score + c.score) / 2.0 AS score
  FROM cal c JOIN (SELECT enrollment_id, score FROM cal WHERE split = 'val' AND model = 0) b
    ON c.enrollment_id = b.enrollment_id
  WHERE c.split = 'val' AND c.model <> 0"""}


@query("m10_addition_round", with_ctes(rounded(
    "SELECT model, auc FROM (" + auc_sql("addition", ["model"]) + ") a", ["model"], ["auc"]), ADD_CTE))
def m10_addition_round(spark, sf):
    """M10, one round after choosing model 0: AUC of adding each other model."""
    return blend.addition_candidates(cal_scores(spark, sf), [0])


@query("b11_stable_models", with_ctes(rounded(
    "SELECT * FROM (SELECT model, max(auc) FILTER (WHERE split = 'blend') AS auc_blend, "
    "max(auc) FILTER (WHERE split = 'val') AS auc_val FROM (" + auc_sql("scores", KEYS) + ") a GROUP BY model) t "
    "WHERE abs(auc_blend - auc_val) < 0.02 AND auc_val > 0", ["model"], ["auc_blend", "auc_val"])))
def b11_stable_models(spark, sf):
    """B11 with a 0.02 tolerance (the reference's 0.0015 keeps no model here)."""
    return blend.stable_models(metrics.auc_by_split(fx.scores(spark, sf)), tol=0.02)


@query("m9_backward_elimination")
def m9_backward_elimination(spark, sf):
    """M9 full loop (exhaust_keep_best) on the calibrated val split; one
    row per round (rows-only check)."""
    kept, hist = blend.backward_elimination(cal_scores(spark, sf), rule="exhaust_keep_best")
    rows = [(r, int(m), float(a), len(kept)) for r, m, a in hist]
    return spark.createDataFrame(rows, "round int, removed int, auc double, n_kept int")


@query("m10_forward_selection")
def m10_forward_selection(spark, sf):
    """M10 whole loop: models are added, repeatedly if that helps, until the
    validation AUC no longer rises."""
    _, hist = blend.forward_selection(materialize(cal_scores(spark, sf), "scores"), repeat=True)
    return spark.createDataFrame([(r, int(m), float(a)) for r, m, a in hist], "round int, added int, auc double")


# ---------------------------------------------------------------- F4, K13, K14 (seeded draws)

PLACE_SQL = f"row_number() OVER (ORDER BY {draw_sql('enrollment_id', 3)}, enrollment_id)"


@query("f4_shuffled", with_ctes(f"SELECT enrollment_id, label, {PLACE_SQL} AS position FROM truth"))
def f4_shuffled(spark, sf):
    """a seeded random permutation of the enrollments."""
    return scale.shuffled(fx.truth(spark, sf), "enrollment_id", seed=3)


@query("k13_holdout_split", with_ctes(f"""
SELECT enrollment_id, label, CASE WHEN {PLACE_SQL} <= floor(0.8 * count(*) OVER ()) + 1 THEN 'train' ELSE 'valid' END AS part FROM truth"""))
def k13_holdout_split(spark, sf):
    return scale.holdout_split(fx.truth(spark, sf), "enrollment_id", 0.8, seed=3)


@query("k14_random_half_models", with_ctes(f"SELECT model FROM (SELECT DISTINCT model FROM scores) m WHERE {draw_sql('model', 1)} % 2 = 0"))
def k14_random_half_models(spark, sf):
    models = fx.scores(spark, sf).select("model").distinct()
    return scale.random_half(models, "model", seed=1)


# ---------------------------------------------------------------- B6, B7, G5, H13, H14, M12

@query("b6_semi_join_labels", with_ctes(
    "SELECT t.enrollment_id, t.label FROM truth t WHERE t.enrollment_id IN "
    "(SELECT enrollment_id FROM log WHERE event = 'video')"))
def b6_semi_join_labels(spark, sf):
    """Labels of the enrollments that watched a video (left semi join)."""
    from mooclens.plans.queries_features import fx_log
    ids = fx_log(spark, sf).where(F.col("event") == "video").select("enrollment_id")
    return fx.truth(spark, sf).join(ids, "enrollment_id", "left_semi")


@query("b7_anti_join_no_log", with_ctes(
    "SELECT e.enrollment_id FROM enrollment e WHERE e.enrollment_id NOT IN "
    "(SELECT enrollment_id FROM log WHERE date >= DATE '2024-01-03')"))
def b7_anti_join_no_log(spark, sf):
    """Enrollments without log rows from 2024-01-03 on (left anti join)."""
    from mooclens.plans.queries_features import fx_log
    recent = fx_log(spark, sf).where(F.col("date") >= F.lit("2024-01-03").cast("date")).select("enrollment_id")
    return fx.enrollment(spark, sf).select("enrollment_id").join(recent, "enrollment_id", "left_anti")


@query("g5_key_difference", with_ctes(
    "SELECT enrollment_id FROM (SELECT enrollment_id FROM truth EXCEPT ALL "
    "SELECT DISTINCT enrollment_id FROM log WHERE source = 'server') t"))
def g5_key_difference(spark, sf):
    """Ids with a label but no server event (multiset difference)."""
    from mooclens.plans.queries_features import fx_log
    srv = fx_log(spark, sf).where(F.col("source") == "server").select("enrollment_id").distinct()
    return fx.truth(spark, sf).select("enrollment_id").exceptAll(srv)


@query("h13_squared_features", with_ctes(rounded(
    "SELECT enrollment_id, model, split, score, score * score AS score_sq FROM cal",
    ["enrollment_id", "model", "split"], ["score", "score_sq"]), MINMAX_CTE))
def h13_squared_features(spark, sf):
    """Features with their squares appended."""
    c = cal_scores(spark, sf)
    return c.select("enrollment_id", "model", "split", "score", (F.col("score") * F.col("score")).alias("score_sq"))


@query("h14_log_minmax", with_ctes(rounded("""
SELECT enrollment_id, model, split,
       CASE WHEN max(t) OVER w = min(t) OVER w THEN 0 ELSE (t - min(t) OVER w) / (max(t) OVER w - min(t) OVER w) END
       AS score
FROM (SELECT enrollment_id, model, split, ln(score + 1) AS t FROM cal) c WINDOW w AS (PARTITION BY model, split)""",
    ["enrollment_id", "model", "split"], ["score"]), MINMAX_CTE))
def h14_log_minmax(spark, sf):
    """log(minmax + 1), min-maxed again per (model, split)."""
    c = cal_scores(spark, sf).withColumn("score", F.log1p("score"))
    return scale.minmax_calibrate(c, KEYS).select("enrollment_id", "model", "split", "score")


@query("m12_experiment_sweep", with_ctes(rounded(
    "SELECT model, auc FROM (" + auc_sql("removal", ["model"]) + ") a", ["model"], ["auc"]), REMOVAL_CTE))
def m12_experiment_sweep(spark, sf):
    """The leave-one-model-out sweep as one candidate batch, ordered
    best first (F3)."""
    return blend.rank_experiments(blend.removal_candidates(cal_scores(spark, sf)))


@query("k12_one_hot_label", with_ctes(
    "SELECT enrollment_id, label, CAST(label = 0 AS INTEGER) AS label_0, CAST(label = 1 AS INTEGER) AS label_1 "
    "FROM truth"))
def k12_one_hot_label(spark, sf):
    """Label as indicator columns."""
    return scale.one_hot_label(fx.truth(spark, sf), "label", 2)
