"""Score blending and model selection on the long score table
(model, split, id, score) (M6, M9, M10, B11, F2, F3).

Candidate sets are evaluated in one job: for the uniform blend the score
without (or with) candidate m is a closed form of the per-id sum, so the
long table itself is the rows x candidates table and AUC of every
candidate comes from one grouped AUC (L1). The driver only keeps the list
of model ids and one AUC row per candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.functions.scalar import sigmoid
from mooclens.operators.metrics import auc


def uniform_blend(scores: DataFrame, id_col: str = "enrollment_id", keys: tuple[str, ...] = ("split",),
                  apply_sigmoid: bool = True) -> DataFrame:
    """M6: mean score over models per id (sigmoid for output)."""
    g = scores.groupBy(*keys, id_col).agg(F.avg("score").alias("_m"), F.count("score").alias("n_models"))
    out = sigmoid("_m") if apply_sigmoid else F.col("_m")
    return g.select(*keys, id_col, out.alias("score"), "n_models")


def removal_candidates(scores: DataFrame, split: str = "val", id_col: str = "enrollment_id",
                       label: str = "label") -> DataFrame:
    """M9 one round: AUC on ``split`` of the uniform blend of all models
    but m, for every model m present. Returns (model, auc)."""
    s = scores.where(F.col("split") == split)
    tot = s.groupBy(id_col).agg(F.sum("score").alias("_sum"), F.count("score").alias("_k"))
    cand = s.join(tot, id_col, "inner").where(F.col("_k") > 1).select(
        "model", id_col, label, ((F.col("_sum") - F.col("score")) / (F.col("_k") - 1)).alias("score")
    )
    return auc(cand, ["model"], "score", label).select("model", "auc")


def addition_candidates(scores: DataFrame, chosen: list, split: str = "val", id_col: str = "enrollment_id",
                        label: str = "label", repeat: bool = False) -> DataFrame:
    """M10 one round: AUC of the uniform blend of the chosen models (a
    multiset when ``repeat``) plus candidate m. Returns (model, auc)."""
    s = scores.where(F.col("split") == split)
    counts: dict = {}
    for m in chosen:
        counts[m] = counts.get(m, 0) + 1
    k = len(chosen)
    mult = F.lit(0)
    for m, c in counts.items():
        mult = F.when(F.col("model") == m, F.lit(c)).otherwise(mult)
    base = s.withColumn("_w", mult).groupBy(id_col).agg(F.sum(F.col("score") * F.col("_w")).alias("_sum"))
    pool = s if repeat else s.where(~F.col("model").isin(*counts.keys())) if counts else s
    cand = pool.join(base, id_col, "inner").select(
        "model", id_col, label, ((F.col("_sum") + F.col("score")) / (k + 1)).alias("score")
    )
    return auc(cand, ["model"], "score", label).select("model", "auc")


def best_candidate(cands: DataFrame, model: str = "model", metric: str = "auc"):
    """argmax of the metric, first (smallest) model id on ties.
    Returns (model, value) of the winner as Python values (one row)."""
    best = cands.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), F.asc(model)).select(model, metric).first()
    return (None, None) if best is None else (best[0], best[1])


def backward_elimination(scores: DataFrame, rule: str = "until_no_gain", split: str = "val",
                         id_col: str = "enrollment_id", label: str = "label", max_rounds: int | None = None):
    """M9: repeatedly drop the model whose removal gives the best AUC.

    rule: 'exhaust' (drop down to one model), 'exhaust_keep_best'
    (same, return the best set seen), 'until_no_gain' (stop, undoing the
    last removal, when AUC does not improve), 'keep_last' (stop when AUC
    does not improve but keep that removal). Returns (kept model ids,
    history rows [(round, removed, auc)]), history length bounded by the
    number of models.
    """
    s = scores.where(F.col("split") == split).cache()
    current = sorted(r[0] for r in s.select("model").distinct().collect())
    base = auc(s.groupBy(id_col, label).agg(F.avg("score").alias("score")).withColumn("_g", F.lit(0)),
               ["_g"], "score", label).select("auc").first()[0]
    history, best_auc, best_set = [], base, list(current)
    rnd = 0
    while len(current) > 1 and (max_rounds is None or rnd < max_rounds):
        cands = removal_candidates(s.where(F.col("model").isin(*current)), split, id_col, label)
        m, val = best_candidate(cands)
        if m is None:
            break
        rnd += 1
        prev = history[-1][2] if history else base
        history.append((rnd, m, val))
        if rule in ("until_no_gain", "keep_last") and val <= prev:
            if rule == "keep_last":
                current = [x for x in current if x != m]
            break
        current = [x for x in current if x != m]
        if val > best_auc:
            best_auc, best_set = val, list(current)
    s.unpersist()
    if rule == "exhaust_keep_best":
        return best_set, history
    return current, history


def forward_selection(scores: DataFrame, rounds: int | None = None, split: str = "val", id_col: str = "enrollment_id",
                      label: str = "label", repeat: bool = False, rule: str = "until_no_gain"):
    """Greedily add the model with the best blended AUC.

    rule: 'until_no_gain' (stop before the first addition that does not
    raise the AUC) or 'exhaust' (go on to ``rounds``, or until no model is
    left). Returns (chosen model ids, history rows [(round, added, auc)])."""
    if rule not in ("until_no_gain", "exhaust") or (rule == "exhaust" and repeat and rounds is None):
        raise ValueError(f"rule={rule!r}, repeat={repeat}, rounds={rounds}")
    chosen, history = [], []
    while rounds is None or len(chosen) < rounds:
        m, val = best_candidate(addition_candidates(scores, chosen, split, id_col, label, repeat))
        if m is None or (rule == "until_no_gain" and history and val <= history[-1][2]):
            break
        chosen.append(m)
        history.append((len(chosen), m, val))
    return chosen, history


def stable_models(auc_table: DataFrame, tol: float = 0.0015, blend_col: str = "auc_blend",
                  val_col: str = "auc_val") -> DataFrame:
    """Keep models whose blend and validation AUC differ by less than
    ``tol`` and whose validation AUC is positive."""
    return auc_table.where((F.abs(F.col(blend_col) - F.col(val_col)) < tol) & (F.col(val_col) > 0))


def rank_experiments(results: DataFrame, metric: str = "auc") -> DataFrame:
    """experiments ordered by score, best first (ties by name)."""
    return results.orderBy(F.col(metric).desc(), *[c for c in results.columns if c != metric])
