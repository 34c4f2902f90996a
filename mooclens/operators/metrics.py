"""Evaluation: exact ROC AUC for many models at once (L1, L2), accuracy /
MSE / r^2 (L5), fold statistics (L6), stratified folds (L7) and class
weights (L11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.functions.scalar import seeded
from mooclens.operators.prefix import prefix_sums, row_numbers
from mooclens.operators.sizing import maybe_broadcast


def auc(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """L1: exact ROC AUC per group (e.g. model, split), ties count half.

    Rows are first reduced to one row per (group, distinct score) with
    positive and negative counts (partial aggregation before the
    shuffle); a skew-safe running sum gives the negatives below each
    score; AUC = sum(pos * (neg_below + neg_tie / 2)) / (P * N). All
    groups are computed in the same job. Groups lacking either class get
    NULL.
    """
    y = F.col(label)
    per_score = df.groupBy(*keys, score).agg(
        F.count(F.when(y == 1, 1)).alias("_pos"), F.count(F.when(y != 1, 1)).alias("_neg")
    )
    run = prefix_sums(per_score, keys, [score], {"_below": F.col("_neg")}, inclusive=False)
    num = F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)
    g = run.groupBy(*keys).agg(F.sum(num).alias("_num"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    den = F.col("n_pos") * F.col("n_neg")
    return g.select(*keys, F.when(den > 0, F.col("_num") / den).alias("auc"), "n_pos", "n_neg")


def auc_by_split(df: DataFrame, model: str = "model", split: str = "split", splits=("blend", "val"),
                 score: str = "score", label: str = "label") -> DataFrame:
    """L2: one row per model with one AUC column per split."""
    a = auc(df.where(F.col(split).isin(*splits)), [model, split], score, label)
    return a.groupBy(model).pivot(split, list(splits)).agg(F.first("auc")).select(
        model, *[F.col(s).alias(f"auc_{s}") for s in splits]
    )


def regression_scores(df: DataFrame, pred: str = "pred", label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """Accuracy (exact equality), mean squared error and squared
    correlation (from sums, as the reference computes it)."""
    p, y = F.col(pred).cast("double"), F.col(label).cast("double")
    n = F.count(F.lit(1)).cast("double")
    sp, sy, spp, syy, spy = F.sum(p), F.sum(y), F.sum(p * p), F.sum(y * y), F.sum(p * y)
    num = (n * spy - sp * sy) * (n * spy - sp * sy)
    den = (n * spp - sp * sp) * (n * syy - sy * sy)
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(
        F.avg((p == y).cast("double")).alias("accuracy"),
        F.avg((p - y) * (p - y)).alias("mse"),
        F.try_divide(num, den).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def fold_summary(df: DataFrame, value: str = "auc", keys: list[str] | None = None) -> DataFrame:
    """Mean, population std, min, max over folds."""
    g = df.groupBy(*keys) if keys else df.groupBy()
    v = F.col(value)
    return g.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"),
                 F.max(v).alias("max"), F.count(v).alias("n_folds"))


def stratified_folds(df: DataFrame, k: int, id_col: str = "enrollment_id", label: str = "label",
                     seed: int | None = 0, out: str = "fold") -> DataFrame:
    """fold = (position inside the row's class in a seeded hash order)
    mod k; ``seed=None`` keeps id order (the unshuffled variant). Classes
    are huge groups, so positions come from the skew-safe numbering."""
    if seed is None:
        keyed = df.withColumn("_o", F.col(id_col).cast("double"))
    else:
        keyed = df.withColumn("_o", seeded(id_col, seed).cast("double"))
    ranked = row_numbers(keyed, [label], ["_o", id_col], "_rn")
    return ranked.select(*df.columns, ((F.col("_rn") - 1) % k).cast("int").alias(out))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Inverse class frequency weights n / (n_classes * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    tot = counts.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    n, k = tot.select("_n").scalar(), tot.select("_k").scalar()
    return counts.select(label, (n / (k * F.col("_c"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    w = maybe_broadcast(class_weights(df, label).withColumnRenamed("weight", out))
    return df.join(w, label, "left")
