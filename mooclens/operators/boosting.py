"""Boosted regression trees with early stopping (M3 with a pairwise loss, L10).

A round takes the loss's slope g and curvature h of every row at its present
margin, fits a regression tree to -g / h with weights h (so that a leaf holds
its rows' Newton step) and adds ``step`` times its prediction to the margin.
Margins are written once a round: a round starts from files, and boosting can
go on from a stored ensemble. Two losses:

* ``logistic``: log loss of the label;
* ``pairwise``: for two rows of one query with different labels, the square of
  what the better one's margin lacks of being 1 above the other's. Slope and
  curvature come from the pair-free sweeps of ``rank`` (N3), so no pair is
  ever listed. Only (row, query, level, margin) go to the sweeps: the features
  lie in a table bucketed by row, and what a sweep finds is brought to them.

Every ``every`` rounds the validation AUC is taken; after ``patience`` checks
without gain no further tree is fitted, and the ensemble ends with the best
check's tree.

NULL features count 0; rows without a label take no part; rows without a
query are one query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.operators.metrics import auc
from mooclens.operators.models import WIDE_ROWS
from mooclens.operators.rank import FEW_LEVELS, label_levels, margin_violations
from mooclens.operators.ranksvm import RankSVMBatch
from mooclens.session import HOT_ROWS_KEY, conf_int, materialize


#: Most rows of a bucket of the features, where that takes more buckets than tasks.
BUCKET_ROWS = 1 << 18


@dataclass
class Ensemble:
    """Trees, the share of each that counts, the margin before the first."""

    features: list[str]
    step: float
    base: float = 0.0
    trees: list = field(default_factory=list)

    def margin(self, x: DataFrame, out: str = "z", since: int = 0, to: int | None = None) -> DataFrame:
        """Adds the trees' share to the column ``out`` of rows with ``x``."""
        total = F.col(out)
        vector = x.withColumn("_features", array_to_vector("x"))
        for k, tree in enumerate(self.trees[since:to]):
            vector = tree.copy().setFeaturesCol("_features").setPredictionCol(f"_p{k}").transform(vector)
            total = total + F.lit(self.step) * F.col(f"_p{k}")
        return vector.select(*[c for c in x.columns if c != out], total.alias(out))


def _rows(df: DataFrame, features: list[str], *others) -> DataFrame:
    return df.select(*others, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"))


def score(model: Ensemble, df: DataFrame, id_col: str = "enrollment_id") -> DataFrame:
    """(id, score): the margin squashed to (0, 1)."""
    z = model.margin(_rows(df, model.features, id_col).withColumn("z", F.lit(model.base)))
    return z.select(id_col, (1 / (1 + F.exp(-F.col("z")))).alias("score"))


def _slopes(state: DataFrame, loss: str, small: bool | None = None) -> DataFrame:
    """``state`` (q, level or y, z) with g, h and each row's part of the loss."""
    if loss == "logistic":
        p = 1 / (1 + F.exp(-F.col("z")))
        part = F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("y") * F.col("z")
        return state.select("*", (p - F.col("y")).alias("g"), F.greatest(p * (1 - p), F.lit(1e-12)).alias("h"), part.alias("part"))
    found = margin_violations(state, "z", qid="q", rid="r", small=small)
    shortfall = F.col("l_minus") * (1 - F.col("z")) + F.col("gamma_minus")
    slope = F.col("l_plus") * (1 + F.col("z")) - F.col("gamma_plus") - shortfall
    bend = (F.col("l_plus") + F.col("l_minus")).cast("double")
    return found.select(*state.columns, (2 * slope).alias("g"), (2 * bend).alias("h"), (shortfall + F.col("z") * slope).alias("part"))


def _fit_a_task(state: DataFrame) -> bool:
    """Whether no query is too great for one task's sweep. With few levels a
    row takes one place there, else up to two."""
    most, level = state.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("level")).agg(F.max("n"), F.max("level")).first()
    return (most or 0) * (1 if (level or 0) <= FEW_LEVELS else 2) <= conf_int(state.sparkSession, HOT_ROWS_KEY)


def boost(train: DataFrame, features: list[str], loss: str = "logistic", valid: DataFrame | None = None, rounds: int = 240,
          step: float = 0.05, max_depth: int = 6, every: int = 5, patience: int = 7, label: str = "label",
          qid: str | None = None, id_col: str = "enrollment_id", start: Ensemble | None = None,
          min_instances: int = 1) -> tuple[Ensemble, list[float], list[tuple[int, float]]]:
    """Fit up to ``rounds`` trees on top of ``start``. Returns the ensemble,
    the training loss before each round and [(trees, validation AUC)]."""
    if loss not in ("logistic", "pairwise"):
        raise ValueError(f"loss={loss!r}")
    model = Ensemble(list(features), step, start.base if start else 0.0, list(start.trees) if start else [])
    if start and (start.features != model.features or start.step != step):
        raise ValueError("an ensemble goes on with its own features and step")
    y = (F.col(label) == 1).cast("double").alias("y")
    query = F.col(qid).alias("q") if qid else F.lit(0).alias("q")
    state = _rows(train.where(F.col(label).isNotNull()), features, F.col(id_col).alias("r"), query, y)
    if loss == "pairwise":
        state = label_levels(state, "q", "y")
    state = model.margin(state.withColumn("z", F.lit(model.base)))
    # ids may repeat: a row is told by its number
    state = materialize(state.withColumn("r", F.monotonically_increasing_id()) if loss == "pairwise" else state, "margins")
    n = state.count()
    wide = math.ceil(n / WIDE_ROWS)
    held = small = matrix = kept = None
    if loss == "pairwise":
        small = _fit_a_task(state)
        buckets = max(1, min(wide, 4 * train.sparkSession.sparkContext.defaultParallelism), math.ceil(n / BUCKET_ROWS))
        matrix = RankSVMBatch._stored(state.select("r", "x").repartition(buckets, "r"), "r", buckets)
        state = state.drop("x", "y")
    if valid is not None:
        held = _rows(valid.where(F.col(label).isNotNull()), features, y).withColumn("z", F.lit(model.base))
        held = materialize(model.margin(held), "margins")
    losses, checks, best, scored = [], [], (-1.0, len(model.trees)), len(model.trees)
    for _ in range(rounds):
        state = _slopes(state, loss, small)
        # a query's sweep leaves its rows in one task: a tree is fitted by all
        state = materialize(state.repartition(wide) if matrix is not None and wide > 1 else state, "slopes")
        if kept is not None:
            kept.unpersist()  # the slopes hold what the last round's margins were made from
            kept = None
        losses.append(state.agg(F.sum("part")).first()[0] or 0.0)
        if state.where("h > 0").isEmpty():
            break
        if matrix is not None:
            # a fit reads its rows several times, and then the margins do
            state = kept = state.drop("part").join(matrix, "r").persist(StorageLevel.MEMORY_AND_DISK)
        rows = state.where("h > 0").select(array_to_vector("x").alias("features"), (-F.col("g") / F.col("h")).alias("label"), F.col("h").alias("weight"))
        tree = DecisionTreeRegressor(maxDepth=max_depth, weightCol="weight", minInstancesPerNode=min_instances).fit(rows)
        model.trees.append(tree)
        state = model.margin(state.drop("g", "h", "part"), since=len(model.trees) - 1)
        state = state if matrix is None else state.drop("x")
        if held is not None and len(model.trees) % every == 0:
            held = materialize(model.margin(held, since=scored), "margins")
            scored = len(model.trees)
            now = auc(held.withColumn("k", F.lit(0)), ["k"], "z", "y").first()
            checks.append((scored, now["auc"] if now and now["auc"] is not None else 0.0))
            if checks[-1][1] > best[0]:
                best = (checks[-1][1], scored)
            elif sum(n > best[1] for n, _ in checks) >= patience:
                break
    if kept is not None:
        kept.unpersist()
    if checks:
        model.trees = model.trees[: best[1]]
    return model, losses, checks
