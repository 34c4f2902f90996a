"""Score calibration and feature scaling.

Group statistics are computed with one aggregation and joined back (the
group table is small: one row per model/split or per course), never with
an unordered window over a whole group, so a hot group does not end up in
one task. Rows whose group is NULL are a group of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.functions.scalar import safe_div, seeded
from mooclens.operators.prefix import _join_same, row_numbers
from mooclens.operators.sizing import maybe_broadcast


def _stats(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(
        F.min(col).alias("_min"), F.max(col).alias("_max"), F.avg(col).alias("_mean"),
        F.var_pop(col).alias("_var"), F.count(F.lit(1)).alias("_n"),
    )


def _join_stats(df: DataFrame, keys: list[str], stats: DataFrame) -> DataFrame:
    if keys:
        return _join_same(df, maybe_broadcast(stats), keys, "inner")
    # Global statistics: a single-row table, applied as scalar subqueries.
    row = {c: stats.select(c).scalar() for c in stats.columns}
    return df.select("*", *[v.alias(k) for k, v in row.items()])


def rank_calibrate(df: DataFrame, keys: list[str], score: str = "score", id_col: str = "enrollment_id",
                   out: str = "score") -> DataFrame:
    """K1: position in ascending score order / n, in [0, 1); ties broken by
    id. Ranks come from the skew-safe row numbering (P1)."""
    ranked = row_numbers(df, keys, [score, id_col], "_rn")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = _join_same(ranked, maybe_broadcast(counts), keys, "inner")
    res = ((F.col("_rn") - 1) / F.col("_n")).alias(out)
    return j.select(*[c for c in df.columns if c != out], res)


def minmax_calibrate(df: DataFrame, keys: list[str], score: str = "score", out: str = "score") -> DataFrame:
    """K2: (x - min) / (max - min); a constant group maps to 0."""
    j = _join_stats(df, keys, _stats(df, keys, score))
    res = safe_div(F.col(score) - F.col("_min"), F.col("_max") - F.col("_min")).alias(out)
    return j.select(*[c for c in df.columns if c != out], res)


def range_calibrate(df: DataFrame, keys: list[str], score: str = "score", out: str = "score") -> DataFrame:
    """K3: (x - mean) / (max - min); a constant group maps to 0."""
    j = _join_stats(df, keys, _stats(df, keys, score))
    res = safe_div(F.col(score) - F.col("_mean"), F.col("_max") - F.col("_min")).alias(out)
    return j.select(*[c for c in df.columns if c != out], res)


def std_calibrate(df: DataFrame, keys: list[str], score: str = "score", out: str = "score") -> DataFrame:
    """K4: (x - mean) / population variance (the reference divides by the
    variance, not the deviation; its 'isotonic' variant is the same)."""
    j = _join_stats(df, keys, _stats(df, keys, score))
    res = safe_div(F.col(score) - F.col("_mean"), F.col("_var")).alias(out)
    return j.select(*[c for c in df.columns if c != out], res)


isotonic_calibrate_as_written = std_calibrate


def normalize_by_group(features: DataFrame, groups: DataFrame, cols: list[str], key: str = "enrollment_id",
                       group: str = "course_id") -> DataFrame:
    """K5: per column (x - group mean) / group sample deviation; NaN -> 0.

    All columns in one aggregation; the per-group table is joined back
    (broadcast after a row-count check).
    """
    j = features.join(groups.select(key, group), key, "left")
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"_m{i}"), F.stddev_samp(c).alias(f"_s{i}")]
    stats = maybe_broadcast(j.groupBy(group).agg(*aggs))
    j = j.join(stats, group, "left")
    out = [safe_div(F.col(c) - F.col(f"_m{i}"), F.col(f"_s{i}")).alias(c) for i, c in enumerate(cols)]
    keep = [c for c in features.columns if c not in cols]
    return j.select(*keep, *out)


def column_minmax(df: DataFrame, cols: list[str], fit: DataFrame | None = None) -> DataFrame:
    """K6: min-max each column to [0, 1]; all-zero columns stay as they
    are; a constant non-zero column maps to 0. ``fit`` (default ``df``)
    supplies the min / max (K7: pass the union of all splits). The driver
    takes one row, three numbers a column: as subqueries they would be one
    plan each in every later plan on the result."""
    src = fit if fit is not None else df
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}"),
                 F.count(F.when(F.col(c) != 0, 1)).alias(f"_nz{i}")]
    stats = src.agg(*aggs)
    row = stats.first()
    vals = {f.name: F.lit(row[f.name]).cast(f.dataType) for f in stats.schema}
    out = []
    for i, c in enumerate(cols):
        lo, hi, nz = vals[f"_lo{i}"], vals[f"_hi{i}"], vals[f"_nz{i}"]
        scaled = safe_div(F.col(c) - lo, hi - lo)
        out.append(F.when(nz == 0, F.col(c).cast("double")).otherwise(scaled).alias(c))
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *out)


def joint_minmax(parts: dict[str, DataFrame], cols: list[str]) -> dict[str, DataFrame]:
    """K7: fit K6 on all parts stacked, apply to each part."""
    frames = list(parts.values())
    union = frames[0].select(*cols)
    for f in frames[1:]:
        union = union.unionByName(f.select(*cols))
    return {k: column_minmax(v, cols, fit=union) for k, v in parts.items()}


def binarize_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """H9 on a table: x > 0 -> 1 else 0 for every listed column."""
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *[(F.col(c) > 0).cast("int").alias(c) for c in cols])


def shuffled(df: DataFrame, id_col: str, seed: int = 0, out: str = "position") -> DataFrame:
    """a random permutation as each row's place, 1..n, in a seeded order
    (P1 numbers the rows; equal draws go by id)."""
    keyed = df.withColumn("_h", seeded(id_col, seed)).withColumn("_g", F.lit(0))
    return row_numbers(keyed, ["_g"], ["_h", id_col], out).select(*df.columns, out)


def holdout_split(df: DataFrame, id_col: str, frac: float = 0.8, seed: int = 0) -> DataFrame:
    """Shuffle and put the first int(frac * n) + 1 rows in 'train', the
    rest in 'valid'."""
    cut = int(frac * df.count()) + 1
    part = F.when(F.col("_place") <= cut, "train").otherwise("valid").alias("part")
    return shuffled(df, id_col, seed, "_place").select(*df.columns, part)


def random_half(models: DataFrame, model_col: str = "model", seed: int = 0) -> DataFrame:
    """Keep each model with probability 1/2 (by its seeded draw)."""
    return models.where(seeded(model_col, seed) % 2 == 0)


def one_hot_label(df: DataFrame, label: str = "label", n_classes: int = 2) -> DataFrame:
    """Label -> indicator columns label_0 .. label_{k-1}."""
    return df.select("*", *[(F.col(label) == k).cast("int").alias(f"{label}_{k}") for k in range(n_classes)])
