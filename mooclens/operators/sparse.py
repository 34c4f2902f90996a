"""Sparse labelled rows in long form (row keys, idx, value) with a row
table (row keys, label[, qid]): text format (A11, A12), feature removal
(B8), svm-scale (K9) and linear prediction (M7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooclens.operators.sizing import maybe_broadcast
from mooclens.session import materialize


def num_text(c: Column) -> Column:
    """Number as text the way svmlight writers print it: integral values
    without a fraction, others in shortest round-trip form."""
    d = c.cast("double")
    return F.when(d == F.floor(d), F.floor(d).cast("bigint").cast("string")).otherwise(d.cast("string"))


def to_svmlight_lines(entries: DataFrame, rows: DataFrame, keys: list[str], label: str = "label",
                      qid: str | None = "qid") -> DataFrame:
    """One text line per row, ``label [qid:q] idx:val ...`` with
    1-based ascending indices and zeros left out. Returns keys + line.

    A row's entries are bounded by the feature count, so gathering them
    into one line is a per-row operation, not a group collection.
    """
    pairs = entries.where(F.col("value") != 0).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("i"), F.col("value").alias("v"))))
        .alias("_e")
    )
    j = rows.join(pairs, keys, "left")
    head = num_text(F.col(label))
    if qid:
        head = F.concat(head, F.lit(" qid:"), F.col(qid).cast("string"))
    feats = F.transform(F.coalesce("_e", F.array().cast("array<struct<i:int,v:double>>")),
                        lambda e: F.concat(e["i"].cast("string"), F.lit(":"), num_text(e["v"])))
    line = F.when(head.isNotNull(), F.array_join(F.concat(F.array(head), feats), " "))
    return j.select(*keys, line.alias("line"))


def _once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns that are worked out once a row. Spark copies a
    select's expressions into every filter and select on it; a generator's
    output it takes as it is."""
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(made)))


def parse_svmlight(lines: DataFrame, line_col: str = "value", id_col: str = "row_id"):
    """Parse text lines into (rows, entries, rejects).

    rows: (row_id, label, qid) with qid 0 when absent; entries: (row_id,
    idx, value); rejects: lines that are empty or have a bad token or
    non-ascending indices, with a reason. ``row_id`` comes from
    ``monotonically_increasing_id`` on the file scan (stable for a given
    input split, so recomputation sees the same ids) unless present.
    """
    df = lines if id_col in lines.columns else lines.withColumn(id_col, F.monotonically_increasing_id())
    toks = F.filter(F.split(F.trim(F.col(line_col)), r"[ \t]+"), lambda t: F.length(t) > 0)
    df = _once(df, [id_col], _tok=toks)
    second = F.try_element_at("_tok", F.lit(2))
    has_qid = F.coalesce(second.startswith("qid:"), F.lit(False))
    df = _once(
        df, [id_col],
        label=F.try_element_at("_tok", F.lit(1)).try_cast("double"),
        qid=F.when(has_qid, F.substring(second, 5, 1 << 20).try_cast("int")).otherwise(F.lit(0)),
        _feats=F.slice("_tok", F.when(has_qid, 3).otherwise(2), F.greatest(F.size("_tok"), F.lit(0))),
        _n=F.size("_tok"),
    )
    parsed = _once(df, [id_col, "label", "qid", "_n"], _f=F.transform("_feats", lambda t: F.struct(
        (F.substring_index(t, ":", 1)).try_cast("int").alias("idx"),
        (F.substring_index(t, ":", -1)).try_cast("double").alias("value"),
        (F.size(F.split(t, ":")) == 2).alias("ok"),
    )))
    idxs = F.col("_f")["idx"]
    ascending = F.sort_array(F.array_distinct(idxs)) == idxs  # from 1, as smaller ones are bad tokens
    bad_tok = F.exists("_f", lambda s: (~s["ok"]) | s["idx"].isNull() | s["value"].isNull() | (s["idx"] < 1))
    reason = (
        F.when(F.col("_n") == 0, "empty line")
        .when(F.col("label").isNull(), "bad label")
        .when(F.col("qid").isNull(), "bad qid")
        .when(bad_tok, "bad feature token")
        .when(~ascending, "indices not ascending")
    )
    checked = _once(parsed, [id_col, "label", "qid", "_f"], _reason=reason)
    rejects = checked.where(F.col("_reason").isNotNull()).select(id_col, F.col("_reason").alias("reason"))
    good = checked.where(F.col("_reason").isNull())
    rows = good.select(id_col, "label", "qid")
    entries = good.select(id_col, F.explode("_f").alias("f")).select(id_col, "f.idx", "f.value")
    return rows, entries, rejects


def drop_feature(entries: DataFrame, k: int) -> DataFrame:
    """B8 (-r k): remove feature k and shift higher indices down by one."""
    i = F.col("idx")
    return entries.where(i != k).withColumn("idx", F.when(i > k, i - 1).otherwise(i))


def scale_factors(entries: DataFrame, rows: DataFrame, lower: float = -1.0, upper: float = 1.0) -> DataFrame:
    """K9 fit: per feature min / max over the present values, with 0
    included when some row lacks the feature. Returns (idx, fmin, fmax,
    lower, upper), the table svm-scale saves."""
    n_rows = rows.count()
    per = entries.groupBy("idx").agg(F.min("value").alias("_mn"), F.max("value").alias("_mx"),
                                     F.count(F.lit(1)).alias("_c"))
    missing = F.col("_c") < n_rows
    return per.select(
        "idx",
        F.when(missing, F.least("_mn", F.lit(0.0))).otherwise(F.col("_mn")).alias("fmin"),
        F.when(missing, F.greatest("_mx", F.lit(0.0))).otherwise(F.col("_mx")).alias("fmax"),
        F.lit(float(lower)).alias("lower"), F.lit(float(upper)).alias("upper"),
    )


def _scaled(v: Column) -> Column:
    lo, hi, a, b = F.col("fmin"), F.col("fmax"), F.col("lower"), F.col("upper")
    return (
        F.when(v == lo, a).when(v == hi, b).otherwise(a + (b - a) * (v - lo) / (hi - lo))
    )


def save_factors(factors: DataFrame, path: str) -> None:
    """K9: the factor table as files, for scaling other rows the same way."""
    factors.select("idx", "fmin", "fmax", "lower", "upper").write.parquet(path)


def load_factors(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scale_sparse(entries: DataFrame, factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K9 apply, sparse in and sparse out: scaled entries and the default of
    each feature, (idx, value), that rows without the entry have. What 0
    becomes is the default, so absent entries need no rows; entries equal to
    their default are left out. Single-valued features are dropped, as are
    entries of features without factors."""
    f = factors.where(F.col("fmax") != F.col("fmin")).withColumn("_default", _scaled(F.lit(0.0)))
    defaults = f.select("idx", F.col("_default").alias("value"))
    scaled = entries.join(maybe_broadcast(f), "idx", "inner").select(
        *[c for c in entries.columns if c != "value"], _scaled(F.col("value")).alias("value"), "_default")
    return scaled.where(F.col("value") != F.col("_default")).drop("_default"), defaults


def apply_scale(entries: DataFrame, rows: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """K9 apply with every value written, as the text format needs it: scaled
    entries and, in rows that lack a feature, its default; zeros are not
    written. Returns long entries (keys, idx, value)."""
    f = maybe_broadcast(factors.where(F.col("fmax") != F.col("fmin")))
    present = entries.join(f, "idx", "inner").select(*keys, "idx", _scaled(F.col("value")).alias("value"))
    _, defaults = scale_sparse(entries, factors)
    # one row with a value for each feature that is not 0 where it is absent
    other = defaults.where(F.col("value") != 0).agg(F.collect_list(F.struct("idx", "value")).alias("_all"))
    lacking = rows.select(*keys, F.explode(other.select("_all").scalar()).alias("_e")).select(*keys, "_e.idx", "_e.value")
    filled = lacking.join(entries.select(*keys, "idx"), [*keys, "idx"], "left_anti")
    return present.where(F.col("value") != 0).unionByName(filled)


def scale_labels(rows: DataFrame, label: str = "label", lower: float = -1.0, upper: float = 1.0) -> DataFrame:
    """K9 optional target scaling (min -> lower, max -> upper, linear between)."""
    stats = rows.agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    lo, hi = stats.select("_lo").scalar(), stats.select("_hi").scalar()
    y = F.col(label)
    out = F.when(y == lo, F.lit(lower)).when(y == hi, F.lit(upper)).otherwise(
        F.lit(lower) + (upper - lower) * (y - lo) / (hi - lo))
    return rows.withColumn(label, out)


def linear_scores(entries: DataFrame, weights: DataFrame, keys: list[str], rows: DataFrame | None = None) -> DataFrame:
    """M7: decision value z = sum_k w_k x_k per row; indices the model was
    not trained on are ignored; rows without entries score 0 when
    ``rows`` is given. ``weights`` = (idx, w), a p-row table."""
    w = maybe_broadcast(weights.select("idx", "w"))
    z = entries.join(w, "idx", "inner").groupBy(*keys).agg(F.sum(F.col("value") * F.col("w")).alias("z"))
    if rows is not None:
        z = rows.select(*keys).join(z, keys, "left").select(*keys, F.coalesce("z", F.lit(0.0)).alias("z"))
    return z


def linear_probability(z: Column) -> Column:
    """M7 for logistic models: 1 / (1 + exp(-z))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def multiclass_scores(entries: DataFrame, weights: DataFrame, keys: list[str], rows: DataFrame) -> DataFrame:
    """M7 with one weight vector a class, ``weights`` = (class, idx, w): for
    each row and class the decision value z, the probability p (logistic
    values that sum to 1 over the classes) and whether the class is the
    predicted one, that of the greatest z (ties: the least class). Rows
    without entries have z 0 everywhere. Indices without weight are ignored."""
    # the classes of a model are few: each is one sum over a row's entries,
    # which stay as they are, not one row for each class; the weights are
    # read three times and made once
    kind = weights.schema["class"].dataType
    known = materialize(weights.where(F.col("class").isNotNull()), "class_weights")
    classes = [F.lit(r["class"]).cast(kind) for r in known.select("class").distinct().orderBy("class").collect()]
    per_class = [F.sum(F.when(F.col("class") == c, F.col("w"))).alias(f"_w{k}") for k, c in enumerate(classes)]
    by_idx = maybe_broadcast(known.groupBy("idx").agg(F.count(F.lit(1)).alias("_known"), *per_class))
    sums = [F.sum(F.col("value") * F.col(f"_w{k}")).alias(f"_z{k}") for k in range(len(classes))]
    found = entries.join(by_idx, "idx").groupBy(*keys).agg(F.count(F.lit(1)).alias("_terms"), *sums)
    every = rows.select(*keys).join(found, keys, "left")
    z = [F.col(f"_z{k}") for k in range(len(classes))]
    every = every.select(*keys, *[F.coalesce(v, F.lit(0.0)).alias(f"_z{k}") for k, v in enumerate(z)])
    best = F.greatest(*z) if len(z) > 1 else z[0] if z else F.lit(0.0)
    total = sum((linear_probability(v) for v in z), F.lit(0.0))
    winner = F.coalesce(*[F.when(v == best, c) for c, v in zip(classes, z)], F.lit(None).cast(kind))
    every = _once(every, every.columns, _t=total, _win=winner)
    parts = [F.struct(c.alias("class"), v.alias("z"), (linear_probability(v) / F.col("_t")).alias("p"),
                      (c == F.col("_win")).alias("predicted")) for c, v in zip(classes, z)]
    shape = f"array<struct<class:{kind.simpleString()},z:double,p:double,predicted:boolean>>"
    return every.select(*keys, F.inline(F.array(*parts).cast(shape)))
