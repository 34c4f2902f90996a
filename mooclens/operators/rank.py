"""Learning-to-rank building blocks (N1-N4) and ranking metrics (L3, L4).

No operator here pairs rows: pair counts are 2D dominance counts (higher
label and lower score) computed by sweeps. Each row enters the cells that
hold its label level, and probes the cells that make up the levels beyond
it; a running sum over (qid, cell) in score order gives, at each probe, the
number (and score sum) of rows that dominate it. Cells are ranges of levels
of length 1, 2, 4..., so a row enters and probes about log2(levels) cells,
with real-valued labels too; where a query has few levels, one cell for
each level to be compared with is less. The running sums use the skew-safe
scans of ``mooclens.operators.prefix`` so one huge query is split.

Where no query is huge (``queries_are_small``), rows are shuffled once, by
query, and ``swept`` counts both directions over whole queries of a sorted
partition, some hundred thousand rows at a time, with the same cells: rows
keep their columns and nothing is joined back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooclens.operators.prefix import _join_same, prefix_sums, row_numbers
from mooclens.operators.sizing import maybe_broadcast
from mooclens.session import HOT_ROWS_KEY, conf_int, materialize


def queries_are_small(df: DataFrame, qid: str = "qid") -> bool:
    """One size check for every sweep of a query-keyed operator: a sweep
    group holds at most two events per row of its query, so if twice the
    largest query fits under the hot-group threshold no group is hot."""
    biggest = df.groupBy(qid).count().agg(F.max("count")).first()[0] or 0
    return 2 * biggest <= conf_int(df.sparkSession, HOT_ROWS_KEY)


def label_levels(df: DataFrame, qid: str = "qid", label: str = "label", out: str = "level",
                 small: bool = False, broadcast: bool = False) -> DataFrame:
    """Dense label levels 1..k inside each query (ascending label; rows
    without a label are the lowest level, rows without a query are one).
    ``broadcast`` leaves rows where they lie if the labels are few."""
    distinct = df.select(qid, label).distinct()
    levels = row_numbers(distinct, [qid], [label], out, small=small)
    levels = levels.select(qid, label, F.col(out).cast("int").alias(out))
    return _join_same(df, maybe_broadcast(levels) if broadcast else levels, [qid, label], "inner")


def query_sizes(df: DataFrame, qid: str = "qid") -> DataFrame:
    """Rows per query."""
    return df.groupBy(qid).agg(F.count(F.lit(1)).alias("n"))


#: Rows that ``swept`` works through at once; a query's rows stay together.
SWEEP_ROWS = 1 << 18


def _runs(ordered: list[np.ndarray]) -> np.ndarray:
    """Number of the run of equal rows of sorted arrays that each row is in."""
    new = np.zeros(len(ordered[0]), bool)
    for x in ordered:
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def dense_levels(group: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Levels 1..k of ascending labels inside each group (ascending numbers);
    NaN is the lowest."""
    label = np.where(np.isnan(label), -np.inf, label)
    order = np.lexsort((label, group))
    run = _runs([group[order], label[order]])
    first = np.zeros(group[-1] + 1 if len(group) else 0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])) if len(group) else []
    first[group[order][heads]] = run[heads]
    out = np.empty(len(group), np.int64)
    out[order] = run - first[group[order]] + 1
    return out


#: Up to so many label levels a query has one cell for each.
FEW_LEVELS = 8
#: Queries of up to so many rows are swept row against row.
PAIR_ROWS = 16


def dominance(group: np.ndarray, level: np.ndarray, key: np.ndarray, value: np.ndarray, margin: float,
              direction: str) -> tuple[np.ndarray, np.ndarray]:
    """For each row: count and sum of ``value`` over rows of its group with a
    higher level and a key below its own + margin ('plus'), or a lower level
    and a key above its own - margin ('minus'). A row of level l looks at the
    neighbour of each of its cells l div 2^b that lies beyond it in the same
    pair; together these hold every level beyond l once."""
    n, above = len(group), direction == "plus"
    own = key if above else -key
    count, total = np.zeros(n, np.int64), np.zeros(n)
    if n and (group[1:] >= group[:-1]).all() and not np.isnan(own).any():
        start = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        size = np.diff(start, append=n)
        few = size <= PAIR_ROWS
        if few.any():
            for s in np.unique(size[few]):  # queries of one size side by side
                at = start[size == s][:, None] + np.arange(s)
                l, z, v, reach = level[at], own[at], value[at], own[at] + margin
                seen, held = np.zeros(at.shape, np.int64), np.zeros(at.shape)
                for j in range(s):
                    hit = (l[:, j:j + 1] > l if above else l[:, j:j + 1] < l) & (z[:, j:j + 1] < reach)
                    seen += hit
                    held += np.where(hit, v[:, j:j + 1], 0.0)
                count[at], total[at] = seen, held
            rest = np.repeat(~few, size)
            if rest.any():
                count[rest], total[rest] = dominance(group[rest], level[rest], key[rest], value[rest], margin, direction)
            return count, total
    if n and level.max() <= FEW_LEVELS and (group == group[0]).all():
        # one group: the rows beyond each level, sorted by themselves
        for at in np.unique(level):
            asks = np.flatnonzero(level == at)
            held = np.flatnonzero(level > at if above else level < at)
            held = held[np.argsort(own[held], kind="stable")]
            sums = np.concatenate([[0], np.cumsum(value[held], dtype=np.longdouble)])
            count[asks] = seen = np.searchsorted(own[held], own[asks] + margin)
            total[asks] = sums[seen]
        return count, total
    for b in range(int(level.max(initial=0)).bit_length()):
        cell = level >> b
        odd = cell & 1 == 1
        asks = np.flatnonzero(~odd if above else odd)
        held = np.flatnonzero(odd if above else ~odd)
        who = np.concatenate([held, asks])
        is_ask = np.arange(len(who)) >= len(held)
        at = np.where(is_ask, cell[who] + (1 if above else -1), cell[who])
        place = np.where(is_ask, own[who] + margin, own[who])
        # at equal places the asking row comes first: the bound is strict
        order = np.lexsort((~is_ask, place, at, group[who]))
        run = _runs([group[who][order], at[order]])
        seen = np.cumsum(~is_ask[order])
        # extended precision: differences of sums over the whole chunk
        sums = np.cumsum(np.where(is_ask, 0.0, value[who])[order], dtype=np.longdouble)
        start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))[run] if len(run) else run
        before = np.where(start > 0, seen[start - 1], 0)
        before_sum = np.where(start > 0, sums[start - 1], 0)
        mine = np.flatnonzero(is_ask[order])
        row = who[order][mine]
        count[row] += seen[mine] - before[mine]
        total[row] += (sums[mine] - before_sum[mine]).astype(float)
    return count, total


def _whole_queries(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole queries of a sorted partition, and each row's query."""
    held, rows, enough = [], 0, SWEEP_ROWS

    def numbered(table: pa.Table) -> np.ndarray:
        codes = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in keys]
        return _runs([c.indices.to_numpy(zero_copy_only=False) for c in codes])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= enough:
            table = pa.Table.from_batches(held)
            group = numbered(table)
            cut = int(np.searchsorted(group, group[-1]))  # the last query may go on
            if cut:
                yield table.slice(0, cut), group[:cut]
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
            enough = max(SWEEP_ROWS, 2 * rows)  # a great query is not gone through anew for each batch
    if rows:
        table = pa.Table.from_batches(held)
        yield table, numbered(table)


def _floats(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).cast(pa.float64()).combine_chunks().to_numpy(zero_copy_only=False)


def swept(df: DataFrame, keys: list[str], key: str, value: str, margin: float, level: str | None = None,
          label: str | None = None, directions=("plus", "minus")) -> DataFrame:
    """``df`` with cnt_<direction> and sum_<direction> of ``dominance`` for
    every row inside its group of ``keys``; levels are given, or made from
    ``label``. Groups must be small enough for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_queries(batches, keys):
            at = dense_levels(group, _floats(table, label)) if level is None else _floats(table, level).astype(np.int64)
            for d in directions:
                count, total = dominance(group, at, _floats(table, key), _floats(table, value), margin, d)
                table = table.append_column(f"cnt_{d}", pa.array(count)).append_column(f"sum_{d}", pa.array(total))
            yield from table.combine_chunks().to_batches()

    extra = ", ".join(f"cnt_{d} long, sum_{d} double" for d in directions)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{fields}, {extra}")


def _cells(level: Column, levels: Column, direction: str) -> tuple[Column, Column]:
    """Cells that a row of ``level`` enters, and cells that it probes, of a
    query with ``levels`` levels: arrays of (size, number). Each probed set
    covers the levels above ('plus') or below ('minus') exactly once."""
    def cell(size, number):
        return F.struct(size.cast("int").alias("size"), number.cast("long").alias("number"))

    above = direction == "plus"
    one = F.lit(-1)
    # entered for each level that looks at this one
    near = F.when(level > 1, F.sequence(F.lit(1), level - 1)) if above else F.when(level < levels, F.sequence(level + 1, levels))
    enters_few = F.transform(F.coalesce(near, F.array().cast("array<int>")), lambda t: cell(one, t))
    probes_few = F.array(cell(one, level))
    # cell (b, n) holds the levels l with l div 2^b = n
    sizes = F.sequence(F.lit(0), F.ceil(F.log2(levels + 1)).cast("int"))
    number = lambda b: F.floor(level / F.pow(F.lit(2.0), b))
    enters = F.transform(sizes, lambda b: cell(b, number(b)))
    # the neighbour in the same pair lies wholly beyond the row's own half
    odd = lambda b: number(b) % 2 == 1
    beside = F.filter(sizes, lambda b: ~odd(b) if above else odd(b))
    probes = F.transform(beside, lambda b: cell(b, number(b) + (1 if above else -1)))
    few = levels <= FEW_LEVELS
    return F.when(few, enters_few).otherwise(enters), F.when(few, probes_few).otherwise(probes)


def _dominance(df: DataFrame, qid: str, rid: str, key: str, value: str | None, margin: float,
               direction: str, small: bool = False) -> DataFrame:
    """For each row i: count (and sum of ``value``) over rows j of the same
    query with a higher level and key_j < key_i + margin
    (direction='plus'), or a lower level and key_j > key_i - margin
    (direction='minus'). Needs columns qid, rid, level, key."""
    val = F.col(value).cast("double") if value else F.lit(0.0)
    sign = 1.0 if direction == "plus" else -1.0
    own = F.lit(sign) * F.col(key).cast("double")
    levels = df.groupBy(qid).agg(F.max("level").alias("_kmax"))
    enters, probes = _cells(F.col("level"), F.col("_kmax"), direction)
    base = _join_same(df, levels, [qid], "inner")
    data = base.select(
        qid, F.explode(enters).alias("_t"), own.alias("_key"), F.lit(1).alias("_kind"),
        F.lit(None).cast(df.schema[rid].dataType).alias(rid), F.lit(1).cast("long").alias("_w"), val.alias("_v"),
    )
    probe = base.select(
        qid, F.explode(probes).alias("_t"), (own + F.lit(margin)).alias("_key"), F.lit(0).alias("_kind"),
        F.col(rid), F.lit(0).cast("long").alias("_w"), F.lit(0.0).alias("_v"),
    )
    # rows in one place of a cell count together: a probe follows the sums of
    # all smaller keys, so equal keys need no order among themselves
    data = data.groupBy(qid, "_t", "_key", "_kind").agg(
        F.lit(None).cast(df.schema[rid].dataType).alias(rid), F.sum("_w").alias("_w"), F.sum("_v").alias("_v"))
    events = data.unionByName(probe)
    swept = prefix_sums(events, [qid, "_t"], ["_key", "_kind"],
                        {"_cnt": F.col("_w"), "_sum": F.col("_v")}, inclusive=True, small=small)
    return swept.where(F.col("_kind") == 0).groupBy(qid, rid).agg(F.sum("_cnt").alias("_cnt"), F.sum("_sum").alias("_sum"))


def margin_violations(df: DataFrame, z: str, qid: str = "qid", rid: str = "row_id", margin: float = 1.0,
                      value: str | None = None, small: bool | None = None) -> DataFrame:
    """Per row, l_plus / gamma_plus over rows of the same query with a
    higher label level and z_j < z_i + margin, and l_minus / gamma_minus
    over lower levels with z_j > z_i - margin (both strict). gamma sums
    ``value`` (default z itself). Input needs qid, rid, level and z;
    ``small`` states that no query is huge (True), or that one may be (False)."""
    value = value or z
    small = queries_are_small(df, qid) if small is None else small
    if small:
        names = {f"{a}_{d}": f"{b}_{d}" for d in ("plus", "minus") for a, b in (("cnt", "l"), ("sum", "gamma"))}
        return swept(df, [qid], z, value, margin, level="level").withColumnsRenamed(names)
    plus = _dominance(df, qid, rid, z, value, margin, "plus", small).select(
        qid, rid, F.col("_cnt").alias("l_plus"), F.col("_sum").alias("gamma_plus"))
    minus = _dominance(df, qid, rid, z, value, margin, "minus", small).select(
        qid, rid, F.col("_cnt").alias("l_minus"), F.col("_sum").alias("gamma_minus"))
    return _join_same(_join_same(df, plus, [qid, rid], "inner"), minus, [qid, rid], "inner")


def _few_level_pairs(df: DataFrame, levels: DataFrame, most: int, score: str, qid: str, label: str) -> DataFrame:
    """``pair_counts`` where no query has more than a few levels: a row for
    each score holds how many rows of each level have it, and running sums of
    these numbers give the higher levels' rows below. ``levels``: (qid, label,
    level, _c), a row for each label of a query with its rows."""
    level = levels.select(qid, label, F.col("level").cast("int").alias("_l"))
    found = df.groupBy(qid, F.col(score).cast("double").alias("_z"), label).agg(F.count(F.lit(1)).alias("_c"))
    found = _join_same(found, maybe_broadcast(level), [qid, label], "inner")
    at = found.groupBy(qid, "_z").agg(*[F.sum(F.when(F.col("_l") == k, F.col("_c")).otherwise(F.lit(0))).alias(f"_n{k}") for k in range(1, most + 1)])
    at = prefix_sums(materialize(at, "score_levels"), [qid], ["_z"], {f"_b{k}": F.col(f"_n{k}") for k in range(2, most + 1)}, inclusive=False)
    crossed = F.lit(0).cast("long")
    for k in range(1, most):
        above = F.col(f"_b{k + 1}")
        for j in range(k + 2, most + 1):
            above = above + F.col(f"_b{j}")
        crossed = crossed + F.col(f"_n{k}") * above
    nd = at.groupBy(qid).agg(F.sum(crossed).alias("n_discordant"))
    return _join_same(_pair_totals(levels, qid), nd, [qid], "left").select(qid, "n_pairs", F.coalesce("n_discordant", F.lit(0)).alias("n_discordant"))


def _pair_totals(levels: DataFrame, qid: str) -> DataFrame:
    """(qid, n_pairs) from the rows ``_c`` of each level."""
    # exact beyond 64 bits: a query of 4 * 10^9 rows has 10^19 pairs
    c = F.col("_c").cast("decimal(19,0)")
    tot = levels.groupBy(qid).agg(F.sum(c).alias("_n"), F.sum(c * c).cast("decimal(38,0)").alias("_same"))
    twice = (F.col("_n").cast("decimal(19,0)") * F.col("_n").cast("decimal(19,0)")).cast("decimal(38,0)") - F.col("_same")
    return tot.select(qid, (twice.cast("decimal(38,0)") / 2).cast("long").alias("n_pairs"))


def _gathered(df: DataFrame, qid: str, *order: str, whole: bool) -> DataFrame:
    """``df`` in order of ``qid``, then ``order``, each query in one partition;
    ``whole`` states that it lies in one already."""
    return (df if whole else df.repartition(qid)).sortWithinPartitions(qid, *order)


def _heads(group: np.ndarray) -> np.ndarray:
    """Where the runs of ``_runs`` begin."""
    return np.flatnonzero(np.diff(group, prepend=-1))


def _per_query(qid: pa.ChunkedArray, group: np.ndarray, **found: np.ndarray) -> list[pa.RecordBatch]:
    """A row (q, found) for each run of ``group``."""
    columns = {"q": qid.take(pa.array(_heads(group)))} | {name: pa.array(x) for name, x in found.items()}
    return pa.table(columns).combine_chunks().to_batches()


def pair_counts(df: DataFrame, score: str = "score", qid: str = "qid", rid: str = "row_id",
                label: str = "label", whole: bool = False) -> DataFrame:
    """Per query, pairs with different labels and discordant pairs
    (the higher label has a strictly lower score; score ties are
    concordant). Returns (qid, n_pairs, n_discordant). ``whole`` states that
    no query is huge and each lies in one partition: no row is shuffled."""
    small = whole or queries_are_small(df, qid)
    if small:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, group in _whole_queries(batches, [qid]):
                y, at = _floats(table, "_y"), _heads(group)
                count, _ = dominance(group, dense_levels(group, y), _floats(table, "_z"), np.zeros(len(y)), 0.0, "plus")
                code = table.column("_y").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                own, same = np.unique(group * (int(code.max()) + 1) + code, return_counts=True)
                same = np.bincount(own // (int(code.max()) + 1), same.astype(float) ** 2).astype(np.int64)
                n_pairs = (np.diff(at, append=len(y)) ** 2 - same) // 2
                yield from _per_query(table.column(qid), group, n_pairs=n_pairs, n_discordant=np.add.reduceat(count, at))

        # at most (4 * 10^6)^2 pairs a query here: exact in doubles
        rows = df.select(qid, (F.col(label).cast("double") + 0.0).alias("_y"), F.col(score).cast("double").alias("_z"))
        kind = df.schema[qid].dataType.simpleString()
        return _gathered(rows, qid, whole=whole).mapInArrow(run, f"q {kind}, n_pairs long, n_discordant long").withColumnRenamed("q", qid)
    labels = df.groupBy(qid, label).agg(F.count(F.lit(1)).alias("_c"))
    levels = materialize(row_numbers(labels, [qid], [label], "level"), "label_levels")
    most = levels.agg(F.max("level")).first()[0] or 0
    if most <= FEW_LEVELS:
        return _few_level_pairs(df, levels, int(most), score, qid, label)
    lv = label_levels(df, qid, label, small=small)
    disc = _dominance(lv, qid, rid, score, None, 0.0, "plus", small)
    nd = disc.groupBy(qid).agg(F.sum("_cnt").alias("n_discordant"))
    per_label = lv.groupBy(qid, "level").agg(F.count(F.lit(1)).alias("_c"))
    tot = _pair_totals(per_label, qid)
    return _join_same(tot, nd, [qid], "left").select(qid, "n_pairs", F.coalesce("n_discordant", F.lit(0)).alias("n_discordant"))


def pairwise_accuracy(df: DataFrame, score: str = "score", qid: str = "qid", rid: str = "row_id",
                      label: str = "label", whole: bool = False) -> DataFrame:
    """L3: overall = 1 - total discordant / total pairs over all queries;
    also the mean of per-query accuracies over queries with pairs."""
    pc = pair_counts(df, score, qid, rid, label, whole)
    with_pairs = pc.where(F.col("n_pairs") > 0)
    return with_pairs.agg(
        (F.lit(1.0) - F.sum("n_discordant") / F.sum("n_pairs")).alias("pairwise_accuracy"),
        F.avg(F.lit(1.0) - F.col("n_discordant") / F.col("n_pairs")).alias("mean_query_accuracy"),
        F.sum("n_pairs").alias("n_pairs"),
        F.sum("n_discordant").alias("n_discordant"),
    )


def _discount(pos):
    """1 at positions 1 and 2, then 1 / log2(position)."""
    return F.when(pos <= 2, F.lit(1.0)).otherwise(F.lit(math.log(2.0)) / F.log(pos.cast("double")))


def _gain(label: str) -> Column:
    return F.pow(F.lit(2.0), F.col(label).cast("double")) - 1


def _summed(placed: DataFrame, qid: str, label: str, out: str, small: bool) -> DataFrame:
    """Discounted gains up to each position ``_pos``."""
    return prefix_sums(placed, [qid], ["_pos"], {out: _gain(label) * _discount(F.col("_pos"))}, small=small).select(qid, "_pos", out)


def _ideal_positions(df: DataFrame, qid: str, rid: str, label: str, small: bool) -> DataFrame:
    """Positions by falling label. Where a label's rows begin follows from
    the counts of the labels; inside a label any order will do, so its rows
    are numbered by row id, which a label that most rows share splits by."""
    counts = df.groupBy(qid, label).agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", -F.col(label).cast("double"))
    begins = prefix_sums(counts, [qid], ["_o"], {"_before": F.col("_n")}, inclusive=False, small=small)
    inside = row_numbers(df.select(qid, rid, label), [qid, label], [rid], "_inside", small=small)
    placed = _join_same(inside, begins.select(qid, label, "_before"), [qid, label], "inner")
    return placed.withColumn("_pos", F.col("_before") + F.col("_inside"))


def _ndcg(group: np.ndarray, label: np.ndarray, known: np.ndarray) -> np.ndarray:
    """NDCG of each run of ``group``, its rows in order of falling score. A
    row without a label (not ``known``) gains nothing and stands first in the
    ideal order."""
    start = _heads(group)
    size = np.diff(start, append=len(group))
    gain = np.where(known, np.exp2(label) - 1, 0.0)
    best = gain[np.lexsort((-label, known, group))]
    out = np.empty(len(start))
    for s in np.unique(size):  # queries of one size side by side
        at = start[size == s][:, None] + np.arange(s)
        pos = np.arange(1.0, s + 1)
        discount = np.where(pos <= 2, 1.0, math.log(2.0) / np.log(np.maximum(pos, 2.0)))
        actual, ideal = (np.cumsum(x[at] * discount, axis=1) for x in (gain, best))
        counts, top = ideal != 0, ideal[:, 0]
        share = np.divide(actual, ideal, out=np.zeros_like(ideal), where=counts)
        mean = share.sum(axis=1) / np.maximum(counts.sum(axis=1), 1)
        out[size == s] = np.where((top > 0) | np.isnan(top), mean, 0.0)
    return out


def ndcg_per_query(df: DataFrame, score: str = "score", qid: str = "qid", rid: str = "row_id",
                   label: str = "label", whole: bool = False) -> DataFrame:
    """L4 per query: mean over all cut-offs k of DCG@k / IDCG@k, gain
    2^label - 1; 0 when the best label has gain 0. Score ties are broken
    by row id (ascending). Where no query is huge, rows are shuffled once, by
    query; ``whole`` states that, and that each lies in one partition: no row
    is shuffled."""
    small = whole or queries_are_small(df, qid)
    by_score = df.select(qid, rid, label, (-F.col(score).cast("double")).alias("_o"))
    if small:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, group in _whole_queries(batches, [qid]):
                known = table.column("_y").is_valid().to_numpy()
                found = _ndcg(group, np.where(known, _floats(table, "_y"), 0.0), known)
                yield from _per_query(table.column(qid), group, ndcg=found)

        kind = df.schema[qid].dataType.simpleString()
        rows = _gathered(by_score, qid, "_o", rid, whole=whole).select(qid, F.col(label).cast("double").alias("_y"))
        return rows.mapInArrow(run, f"q {kind}, ndcg double").withColumnRenamed("q", qid)
    actual = _summed(row_numbers(by_score, [qid], ["_o", rid], "_pos", small=small), qid, label, "_dcg", small)
    ideal = _summed(_ideal_positions(df, qid, rid, label, small), qid, label, "_idcg", small)
    j = _join_same(actual, ideal, [qid, "_pos"], "inner")
    per = j.groupBy(qid).agg(
        F.avg(F.try_divide(F.col("_dcg"), F.col("_idcg"))).alias("_r"),
        F.max(F.when(F.col("_pos") == 1, F.col("_idcg"))).alias("_top"),
    )
    return per.select(qid, F.when(F.col("_top") > 0, F.col("_r")).otherwise(F.lit(0.0)).alias("ndcg"))


def mean_ndcg(df: DataFrame, **kw) -> DataFrame:
    """L4: mean NDCG over queries."""
    return ndcg_per_query(df, **kw).agg(F.avg("ndcg").alias("mean_ndcg"), F.count(F.lit(1)).alias("n_queries"))
