"""Pairwise squared-hinge ranking SVM (N5), its use for grid search over C
(M11), query-level cross-validation (L9) and scoring.

Objective (no bias):  w'w/2 + C * sum over pairs (i, j) of one query with
label_i > label_j of max(0, 1 - w'(x_i - x_j))^2.

Rows stay on the executors; the driver holds only w (p numbers). Every
objective + gradient evaluation and every Hessian-vector product is one
Spark pass: the decision values come from blocks of the matrix, the pair terms
from the pair-free dominance sweeps of ``mooclens.operators.rank``
(counts l+/l- and sums over the violating sets), and X^T v is summed up
where the blocks lie. The outer loop is an inexact Newton method with a
backtracking line search, stopping when ||grad|| <= eps * ||grad at w = 0||.
"""

from __future__ import annotations

import itertools
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mooclens.operators.prefix import _join_same, row_numbers
from mooclens.operators.rank import SWEEP_ROWS, _dominance, _runs, _whole_queries, dominance, label_levels
from mooclens.session import HOT_ROWS_KEY, conf_int, ensure_checkpoint_dir, materialize


def _dot(cols: list[str], w) -> Column:
    expr = F.lit(0.0)
    for c, v in zip(cols, w):
        if v != 0.0:
            expr = expr + F.col(c).cast("double") * F.lit(float(v))
    return expr


def newton_search(n: int, eps: float, max_iter: int, free: np.ndarray):
    """Minimise a smooth convex function by inexact Newton steps with a
    backtracking line search, as a generator: it yields ("value", w) and is
    sent (value, gradient), or ("curvature", w, s) and is sent the Hessian
    at w times s; it returns w. Coordinates with ``free`` 0 stay at 0.

    Step lengths halve until the value falls by a share of what the slope
    promises (Armijo). Only accepted points are ever kept, so gradient and
    curvature always belong to the same w. Stops when the gradient has
    shrunk to ``eps`` of the one at 0, or no step improves the value.
    """
    w = np.zeros(n)
    value, gradient = yield "value", w
    gradient = gradient * free
    first = now = np.linalg.norm(gradient)
    for _ in range(max_iter):
        if now <= eps * first:
            break
        # the closer to the optimum, the more exactly the step is solved for
        step = yield from _newton_step(w, gradient, free, now * min(0.1, math.sqrt(now / first)))
        slope, length = gradient @ step, 1.0
        while length > 1e-10:
            there = w + length * step
            v, g = yield "value", there
            if v <= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        w, value, gradient = there, v, g * free
        now = np.linalg.norm(gradient)
    return w


def _newton_step(w: np.ndarray, gradient: np.ndarray, free: np.ndarray, enough: float):
    """Conjugate gradients for (Hessian at w) step = -gradient, until the
    residual's norm is at most ``enough``."""
    step, left, along = np.zeros_like(w), -gradient, -gradient
    for _ in range(10 * len(w)):
        bent = (yield "curvature", w, along) * free
        size = left @ left
        gain = size / (along @ bent)
        step = step + gain * along
        left = left - gain * bent
        if np.linalg.norm(left) <= enough:
            break
        along = left + (left @ left / size) * along
    return step


#: Rows of a block of the matrix.
BLOCK_ROWS = 4096
#: Where no query has more rows, blocks hold whole queries.
WHOLE_ROWS = 1 << 16


class RankSVMBatch:
    """Evaluates f/grad and Hessian-vector products of the pairwise loss for
    many candidates (each with its own C and weights) in one Spark job.

    The matrix is stored once in blocks of rows, bucketed by block. A pass
    multiplies each block by the candidates' weights where it lies, shuffles
    only (candidate, query, level, score) rows for the sweeps, and brings each
    row's slope back to its block, where X^T u is summed up. No candidate
    copies a row's features. Where all queries are of ordinary size, a block
    holds whole queries and a pass needs no shuffle: sweeps and sums are done
    where the block lies. Greater queries that still fit a task go to their
    sweeps in packs, one for each candidate, block and query; only a query
    beyond that is swept row by row.

    With ``fold``, a column that is the same in a whole query, where all
    queries are of ordinary size, a block holds queries of one fold, and a
    candidate passes over the blocks of the fold that ``left_out`` names for
    it: the fits of all folds read one matrix, which ``scored`` scores."""

    def __init__(self, df: DataFrame, features: list[str], qid: str = "qid", rid: str = "row_id",
                 label: str = "label", fold: str | None = None, biggest: int | None = None):
        self.features, self.qid, self.rid, self.label, self.passes = list(features), qid, rid, label, 0
        self.fold, self.left_out, self.kinds = fold, {}, {c: df.schema[c].dataType.simpleString() for c in (qid, rid, label)}
        spark = df.sparkSession
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x")
        # A sweep group (candidate, query) holds as many rows as the query:
        # one size check decides for all sweeps.
        n = None
        if biggest is None:
            biggest, n = df.groupBy(qid).count().agg(F.max("count"), F.sum("count")).first()
        biggest = biggest or 0
        self.groups = max(1, (n or 0) // SWEEP_ROWS)
        self.small = 2 * biggest <= conf_int(spark, HOT_ROWS_KEY)
        self.whole = self.small and biggest <= WHOLE_ROWS
        schema = _blocks_schema(df.schema[qid])
        # Cut the lineage once: every iteration re-reads this table.
        if not self.whole:
            if fold:
                raise ValueError("folds of a matrix need queries that fit a block")
            lv = label_levels(df.select(qid, rid, label, *features), qid, label, broadcast=True)
            rows = lv.select(F.col(qid).alias("q"), "level", x).sortWithinPartitions("q")
            self.base = self._stored(rows.mapInArrow(_blocks, schema))
            return
        # the window leaves rows sorted by fold and query, where they lie if they lie by query already
        keys = [*([F.col(fold).cast("int").alias("fold")] if fold else []), F.col(qid).alias("q")]
        level = F.dense_rank().over(Window.partitionBy(*keys).orderBy(label)).alias("level")
        more = []
        if fold:
            nulls = F.array(*[F.col(c).isNull() for c in features]).alias("nulls")
            more = [F.col(rid).alias("row"), F.col(label).alias("label"), nulls]
            schema += f", fold int, row array<{self.kinds[rid]}>, label array<{self.kinds[label]}>, nulls binary"
        rows = df.select(*keys, level, x, *more)
        self.base = materialize(rows.mapInArrow(_whole_blocks, schema), "matrix")

    @staticmethod
    def _stored(df: DataFrame, by: str = "block", n: int | None = None) -> DataFrame:
        """A table bucketed by block in the checkpoint folder. It is read
        through its files, so the catalogue keeps no name of it."""
        spark = df.sparkSession
        name = f"mooclens_matrix_{uuid.uuid4().hex}"
        n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = os.path.join(ensure_checkpoint_dir(spark), "mooclens-tables", name)
        df.write.bucketBy(n, by).option("path", path).saveAsTable(name, format="parquet")
        table = spark.table(name)
        table.schema  # resolved before the name goes
        spark.sql(f"DROP TABLE {name}")
        return table

    def _narrow(self, cands: list[tuple[int, list]], more: bool) -> DataFrame:
        """(cid, q, block, i, level, z, v): a row for each row and candidate;
        v is the second vector's product, or z."""
        cids = np.array([c for c, _ in cands], np.int32)
        weights = np.stack([vecs[0] for _, vecs in cands])
        second = np.stack([vecs[1] for _, vecs in cands]) if more else None
        p, kind = len(self.features), self.base.schema["q"].dataType.elementType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, q, level, x in zip(*(batch.column(c) for c in ("block", "q", "level", "x")), strict=True):
                    q, level = q.values, level.values.to_numpy()
                    m = np.frombuffer(x.as_py()).reshape(-1, p)
                    z = (m @ weights.T).T.ravel()
                    v = z if second is None else (m @ second.T).T.ravel()
                    n, k = len(level), len(cids)
                    columns = [np.repeat(cids, n), pa.concat_arrays([q] * k), np.full(n * k, block.as_py()), np.tile(np.arange(n, dtype=np.int32), k), np.tile(level, k), z, v]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["cid", "q", "block", "i", "level", "z", "v"])

        return self.base.mapInArrow(run, f"cid int, q {kind}, block long, i int, level int, z double, v double")

    def _sweeps(self, frame: DataFrame) -> DataFrame:
        """below, below_v: rows of higher levels under the margin; above,
        above_v: rows of lower levels over it."""
        keyed = frame.withColumn("_qk", F.struct("cid", "q")).withColumn("_r", F.struct("block", "i"))
        for d, name in (("plus", "below"), ("minus", "above")):
            found = _dominance(keyed, "_qk", "_r", "z", "v", 1.0, d, False)
            keyed = _join_same(keyed, found.select("_qk", "_r", F.col("_cnt").alias(name), F.col("_sum").alias(f"{name}_v")), ["_qk", "_r"], "inner")
        return keyed

    def _xt(self, rows: DataFrame, u: Column, loss: Column) -> dict:
        """{candidate: (X^T u, sum of loss)}."""
        p = len(self.features)

        def summed(blocks: pd.DataFrame, slopes: pd.DataFrame) -> pd.DataFrame:
            out = []
            for x in blocks["x"]:
                m = np.frombuffer(x).reshape(-1, p)
                cids, col = np.unique(slopes["cid"].to_numpy(), return_inverse=True)
                put = np.zeros((len(cids), len(m)))
                put[col, slopes["i"].to_numpy()] = slopes["u"].to_numpy()
                losses = np.bincount(col, slopes["loss"].to_numpy(), len(cids))
                s = np.column_stack([put @ m, losses])
                out.append((np.repeat(cids, p + 1), np.tile(np.arange(p + 1), len(cids)), s.ravel()))
            return pd.DataFrame(dict(zip(("cid", "k", "s"), (np.concatenate(c) for c in zip(*out)))) if out else {"cid": [], "k": [], "s": []})

        slopes = rows.select("block", "cid", "i", u.alias("u"), loss.alias("loss"))
        parts = self.base.select("block", "x").groupBy("block").cogroup(slopes.groupBy("block")).applyInPandas(summed, "cid int, k int, s double")
        return self._summed(parts)

    def _summed(self, parts: DataFrame) -> dict:
        p, found = len(self.features), {}
        for r in parts.groupBy("cid", "k").agg(F.sum("s").alias("s")).collect():  # candidates x (features + 1)
            found.setdefault(r["cid"], np.zeros(p + 1))[r["k"]] = r["s"]
        zero = np.zeros(p + 1)
        return {c: (x[:-1], float(x[-1])) for c, x in found.items()} | {None: (zero[:-1], 0.0)}

    def _in_blocks(self, cands: list[tuple[int, list]], slopes) -> dict:
        """As ``_xt``, block by block: ``slopes`` gives u and the loss of rows
        from z, v and the sweeps' below, below_v, above, above_v."""
        p, left_out = len(self.features), self.left_out
        read = ["q", "level", "x", *["fold"] * bool(self.fold)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {cid: np.zeros(p + 1) for cid, _ in cands}
            for batch in batches:
                for q, level, x, *fold in zip(*(batch.column(c) for c in read), strict=True):
                    here = [c for c in cands if not fold or left_out.get(c[0]) != fold[0].as_py()]
                    group = _runs([q.values.dictionary_encode(null_encoding="encode").indices.to_numpy()])
                    level = level.values.to_numpy().astype(np.int64)
                    m = np.frombuffer(x.as_py()).reshape(-1, p)
                    for cid, vecs in here:
                        z, v = m @ vecs[0], m @ vecs[-1]
                        u, loss = slopes(z, v, *(s for d in ("plus", "minus") for s in dominance(group, level, z, v, 1.0, d)))
                        total[cid] += np.append(u @ m, np.sum(loss))
            cids = np.array(list(total), np.int32)
            columns = [np.repeat(cids, p + 1), np.tile(np.arange(p + 1, dtype=np.int32), len(cids)), np.concatenate(list(total.values()))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cid", "k", "s"])

        return self._summed(self.base.select(*read).mapInArrow(run, "cid int, k int, s double"))

    def scored(self, weights: dict[int, dict]) -> DataFrame:
        """(qid, rid, label, fold, score): the rows of a matrix with folds, each
        scored as by ``rank_svm_score`` with its own fold's {feature: w}. A
        query's rows stay in one partition."""
        features, p = self.features, len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for q, row, label, fold, x, nulls in zip(*(batch.column(c) for c in ("q", "row", "label", "fold", "x", "nulls")), strict=True):
                    m = np.frombuffer(x.as_py()).reshape(-1, p)
                    lacks = np.frombuffer(nulls.as_py(), bool).reshape(-1, p) if nulls.is_valid else None
                    z, unknown = np.zeros(len(m)), np.zeros(len(m), bool)
                    for k, f in enumerate(features):  # feature by feature: equal rows get equal scores
                        w = weights[fold.as_py()].get(f, 0.0)
                        if w != 0.0:
                            z = z + m[:, k] * w
                            if lacks is not None:
                                unknown |= lacks[:, k]
                    columns = [q.values, row.values, label.values, pa.array(np.full(len(m), fold.as_py(), np.int32)), pa.array(z, mask=unknown)]
                    yield pa.RecordBatch.from_arrays(columns, ["q", "row", "label", "fold", "score"])

        read = self.base.select("q", "row", "label", "fold", "x", "nulls")
        found = read.mapInArrow(run, f"q {self.kinds[self.qid]}, row {self.kinds[self.rid]}, label {self.kinds[self.label]}, fold int, score double")
        return found.withColumnsRenamed({"q": self.qid, "row": self.rid, "label": self.label})

    def _in_packs(self, cands: list[tuple[int, list]], slopes) -> dict:
        """As ``_in_blocks`` where a query spans blocks. The scores of a
        block's rows of one query travel as one pack for each candidate; a
        group sweeps some whole queries of a candidate and sends the packs'
        slopes back to their blocks."""
        p, kind = len(self.features), self.base.schema["q"].dataType.elementType.simpleString()
        cids = np.array([c for c, _ in cands], np.int32)
        weights = [np.stack(w).T for w in zip(*(vecs for _, vecs in cands))]

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, q, level, x in zip(*(batch.column(c) for c in ("block", "q", "level", "x")), strict=True):
                    q, level = q.values, level.values.to_numpy().astype(np.int32)
                    run = _runs([q.dictionary_encode(null_encoding="encode").indices.to_numpy()])
                    start = np.flatnonzero(np.diff(run, prepend=-1))
                    end = np.append(start[1:], len(run))
                    m = np.frombuffer(x.as_py()).reshape(-1, p)
                    z, v = ((m @ w).T.copy() for w in (weights[0], weights[-1]))
                    for a, b in zip(start, end):
                        k = len(cids)
                        cut = [[y[a:b].tobytes() for y in of] for of in ((z, v) if len(weights) > 1 else (z,))]
                        columns = [pa.array(cids), pa.concat_arrays([q.slice(a, 1)] * k), pa.array(np.full(k, block.as_py())), pa.array(np.full(k, a, np.int32)),
                                   pa.array([level[a:b].tobytes()] * k), pa.array(cut[0], pa.binary()), pa.array(cut[1], pa.binary()) if cut[1:] else pa.nulls(k, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["cid", "q", "block", "start", "level", "z", "v"])

        def sweep(packs: pa.Table) -> pa.Table:
            level, z = (np.frombuffer(b"".join(packs.column(c).to_pylist()), t) for c, t in (("level", np.int32), ("z", float)))
            v = z if packs.column("v").null_count else np.frombuffer(b"".join(packs.column("v").to_pylist()))
            ends = np.cumsum([len(x) // 8 for x in packs.column("z").to_pylist()])
            query = packs.column("q").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            query, level = np.repeat(query, np.diff(ends, prepend=0)), level.astype(np.int64)
            u, loss = slopes(z, v, *(s for d in ("plus", "minus") for s in dominance(query, level, z, v, 1.0, d)))
            loss, starts = np.broadcast_to(loss, len(z)), np.append(0, ends[:-1])
            back = [pa.array([u[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array(np.add.reduceat(loss, starts))]
            return pa.table([*(packs.column(c) for c in ("cid", "block", "start")), *back], ["cid", "block", "start", "u", "loss"])

        def summed(blocks: pa.Table, packs: pa.Table) -> pa.Table:
            m = np.frombuffer(blocks.column("x")[0].as_py()).reshape(-1, p)
            cids, col = np.unique(packs.column("cid").to_numpy(), return_inverse=True)
            put = np.zeros((len(cids), len(m)))
            for c, a, u in zip(col, packs.column("start").to_pylist(), packs.column("u").to_pylist()):
                u = np.frombuffer(u)
                put[c, a:a + len(u)] = u
            s = np.column_stack([put @ m, np.bincount(col, packs.column("loss").to_numpy(), len(cids))])
            columns = [np.repeat(cids, p + 1), np.tile(np.arange(p + 1, dtype=np.int32), len(cids)), s.ravel()]
            return pa.table([pa.array(c) for c in columns], ["cid", "k", "s"])

        packs = self.base.mapInArrow(scores, f"cid int, q {kind}, block long, start int, level binary, z binary, v binary")
        packs = packs.withColumn("_g", F.pmod(F.xxhash64("q"), F.lit(self.groups)))
        swept = packs.groupBy("cid", "_g").applyInArrow(sweep, "cid int, block long, start int, u binary, loss double")
        blocks = self.base.select("block", "x").groupBy("block")
        return self._summed(blocks.cogroup(swept.groupBy("block")).applyInArrow(summed, "cid int, k int, s double"))

    def values(self, asked: list[tuple[int, float, np.ndarray]]) -> dict:
        """(candidate, C, w) -> {candidate: (value, gradient)}.

        A pair's margin shortfall is m = 1 - z_i + z_j. As the preferred row
        i, a row has ``above`` violated pairs whose partners' scores sum to
        ``above_v``; as the other row j, ``below`` and ``below_v``. Half the
        loss's slope in z and the loss itself follow row by row:
        sum m^2 = sum m + sum m (z_j - z_i) = sum m + sum z * slope / 2.
        """
        self.passes += 1
        found = self._pass([(cid, [w]) for cid, _, w in asked], _loss_slopes)
        out = {}
        for cid, C, w in asked:
            pull, loss = found.get(cid, found[None])
            out[cid] = (float(w @ w / 2 + C * loss), w + 2 * C * pull)
        return out

    def curvatures(self, asked: list[tuple[int, float, np.ndarray, np.ndarray]]) -> dict:
        """(candidate, C, w, s) -> {candidate: Hessian at w times s}: the
        slope's change along s while the violated pairs of w stay."""
        found = self._pass([(cid, [w, s]) for cid, _, w, s in asked], _bends)
        return {cid: s + 2 * C * found.get(cid, found[None])[0] for cid, C, _, s in asked}

    def _pass(self, cands: list[tuple[int, list]], slopes) -> dict:
        if self.whole:
            return self._in_blocks(cands, slopes)
        if self.small:
            return self._in_packs(cands, slopes)
        rows = self._sweeps(self._narrow(cands, len(cands[0][1]) > 1))
        u, loss = slopes(*(F.col(c) for c in ("z", "v", "below", "below_v", "above", "above_v")))
        return self._xt(rows, u, loss if isinstance(loss, Column) else F.lit(loss))

    def hessian(self, C: float, w: np.ndarray) -> np.ndarray:
        """The whole Hessian at w: all unit vectors in one pass."""
        p = len(self.features)
        found = self.curvatures([(k, C, w, np.eye(p)[k]) for k in range(p)])
        h = np.stack([found[k] for k in range(p)])
        return (h + h.T) / 2


def _loss_slopes(z, v, below, below_v, above, above_v):
    """Half the loss's slope in z, and the loss, of columns or arrays."""
    shortfall = above * (1 - z) + above_v
    half_slope = below * (1 + z) - below_v - shortfall
    return half_slope, shortfall + z * half_slope


def _bends(z, v, below, below_v, above, above_v):
    return (above + below) * v - above_v - below_v, 0.0


def _blocks_schema(qid) -> str:
    return f"block long, q array<{qid.dataType.simpleString()}>, level array<int>, x binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (q, level, x) in blocks of at most BLOCK_ROWS."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield _block(batch.slice(at, BLOCK_ROWS), part << 32 | number)
            number += 1


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by q, or by fold and q, in blocks of whole
    queries (of one fold), of about BLOCK_ROWS rows or one greater query."""
    part, number, first = TaskContext.get().partitionId(), 0, next(batches, None)
    if first is None:
        return
    folds = "fold" in first.schema.names
    for table, group in _whole_queries(itertools.chain([first], batches), [*["fold"] * folds, "q"]):
        table, at = table.combine_chunks(), 0
        fold = table.column("fold").to_numpy() if folds else np.zeros(len(group), np.int32)
        while at < len(group):
            # the queries that begin in the next BLOCK_ROWS rows
            end = int(np.searchsorted(group, group[min(at + BLOCK_ROWS, len(group)) - 1], "right"))
            end = min(end, int(np.searchsorted(fold, fold[at], "right")))
            yield _block(table.slice(at, end - at).to_batches()[0], part << 32 | number)
            at, number = end, number + 1


def _block(rows: pa.RecordBatch, number: int) -> pa.RecordBatch:
    x = rows.column("x").flatten().to_numpy().tobytes()
    listed = [c for c in ("q", "level", "row", "label") if c in rows.schema.names]
    columns = {"block": pa.array([number], pa.int64())}
    columns |= {c: pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(c)) for c in listed}
    columns["x"] = pa.array([x], pa.binary())
    if "fold" in rows.schema.names:
        nulls = rows.column("nulls").flatten().to_numpy(zero_copy_only=False)
        columns |= {"fold": rows.column("fold").slice(0, 1), "nulls": pa.array([nulls.tobytes() if nulls.any() else None], pa.binary())}
    names = [*(c for c in ("block", "q", "level", "x", "fold", "row", "label", "nulls") if c in columns)]
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def fit_candidates(df: DataFrame, features: list[str], candidates: list[tuple[float, str | None]],
                   qid: str = "qid", rid: str = "row_id", label: str = "label", eps: float = 1e-3,
                   max_iter: int = 1000, batch: RankSVMBatch | None = None) -> list[dict]:
    """Fit one ranking SVM per candidate (C, dropped feature or None); all
    candidates share every Spark pass. Returns one {feature: w} per
    candidate (a dropped feature is left out). ``batch`` is the matrix of
    ``df`` where it is there already."""
    batch = batch or RankSVMBatch(df, features, qid, rid, label)
    searches = {}
    for cid, (_, drop) in enumerate(candidates):
        free = np.array([float(f != drop) for f in features])
        searches[cid] = newton_search(len(features), eps, max_iter, free)
    weights = _run(batch, searches, {cid: float(C) for cid, (C, _) in enumerate(candidates)})
    return [
        {f: float(v) for f, v in zip(features, weights[cid]) if f != drop}
        for cid, (_, drop) in enumerate(candidates)
    ]


def _run(batch: RankSVMBatch, searches: dict, cs: dict) -> dict:
    """Work all searches to their ends: {candidate: what it returns}."""
    waiting, ended = {cid: next(x) for cid, x in searches.items()}, {}
    while waiting:
        # one Spark pass answers all searches that wait for the same thing
        values = [(cid, cs[cid], ask[1]) for cid, ask in waiting.items() if ask[0] == "value"]
        bends = [(cid, cs[cid], *ask[1:]) for cid, ask in waiting.items() if ask[0] == "curvature"]
        answers = (batch.values(values) if values else {}) | (batch.curvatures(bends) if bends else {})
        for cid, answer in answers.items():
            try:
                waiting[cid] = searches[cid].send(answer)
            except StopIteration as done:
                ended[cid] = done.value
                del waiting[cid]
    return ended


def rank_svm_fit(df: DataFrame, features: list[str], C: float = 1.0, qid: str = "qid", rid: str = "row_id",
                 label: str = "label", eps: float = 1e-3, max_iter: int = 1000, drop: str | None = None) -> dict:
    """Fit the ranking SVM; returns {feature: weight}. ``drop`` leaves
    one feature out (the -r option, as a mask)."""
    return fit_candidates(df, features, [(C, drop)], qid, rid, label, eps, max_iter)[0]


def minimise(objective, n: int, eps: float = 1e-3, max_iter: int = 1000) -> np.ndarray:
    """``newton_search`` on an object with value(w) -> (value, gradient) and
    curvature(w, s) -> Hessian at w times s."""
    search = newton_search(n, eps, max_iter, np.ones(n))
    ask = next(search)
    while True:
        answer = objective.value(ask[1]) if ask[0] == "value" else objective.curvature(*ask[1:])
        try:
            ask = search.send(answer)
        except StopIteration as done:
            return done.value


def rank_svm_score(df: DataFrame, weights: dict, out: str = "score") -> DataFrame:
    """Decision values x . w (features missing from the model are ignored)."""
    return df.withColumn(out, _dot(list(weights), list(weights.values())))


def weights_table(spark, weights: dict, model: str = "ranksvm") -> DataFrame:
    """The model as a table (model, idx, feature, w)."""
    rows = [(model, i + 1, f, float(v)) for i, (f, v) in enumerate(weights.items())]
    return spark.createDataFrame(rows, "model string, idx int, feature string, w double")


def grid_search_c(train: DataFrame, valid: DataFrame, features: list[str], cs, label: str = "label",
                  id_col: str = "row_id", qid: str = "qid") -> DataFrame:
    """One fit per C (all fits share each Spark pass), AUC of the
    validation decision values; returns (C, auc)."""
    from mooclens.operators.metrics import auc

    spark = train.sparkSession
    fits = fit_candidates(train, features, [(float(c), None) for c in cs], qid, id_col, label)
    scored = None
    for c, w in zip(cs, fits):
        part = rank_svm_score(valid, w).select(F.lit(float(c)).alias("C"), "score", label)
        scored = part if scored is None else scored.unionByName(part)
    return auc(scored, ["C"], "score", label).select("C", "auc")


class Refit:
    """Minimisation for one candidate from a known neighbour: quasi-Newton
    steps (BFGS) that begin with the neighbour's Hessian, steps halving until
    the value falls. ``norm`` bounds the distance to the optimum: the
    objective holds w'w/2, so |w - best| <= |gradient|."""

    def __init__(self, start: np.ndarray, hessian: np.ndarray, free: np.ndarray, target: float):
        self.free, self.target = free, target
        own = np.flatnonzero(free)
        self.inverse = np.zeros_like(hessian)
        self.inverse[np.ix_(own, own)] = np.linalg.inv(hessian[np.ix_(own, own)])
        # where the neighbour's parabola, cut at w = 0 for what is dropped, is least
        self.trial = start * free + self.inverse @ (hessian @ (start * (1 - free)))
        self.w, self.value, self.gradient, self.norm, self.length, self.done = None, np.inf, None, np.inf, 1.0, False

    def take(self, value: float, gradient: np.ndarray) -> None:
        gradient = gradient * self.free
        if self.w is not None:
            step = self.trial - self.w
            if value > self.value + 1e-4 * (self.gradient @ step):
                self.length /= 2
                self.done = self.length < 1e-10
                self.trial = self.w + step / 2
                return
            change = gradient - self.gradient
            bend = step @ change
            if bend > 1e-14 * np.linalg.norm(step) * np.linalg.norm(change):
                turn = np.eye(len(step)) - np.outer(step, change) / bend
                self.inverse = turn @ self.inverse @ turn.T + np.outer(step, step) / bend
        self.w, self.value, self.gradient, self.norm, self.length = self.trial, value, gradient, np.linalg.norm(gradient), 1.0
        self.done = self.norm <= self.target
        self.trial = self.w - self.free * (self.inverse @ gradient)


def _narrow_scores(valid: DataFrame, features: list[str], weights: dict, label: str) -> DataFrame:
    """(cid, label, score) of every row and candidate."""
    names, m = np.array(list(weights), np.int32), np.stack(list(weights.values()))
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = b.column("x").flatten().to_numpy().reshape(-1, m.shape[1]) @ m.T
            columns = [pa.array(np.repeat(names, len(z))), pa.concat_arrays([b.column("y")] * len(names)), pa.array(z.T.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "label", "score"])

    return valid.select(F.col(label).cast("double").alias("y"), x).mapInArrow(run, "cid int, label double, score double")


def _auc_range(valid: DataFrame, features: list[str], weights: dict, reach: dict, label: str) -> dict:
    """{candidate: (least, greatest AUC)} when each pair's difference may
    still move by ``reach``."""
    from mooclens.operators.metrics import auc

    s = _narrow_scores(valid, features, weights, label)
    by = F.create_map(*[F.lit(x) for c, d in reach.items() for x in (c, float(d))])[F.col("cid")]
    moved = F.when(F.col("label") == 1, F.col("score") + F.col("sign") * by).otherwise(F.col("score"))
    shifted = s.select("cid", "label", "score", F.explode(F.array(F.lit(-1), F.lit(1))).alias("sign"))
    found = auc(shifted.select("cid", "sign", "label", moved.alias("score")), ["cid", "sign"]).collect()
    at = {(r["cid"], r["sign"]): r["auc"] for r in found}
    return {c: (at[c, -1], at[c, 1]) for c in weights}


def refit_without(batch: RankSVMBatch, C: float, start: np.ndarray, hessian: np.ndarray, drops: list[int],
                  kept: np.ndarray, first: float, eps: float, valid: DataFrame | None = None, label: str = "label", max_iter: int = 200) -> dict:
    """Fits without each of the features ``drops`` (numbers), from the fit
    ``start`` with the features ``kept`` (0 / 1) and the Hessian there or near:
    {feature: w}, in passes over the rows that all share. With ``valid``, fits whose validation AUC cannot
    become the best any more are given up and left out."""
    fits = {}
    for d in drops:
        free = kept.copy()
        free[d] = 0.0
        fits[d] = Refit(start, hessian, free, eps * first)
    reach = None
    for turn in range(max_iter):
        open_ = {d: x for d, x in fits.items() if not x.done}
        if not open_ or (valid is not None and len(fits) == 1):
            break
        for d, (value, gradient) in batch.values([(d, C, x.trial) for d, x in open_.items()]).items():
            open_[d].take(value, gradient)
        if valid is not None and turn % 2 == 1 and any(not x.done for x in fits.values()):
            if reach is None:  # the longest row: a pair's difference moves by twice its length at most
                square = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) ** 2 for c in batch.features), F.lit(0.0))
                reach = 2 * (valid.agg(F.max(F.sqrt(square))).first()[0] or 0.0)
            between = _auc_range(valid, batch.features, {d: x.w for d, x in fits.items()}, {d: reach * x.norm for d, x in fits.items()}, label)
            best = max(low for low, _ in between.values())
            fits = {d: x for d, x in fits.items() if between[d][1] >= best}
    return {d: x.w if x.w is not None else x.trial for d, x in fits.items()}


def _full_fit(batch: RankSVMBatch, C: float, eps: float, max_iter: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit of all features by Newton steps with the whole Hessian, two passes
    a step: weights, Hessian there, and the gradient's length at 0."""
    w = np.zeros(len(batch.features))
    value, gradient = batch.values([(0, C, w)])[0]
    first = float(np.linalg.norm(gradient))
    hessian = batch.hessian(C, w)
    for _ in range(max_iter):
        if np.linalg.norm(gradient) <= eps * first:
            break
        step, length = -np.linalg.solve(hessian, gradient), 1.0
        while length > 1e-10:
            v, g = batch.values([(0, C, w + length * step)])[0]
            if v <= value + 1e-4 * length * (gradient @ step):
                break
            length /= 2
        else:
            break
        w, value, gradient = w + length * step, v, g
        hessian = batch.hessian(C, w)
    return w, hessian, first


def removal_round(train: DataFrame, valid: DataFrame, features: list[str], C: float, label: str = "label",
                  id_col: str = "row_id", qid: str = "qid", eps: float = 1e-3) -> DataFrame:
    """M9 with the ranking SVM, one round: for every feature, refit without
    it (all candidates in the same passes, from the fit of all features) and
    report validation AUC."""
    from mooclens.operators.metrics import auc

    batch = RankSVMBatch(train, features, qid, id_col, label)
    w, hessian, first = _full_fit(batch, float(C), eps)
    fits = refit_without(batch, float(C), w, hessian, list(range(len(features))), np.ones(len(features)), first, eps)
    scored = _narrow_scores(valid, features, fits, label)
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("cid") + 1)
    return auc(scored, ["cid"]).select(name.alias("dropped"), "auc")


def backward_elimination(train: DataFrame, valid: DataFrame, features: list[str], C: float, rule: str = "until_no_gain",
                         label: str = "label", id_col: str = "row_id", qid: str = "qid", eps: float = 1e-3,
                         max_rounds: int | None = None, give_up: bool = True) -> tuple[list[str], list[tuple], dict]:
    """M9 with refits, the whole loop: each round drops the feature whose
    removal gives the best validation AUC (the first of equals), fitting from
    the last round's weights. Rules as in ``blend.backward_elimination``:
    'exhaust', 'exhaust_keep_best', 'until_no_gain', 'keep_last'. Returns the
    kept features, [(round, dropped, auc)] and {feature: w} of the kept."""
    from mooclens.operators.metrics import auc

    if rule not in ("exhaust", "exhaust_keep_best", "until_no_gain", "keep_last"):
        raise ValueError(f"rule={rule!r}")
    batch = RankSVMBatch(train, features, qid, id_col, label)
    C, p = float(C), len(features)
    w, hessian, first = _full_fit(batch, C, eps)
    kept, history, quick = np.ones(p), [], True

    def aucs(fits: dict) -> dict:
        return {r["cid"]: r["auc"] for r in auc(_narrow_scores(valid, features, fits, label), ["cid"]).collect()}

    previous = aucs({0: w})[0]
    best = (previous, kept.copy(), w)
    while kept.sum() > 1 and (max_rounds is None or len(history) < max_rounds):
        own = [int(k) for k in np.flatnonzero(kept)]
        if history and not quick:
            hessian = batch.hessian(C, w)
        before = batch.passes
        fits = refit_without(batch, C, w, hessian, own, kept, first, eps, valid if give_up else None, label)
        quick = batch.passes - before <= 3  # else the Hessian of earlier rounds no longer serves
        found = aucs(fits)
        drop = max((k for k in found if found[k] is not None), key=lambda k: (found[k], -k), default=None)
        if drop is None:
            break
        history.append((len(history) + 1, features[drop], found[drop]))
        gained = found[drop] > previous
        if rule == "until_no_gain" and not gained:
            break
        kept, w, previous = kept.copy(), fits[drop], found[drop]
        kept[drop] = 0.0
        if found[drop] > best[0]:
            best = (found[drop], kept.copy(), w)
        if rule == "keep_last" and not gained:
            break
    if rule == "exhaust_keep_best":
        _, kept, w = best
    names = [f for f, k in zip(features, kept) if k]
    return names, history, {f: float(v) for f, v, k in zip(features, w, kept) if k}


def _query_sizes(df: DataFrame, qid: str) -> tuple[DataFrame, int, int, int]:
    """(qid, _n): rows of each query; how many queries, rows, and the rows of
    the greatest query."""
    # read several times below, and what makes the rows may be costly
    sizes = materialize(df.groupBy(qid).agg(F.count(F.lit(1)).alias("_n")), "query_sizes")
    n_queries, n_rows, biggest = sizes.agg(F.count(F.lit(1)), F.sum("_n"), F.max("_n")).first()
    return sizes, n_queries, n_rows or 0, biggest or 0


def query_folds(df: DataFrame, k: int, qid: str = "qid", rid: str = "row_id", seed: int = 0,
                sizes: tuple[DataFrame, int, int, int] | None = None) -> tuple[DataFrame, int]:
    """L9 fold assignment: ``df`` with ``fold``, and the number of folds.

    Whole queries go to folds, at most as many folds as queries: queries in
    order of falling size, equal sizes shuffled by MD5 of seed and qid, are
    dealt out to and fro (0..k-1, k-1..0, ...), so no fold is empty and
    folds hold about as many rows. A single query's rows are shuffled by MD5
    of seed and row id and dealt out in turn, to at most rows / 2 folds."""
    sizes, n_queries, n_rows, _ = sizes or _query_sizes(df, qid)
    single = n_queries == 1
    k = max(1, min(k, n_rows // 2 if single else n_queries))
    name = rid if single else qid
    dealt = (df.select(F.col(rid), F.lit(0).alias("_o")) if single else sizes.select(qid, (-F.col("_n")).alias("_o")))
    # as bytes: half of the hex digits, in the same order
    shuffled = F.unhex(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(name).cast("string")).cast("binary")))
    dealt = dealt.select(name, "_o", shuffled.alias("_h"), F.lit(0).alias("_all"))
    place = row_numbers(dealt, ["_all"], ["_o", "_h", name], "_at").withColumn("_at", F.col("_at") - 1)
    turn, at = F.floor(F.col("_at") / k), F.col("_at") % k
    fold = at if single else F.when(turn % 2 == 0, at).otherwise(k - 1 - at)
    place = place.select(name, fold.cast("int").alias("fold"))
    if single:
        return _join_same(df, place, [name], "inner"), k
    # a join on the plain key leaves rows that lie by query where they are; the query without a name is looked up
    place = materialize(place, "query_places")
    unnamed = place.where(F.col(qid).isNull()).first()
    known = place.select(F.col(qid).alias("_q"), F.col("fold").alias("_fold"))
    found = df.join(known, df[qid] == F.col("_q"), "left" if unnamed else "inner")
    fold = F.coalesce("_fold", F.lit(unnamed["fold"])) if unnamed else F.col("_fold")
    return found.select(*[df[c] for c in df.columns], fold.alias("fold")), k


def cross_validate(df: DataFrame, features: list[str], C: float, k: int = 5, qid: str = "qid",
                   rid: str = "row_id", label: str = "label", seed: int = 0) -> DataFrame:
    """Query-level k-fold CV; pairwise accuracy (L3) and mean NDCG (L4)
    of the out-of-fold decision values. Returns one row. Each fold of a single
    query counts as its own query.

    Where no query is greater than a block, ``df`` is read twice: once for the
    sizes of its queries, once for the one matrix that all folds' fits, the
    scores and both measures read. It must hold the same rows each time."""
    from mooclens.operators.rank import mean_ndcg, pairwise_accuracy

    sizes = _query_sizes(df, qid)
    _, n_queries, _, biggest = sizes
    if n_queries > 1 and biggest <= WHOLE_ROWS and 2 * biggest <= conf_int(df.sparkSession, HOT_ROWS_KEY):
        folded, k = query_folds(df.select(*dict.fromkeys([qid, rid, label, *features])), k, qid, rid, seed, sizes)
        if k < 2:
            raise ValueError("cross-validation needs two queries, or four rows of one")
        batch = RankSVMBatch(folded, features, qid, rid, label, "fold", biggest)
        batch.left_out = {f: f for f in range(k)}  # a fit for each fold, on the others
        fits = fit_candidates(folded, features, [(C, None)] * k, qid, rid, label, batch=batch)
        oof, whole = batch.scored(dict(enumerate(fits))), True
    else:
        folded, k = query_folds(materialize(df, "query_rows"), k, qid, rid, seed)
        if k < 2:
            raise ValueError("cross-validation needs two queries, or four rows of one")
        folded = materialize(folded, "query_folds")
        oof, whole = None, False
        for f in range(k):
            w = rank_svm_fit(folded.where(F.col("fold") != f), features, C, qid, rid, label)
            part = rank_svm_score(folded.where(F.col("fold") == f), w)
            oof = part if oof is None else oof.unionByName(part)
        oof = materialize(oof, "query_scores")
        if n_queries == 1:
            oof = oof.withColumn(qid, F.col("fold").cast(oof.schema[qid].dataType))
    acc = pairwise_accuracy(oof, "score", qid, rid, label, whole).select("pairwise_accuracy")
    nd = mean_ndcg(oof, score="score", qid=qid, rid=rid, label=label, whole=whole).select("mean_ndcg")
    return _side_by_side(acc, nd)


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row frames as one row (no join needed)."""
    ra, rb = a.first(), b.first()
    spark = a.sparkSession
    return spark.createDataFrame([(ra[0], rb[0])], f"{a.columns[0]} double, {b.columns[0]} double")
