"""Exact top-k inner products by dual-tree search over cover trees.

Equal vectors are one point that keeps its least ids (as many as a query
could report, so none is lost). Points are dealt to blocks by their nearest
pivot (pivots: a bounded number of points), large ones split, and every
block gets a cover tree: a node's children are at least half its radius
apart and cover it, and each node knows its covering radius. Queries form
groups in the same way, each with a cover tree of its own.

A pair of query node and data node with centres q, d and covering radii
s, r cannot score above <q, d> + |q| r + |d| s + r s. It is dropped when
that is below the worst k-th score in the query node. Each group meets its
home block first; from the scores found there, whole blocks are ruled out
by the same bound, and the remaining (group, block) pairs are searched in
parallel. Nothing is approximate; ties go to the smaller id.

Edge cases: vectors that are null or empty or hold null or non-finite
components take no part; shorter vectors count as padded with zeros; equal
rows count once; null ids take no part; no queries or no candidates give
no rows. Scores are exact while they stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mooclens.llm.common import stored

BLOCK_ROWS = 2000
GROUP_ROWS = 256
MOST_PIVOTS = 1024
#: Points of a node up to which they become its children without a cover.
FEW = 48
#: Queries that one scoring step handles together.
BUNDLE = 64


class CoverTree:
    """Cover tree over the rows of ``points``; node 0 is the root.

    Nodes are arrays: ``point`` (row), ``radius`` (greatest distance to a
    descendant), children ``first``..``last``; ``fresh`` is False where the
    node repeats its parent's point (the nesting rule)."""

    def __init__(self, points: np.ndarray):
        self.points = points
        point, radius, first, last, fresh = [0], [0.0], [0], [0], [True]
        todo = [(0, np.arange(1, len(points)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            far = self._distance(point[node], own)
            radius[node] = float(far.max())
            parts = [(p, own[:0]) for p in own.tolist()] if len(own) <= FEW else self._cover(point[node], own, far)
            first[node], last[node] = len(point), len(point) + len(parts)
            for p, rest in parts:
                todo.append((len(point), rest))
                fresh.append(p != point[node])
                point.append(p)
                radius.append(0.0)
                first.append(0)
                last.append(0)
        self.point, self.radius = np.array(point), np.array(radius)
        self.first, self.last, self.fresh = np.array(first), np.array(last), np.array(fresh)
        self.norm = np.sqrt((points * points).sum(axis=1))

    def _distance(self, p: int, own: np.ndarray) -> np.ndarray:
        d = self.points[own] - self.points[p]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _cover(self, p: int, own: np.ndarray, far: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Children of p: itself with what lies within half the radius, and
        greedily others, each more than half the radius from the ones before."""
        half = far.max() / 2
        parts = [(p, own[far <= half])]
        left, away = own[far > half], far[far > half]
        while len(left):
            k = int(away.argmax())
            c = int(left[k])
            d = self._distance(c, left)
            parts.append((c, left[(d <= half) & (left != c)]))
            stay = d > half
            left, away = left[stay], np.minimum(away, d)[stay]
        return parts

    def below(self, node: int) -> np.ndarray:
        """Rows of a node and its descendants."""
        rows, todo = [int(self.point[node])], [node]
        while todo:
            n = todo.pop()
            for c in range(self.first[n], self.last[n]):
                if self.fresh[c]:
                    rows.append(int(self.point[c]))
                todo.append(c)
        return np.array(rows)

    def bundles(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Rows in bundles of at most BUNDLE, with a centre and the radius
        around it: whole nodes where they are small enough, and small
        children of one node together."""
        todo = [0]
        while todo:
            node = todo.pop()
            rows = self.below(node)
            centre, radius = self.points[self.point[node]], float(self.radius[node])
            if len(rows) <= BUNDLE:
                yield rows, centre, radius
                continue
            small: list[np.ndarray] = [] if any(not self.fresh[c] for c in range(self.first[node], self.last[node])) else [self.point[node : node + 1]]
            for c in range(self.first[node], self.last[node]):
                own = self.below(c)
                if len(own) > BUNDLE:
                    todo.append(c)
                else:
                    small.append(own)
            merged = np.concatenate(small) if small else np.zeros(0, int)
            for k in range(0, len(merged), BUNDLE):
                yield merged[k : k + BUNDLE], centre, radius


class Best:
    """The k best (score, id) of each query, worst last."""

    def __init__(self, queries: int, k: int, worst: np.ndarray):
        self.k, self.worst = k, worst.astype(float).copy()
        self.rows: list[list[tuple[float, int]]] = [[] for _ in range(queries)]

    def offer(self, q: int, scores: np.ndarray, ids: list) -> None:
        rows = self.rows[q] + [(-s, i) for s, own in zip(scores.tolist(), ids, strict=True) for i in own]
        rows.sort()
        self.rows[q] = rows[: self.k]
        if len(self.rows[q]) == self.k:
            self.worst[q] = max(self.worst[q], -self.rows[q][-1][0])


def dual_search(queries: CoverTree, data: CoverTree, ids: list, best: Best) -> None:
    """Offer to ``best`` all data points that can be among a query's best."""
    for rows, centre, radius in queries.bundles():
        length, matrix = float(np.sqrt(centre @ centre)), queries.points[rows]
        sizes = queries.norm[rows]

        def score(points: np.ndarray, rows=rows, matrix=matrix) -> np.ndarray:
            found = matrix @ data.points[points].T
            for j, q in enumerate(rows.tolist()):
                hit = np.flatnonzero(found[j] >= best.worst[q])
                if len(hit) > 4 * best.k:  # keep ties of the k-th score
                    least = np.partition(found[j][hit], -best.k)[-best.k]
                    hit = hit[found[j][hit] >= least]
                if len(hit):
                    best.offer(q, found[j][hit], [ids[p] for p in points[hit].tolist()])
            return found

        score(data.point[:1])
        todo = [0]
        while todo:
            node = todo.pop()
            own = data.points[data.point[node]]
            r = float(data.radius[node])
            bound = centre @ own + length * r + data.norm[data.point[node]] * radius + r * radius
            if data.first[node] == data.last[node] or bound < best.worst[rows].min() - 1e-6:
                continue
            children = np.arange(data.first[node], data.last[node])
            found = matrix @ data.points[data.point[children]].T
            fresh = data.fresh[children]
            if fresh.any():
                score(data.point[children[fresh]])
            # a child goes on if any query of the bundle may still gain
            reach = found + sizes[:, None] * data.radius[children][None, :]
            go = (reach >= best.worst[rows][:, None] - 1e-6).any(axis=0) & (data.last[children] > data.first[children])
            order = children[go][np.argsort(reach.max(axis=0)[go])]
            todo += order.tolist()  # the most promising child is next


def _vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) with v the components floor(256 x), packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = []
            for x in t.column("v").to_pylist():
                a = np.array([np.nan if e is None else e for e in x], np.float64) if x else np.array([np.nan])
                out.append(np.floor(256 * a).astype("<f8").tobytes() if np.isfinite(a).all() else None)
            yield pa.RecordBatch.from_arrays([t.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "v"])

    clean = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return clean.where("vec_id is not null").mapInArrow(run, "vec_id long, v binary").where("v is not null")


def _matrix(blobs, width: int) -> np.ndarray:
    out = np.zeros((len(blobs), width))
    for i, b in enumerate(blobs):
        a = np.frombuffer(b, "<f8")
        out[i, : len(a)] = a
    return out


def _blocked(points: DataFrame, pivots: np.ndarray, rows: int) -> DataFrame:
    """``points`` (v, ...) with ``pivot``, the nearest, and ``block``:
    pivots with many points have several blocks."""
    width, half = pivots.shape[1], (pivots * pivots).sum(axis=1) / 2

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        m = _matrix(v.tolist(), width)
        return pd.Series((half - m @ pivots.T).argmin(axis=1)).astype("int32")

    near = stored(points.withColumn("pivot", nearest("v")), "tree-points")
    parts = near.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / rows).cast("long").alias("parts"))
    part = F.pmod(F.xxhash64("v"), F.col("parts"))
    return near.join(parts, "pivot").withColumn("block", F.col("pivot") + F.lit(len(pivots)).cast("long") * part).drop("parts")


_FOUND = "g long, q int, score double, vec_id long"


def top_k(
    table: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """For each row with ``is_query`` (a condition on vec_id), its k best
    other rows by inner product: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    vectors = stored(_vectors(table, vec_id, embedding).distinct(), "tree-vectors")
    keep = k + 1  # one of them may be the query itself
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    points = vectors.withColumn("_n", first).where(F.col("_n") <= keep).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = stored(points, "tree-distinct")
    queries = vectors.where(is_query)
    n, widest = points.agg(F.count(F.lit(1)), F.max(F.length("v"))).first()
    if not n or queries.isEmpty():
        return spark.createDataFrame([], result)
    width = widest // 8
    chosen = points.orderBy(F.xxhash64("v"), "v").limit(int(min(MOST_PIVOTS, -(-n // block_rows)))).select("v").collect()
    pivots = _matrix([bytes(r["v"]) for r in chosen], width)

    def indexed(own: pd.DataFrame) -> pd.DataFrame:
        """One row: the block's points in a fixed order, centre and radius."""
        own = own.sort_values("v", ignore_index=True)
        m = _matrix(own["v"].tolist(), width)
        own = own.iloc[((m - m.mean(axis=0)) ** 2).sum(axis=1).argsort(kind="stable")]  # the root is the most central
        m = _matrix(own["v"].tolist(), width)
        radius = float(np.sqrt(((m - m[0]) ** 2).sum(axis=1)).max())
        return pd.DataFrame(
            {
                "block": [int(own["block"].iloc[0])],
                "centre": [m[0].tobytes()],
                "radius": [radius],
                "points": [m.tobytes()],
                "ids": [[i for x in own["ids"] for i in x]],
                "sizes": [[len(x) for x in own["ids"]]],
            }
        )

    index = stored(
        _blocked(points, pivots, block_rows).groupBy("block").applyInPandas(
            indexed, "block long, centre binary, radius double, points binary, ids array<long>, sizes array<int>"
        ),
        "tree-index",
    )

    def group(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("v", ignore_index=True)
        return pd.DataFrame(
            {
                "g": [int(own["block"].iloc[0])],
                "home": [int(own["pivot"].iloc[0])],
                "points": [_matrix(own["v"].tolist(), width).tobytes()],
                "worst": [np.full(len(own), -np.inf).tobytes()],
                "keys": [own["v"].tolist()],
            }
        )

    asked = queries.select("v").distinct()
    groups = stored(
        _blocked(asked, pivots, GROUP_ROWS).groupBy("block").applyInPandas(
            group, "g long, home long, points binary, worst binary, keys array<binary>"
        ),
        "tree-groups",
    )

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in right.itertuples(index=False):
            data = CoverTree(np.frombuffer(b.points).reshape(-1, width))
            cut = np.concatenate([[0], np.cumsum(b.sizes)])
            flat = np.asarray(b.ids).tolist()
            ids = [flat[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
            for x in left.itertuples(index=False):
                tree = CoverTree(np.frombuffer(x.points).reshape(-1, width))
                best = Best(len(tree.points), keep, np.frombuffer(x.worst))
                dual_search(tree, data, ids, best)
                out += [(x.g, q, -s, i) for q, rows in enumerate(best.rows) for s, i in rows]
        return pd.DataFrame(out, columns=["g", "q", "score", "vec_id"]).astype({"g": "int64", "q": "int32", "score": float, "vec_id": "int64"})

    def searched(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """Results for pairs (g, block). Blocks that many groups ask for are
        searched in several tasks, for up to eight groups each."""
        turn = (F.row_number().over(Window.partitionBy("block").orderBy("g")) / 8).cast("int")
        dealt = stored(pairs.withColumn("turn", turn), "tree-pairs")
        left = dealt.join(groups.select("g", "points", "worst"), "g")
        asks = dealt.groupBy(F.col("block").alias("_block"), F.col("turn").alias("_turn")).agg(F.count(F.lit(1)).alias("_n"))
        right = asks.join(index, F.col("_block") == F.col("block")).drop("block", "_n")
        return left.groupBy("block", "turn").cogroup(right.groupBy("_block", "_turn")).applyInPandas(search, _FOUND)

    at_home = stored(searched(groups.select("g", F.col("home").alias("block")), groups), "tree-home")
    nth = Window.partitionBy("g", "q").orderBy(F.desc("score"), "vec_id")
    sixth = at_home.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") == keep).select("g", "q", "score")
    sixth = sixth.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("q", "score"))).alias("found"))
    # one row for each block, at most as many as pivots and their splits
    outline = index.select("block", "centre", "radius").toPandas()
    centres, radii = _matrix(outline["centre"].tolist(), width), outline["radius"].to_numpy()
    blocks, lengths = outline["block"].to_numpy(), np.sqrt((centres * centres).sum(axis=1))

    def surviving(own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in own.itertuples(index=False):
            m = np.frombuffer(x.points).reshape(-1, width)
            worst = np.frombuffer(x.worst).copy()
            for q, s in (x.found or {}).items() if isinstance(x.found, dict) else x.found if x.found is not None else ():
                worst[q] = s
            # single queries have radius 0: <q, d> + |q| r for each
            reach = m @ centres.T + np.sqrt((m * m).sum(axis=1))[:, None] * radii[None, :]
            go = (reach >= worst[:, None] - 1e-6).any(axis=0) & (blocks != x.home)
            out += [(x.g, int(b), x.points, worst.tobytes()) for b in blocks[go]]
        return pd.DataFrame(out, columns=["g", "block", "points", "worst"])

    schema = "g long, block long, points binary, worst binary"
    later = stored(groups.join(sixth, "g", "left").groupBy("g").applyInPandas(surviving, schema), "tree-later")
    rest = searched(later.select("g", "block"), later.select("g", "points", "worst").dropDuplicates(["g"]))
    found = at_home.unionByName(rest).withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= keep)
    keys = groups.select("g", F.posexplode("keys").alias("q", "v"))
    ranked = queries.select(F.col("vec_id").alias("query_id"), "v").join(keys, "v").join(found.drop("_n"), ["g", "q"])
    ranked = ranked.where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id"))
    return ranked.select("query_id", rank.alias("rank"), "vec_id", F.col("score").cast("long").alias("score")).where(F.col("rank") <= k)
