"""Groups of near-duplicate items from banded signatures, without listing
all pairs of a group.

Items are (node, n, regs, keys): a content id, the size of its set, its
signature as packed uint16 registers, and its band keys. Items that share a
key are candidates. Links need set intersection / union >= threshold,
confirmed on whole sets.

1. In each bucket every item is compared with a centre, the least node: no
   more pairs than rows, however large the bucket.
2. Union-find over the confirmed links. Buckets whose items are all in one
   component are done.
3. What remains are buckets with items of different components. There the
   registers give a spanning forest of the likeliest pairs across them, fewer
   pairs than items, which ties nearly all items that have a link at all;
   union-find again.
4. The rest is finished exactly, where buckets are still divided: items with
   a pair across components that the registers allow bring their sets, and
   every such pair is compared in the bucket's task, until its components are
   one. Only links leave the task, never more than items. A pair is looked at in the first
   of its common buckets only. Buckets beyond ``BLOCK`` items or ``ELEMENTS``
   elements are split into blocks.

Every candidate pair is thus confirmed, ruled out by its registers (at
five standard errors), or already inside one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.llm.bitmap import Members
from mooclens.llm.common import stored
from mooclens.llm.components import components

BLOCK = 20_000
#: Elements of the sets that a block holds in step 4.
ELEMENTS = 1_000_000
#: Sets that are compared with one at a time.
SLAB = 256
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def filled_bins(n: np.ndarray, bins: int) -> np.ndarray:
    return bins * (1 - np.exp(-np.maximum(n, 1) / bins))


def allowed(agree: np.ndarray, chance: np.ndarray, n: np.ndarray, bins: int, threshold: float, errors: float = -5) -> np.ndarray:
    """Whether a share of agreeing registers, corrected for the chance that
    different minima give equal registers, is compatible with a similarity
    of ``threshold``, n being the smaller set's size: not below it by more
    than five standard errors (or above it by ``errors``)."""
    estimate = (agree - chance) / (1 - chance)
    error = np.sqrt(threshold * (1 - threshold) / filled_bins(n, bins))
    return estimate >= np.minimum(threshold + errors * error, 1)


def _matrix(blobs, bins: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint16).reshape(-1, bins)


def _meeting(items: DataFrame, shared: Members) -> DataFrame:
    """(node, band, key) of the items' keys that ``shared`` may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            keys = t.column("keys").flatten().to_numpy()
            hit = np.flatnonzero(shared.hold(keys))
            bands = len(keys) // t.num_rows
            node = t.column("node").to_numpy()[hit // bands]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array((hit % bands).astype(np.int32)), pa.array(keys[hit])], ["node", "band", "key"])

    return items.select("node", "keys").mapInArrow(run, "node long, band int, key long")


def _estimated(pairs: DataFrame, info: DataFrame, bins: int, threshold: float, chance: Callable, sized: bool) -> DataFrame:
    """Pairs whose set sizes and registers allow the threshold."""
    least = threshold if sized else 0.0
    both = (
        pairs.join(info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
        .join(info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
        .where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            na, nb = t.column("na").to_numpy(), t.column("nb").to_numpy()
            ra, rb = (_matrix(t.column(c).to_pylist(), bins) for c in ("ra", "rb"))
            ok = allowed((ra == rb).mean(axis=1), chance(na, nb), np.minimum(na, nb), bins, threshold)
            yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(ok)) for c in ("a", "b")], schema=_PAIR)

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def similarity(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two ascending distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum()) if len(y) else 0
    return common, len(x) + len(y) - common


def packed_sets(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in blobs]


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, unpack: Callable) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on whole sets."""
    whole = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for at in range(0, t.num_rows, 500):
                left, right = (t.column(c).slice(at, 500).to_pylist() for c in ("sa", "sb"))
                distinct = list(dict.fromkeys([*left, *right]))
                whole = dict(zip(distinct, unpack(distinct), strict=True))
                for x, y in zip(left, right, strict=True):
                    inter, union = similarity(whole[x], whole[y])
                    ok.append(100 * inter >= percent * union and union > 0)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(c).filter(keep) for c in ("a", "b")], schema=_PAIR)

    return whole.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


class _Bucket:
    """Items of one bucket, or of two blocks of it."""

    def __init__(self, cols: dict[str, np.ndarray], regs: np.ndarray, allows: Callable, least: float, band_size: int):
        self.label, self.n, self.node, self.block = (cols[c] for c in ("label", "n", "node", "block"))
        self.band, self.blocks = int(cols["band"][0]), (int(cols["i"][0]), int(cols["j"][0]))
        self.regs, self.allows, self.least, self.band_size = regs, allows, least, band_size
        labels, size = np.unique(self.label, return_counts=True)
        #: The component that most of them are in.
        self.big = labels[size.argmax()]

    def outside(self) -> np.ndarray:
        return np.flatnonzero(self.label != self.big)

    def partners(self, r: int, there: np.ndarray, first: bool = False, errors: float = -5) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``there`` in other components than r (and in the other
        block) that sizes and registers allow, and shares of equal registers;
        with ``first`` not those that an earlier band brings together."""
        other = self.label[there] != self.label[r]
        if self.blocks[0] != self.blocks[1]:
            other &= self.block[there] != self.block[r]
        other &= np.minimum(self.n[there], self.n[r]) >= self.least * np.maximum(self.n[there], self.n[r]) - 1e-9
        m = there[other]
        same = self.regs[m] == self.regs[r]
        agree = same.mean(axis=1)
        ok = np.flatnonzero(self.allows(agree, self.n[m], self.n[r], errors))
        if first:
            before = same[ok, : self.band * self.band_size].reshape(len(ok), self.band, self.band_size)
            ok = ok[~before.all(axis=2).any(axis=1)]
        return m[ok], agree[ok]


def _forest(bucket: _Bucket) -> list[tuple[int, int]]:
    """Pairs that would tie the components together: a spanning forest of the
    likeliest ones, grown from the largest component. Fewer than items.
    Pairs with the centre have been tried."""
    free = bucket.node != bucket.node.min()
    todo, inside = np.flatnonzero(free & (bucket.label != bucket.big)), np.flatnonzero(free & (bucket.label == bucket.big))
    best, via = np.full(len(bucket.node), -1.0), np.zeros(len(bucket.node), np.int64)
    for r in todo:
        m, agree = bucket.partners(r, inside, errors=1)
        if len(m):
            best[r], via[r] = agree.max(), m[agree.argmax()]
    out = []
    while len(todo):
        r = todo[best[todo].argmax()]
        if best[r] >= 0:
            out.append((bucket.node[r], bucket.node[via[r]]))
        joins = bucket.label[todo] == bucket.label[r]
        new, todo = todo[joins], todo[~joins]
        for x in new:
            m, agree = bucket.partners(x, todo, errors=1)
            nearer = agree > best[m]
            best[m[nearer]], via[m[nearer]] = agree[nearer], x
    return out


def _open(bucket: _Bucket) -> np.ndarray:
    """Which items have a partner that is not ruled out."""
    seen = np.zeros(len(bucket.node), bool)
    everyone = np.arange(len(seen))
    for r in bucket.outside():
        m, _ = bucket.partners(r, everyone, first=True)
        seen[m] = True
        seen[r] |= len(m) > 0
    return seen


def _true_links(bucket: _Bucket, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components, confirmed on whole sets: each pair that is
    not ruled out is compared until its components are one."""
    size = np.array([len(x) for x in sets])
    end = np.cumsum(size)
    kinds, code = np.unique(np.concatenate(sets), return_inverse=True)
    kinds, code = len(kinds), code.astype(np.int32)
    own = [code[e - k : e] for e, k in zip(end.tolist(), size.tolist(), strict=True)]
    mark = np.zeros(kinds, bool)
    everyone = np.arange(len(sets))
    out = []
    for r in bucket.outside():
        if bucket.label[r] == bucket.big:  # tied by an earlier turn, which looked at its other pairs or leaves them to later ones
            continue
        m, agree = bucket.partners(r, everyone, first=True)
        m = m[np.argsort(-agree, kind="stable")]
        mark[own[r]] = True
        for at in (0, *range(8, len(m), SLAB)):
            some = m[at : at + (SLAB if at else 8)]
            some = some[bucket.label[some] != bucket.label[r]]
            if not len(some):
                continue
            hits = mark[np.concatenate([own[x] for x in some])]
            common = np.bincount(np.repeat(np.arange(len(some)), size[some]), hits, len(some)).astype(np.int64)
            union = size[some] + size[r] - common
            linked = some[(100 * common >= percent * union) & (union > 0)]
            labels, first = np.unique(bucket.label[linked], return_index=True)
            out += [(bucket.node[r], bucket.node[x]) for x in linked[first]]
            one = np.append(labels, bucket.label[r])
            bucket.label[np.isin(bucket.label, one)] = bucket.big if bucket.big in one else bucket.label[r]
        mark[own[r]] = False
    return out


def _across(bins: int, band_size: int, threshold: float, chance: Callable, sized: bool, work: Callable, result: Callable):
    """``result`` of what ``work`` finds in each bucket (given its items and
    its rows). Rows come sorted by bucket: many small buckets are worked
    through in one batch."""
    least = threshold if sized else 0.0

    def allows(agree: np.ndarray, n: np.ndarray, own: int, errors: float) -> np.ndarray:
        return allowed(agree, chance(n, np.full(len(n), own)), np.minimum(n, own), bins, threshold, errors)

    def of(t: pa.Table, start: int, end: int) -> list:
        """What is found in the whole buckets in rows start to end."""
        cols = {c: t.column(c).to_numpy()[start:end] for c in ("key", "i", "j", "band", "block", "label", "n", "node")}
        cuts = np.flatnonzero(_starts(cols["key"], cols["i"], cols["j"])).tolist() + [end - start]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = t.slice(start + a, b - a)
            own = {c: x[a:b].copy() for c, x in cols.items()}
            out += work(_Bucket(own, _matrix(rows.column("regs").to_pylist(), bins), allows, least, band_size), rows)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for t in batches:
            if not t.num_rows:
                continue
            first = np.flatnonzero(_starts(*(t.column(c).to_numpy() for c in ("key", "i", "j")), held[-1] if held else None))
            if held and not len(first):
                held.append(t)
                continue
            whole = pa.Table.from_batches([*held, t])
            end = whole.num_rows - t.num_rows + int(first[-1])
            yield result(of(whole, 0, end))
            held = whole.slice(end).combine_chunks().to_batches()
        if held:
            whole = pa.Table.from_batches(held)
            yield result(of(whole, 0, whole.num_rows))

    return run


def _starts(key: np.ndarray, i: np.ndarray, j: np.ndarray, before: pa.RecordBatch | None = None) -> np.ndarray:
    """Where a row's bucket differs from that of the row before it."""
    out = np.ones(len(key), bool)
    out[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    if before is not None and len(key):
        last = before.slice(before.num_rows - 1)
        out[0] = (key[0], i[0], j[0]) != tuple(last.column(c)[0].as_py() for c in ("key", "i", "j"))
    return out


def _pairs(found: list) -> pa.RecordBatch:
    rows = np.array(sorted({(min(x), max(x)) for x in found}), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], schema=_PAIR)


_ITEM = ["key", "band", "node", "label", "n"]


def _open_rows(bucket: _Bucket, rows: pa.Table) -> list[pa.Table]:
    return [rows.select(_ITEM).filter(pa.array(_open(bucket)))]


def _tables(found: list[pa.Table]) -> pa.RecordBatch:
    whole = pa.concat_tables(found).combine_chunks()
    return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in whole.columns], _ITEM)


def grouped(
    items: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    bins: int,
    band_size: int,
    percent: int,
    chance: Callable,
    sized: bool = True,
    unpack: Callable = packed_sets,
) -> DataFrame:
    """(node, label) for all items that have a link.

    ``sets_of(nodes)`` gives (node, set) for the nodes asked for, and
    ``unpack`` turns such values into whole sets, arrays of ascending
    distinct hashes. ``chance(na, nb)`` is the probability that registers of different minima agree. Unless ``sized``, n is only a
    lower bound of the set's size and says nothing about size ratios.
    """
    threshold = percent / 100
    bands = items.select("node", F.explode("keys").alias("key"))
    centres = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key", "lo")
    centres = stored(centres, "near-centres")
    meeting = _meeting(items, Members(centres, "key"))
    shared = stored(meeting.join(centres, "key").distinct(), "near-buckets")
    # an item may be listed more than once, each time alike
    involved = shared.select("node").distinct()
    touched = Members(involved, "node").of(items.select("node", "n", "regs"), "node")
    info = touched.join(involved, "node", "left_semi")
    info = stored(info.dropDuplicates(["node"]), "near-items")
    central = shared.where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
    tried = stored(_estimated(central, info, bins, threshold, chance, sized), "near-tried")

    def confirmed(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return stored(_confirmed(pairs, stored(sets_of(nodes), "near-sets"), percent, unpack), "near-links")

    links = confirmed(tried)
    labels = components(links)

    def buckets(rows: DataFrame, limits: list) -> DataFrame:
        """The items of ``rows`` (key, band, node, label, ...)
        for each pair of blocks, which hold at most about ``limits`` (values
        to sum up, and bounds)."""
        cut = rows.groupBy("key").agg(F.ceil(F.greatest(F.lit(1.0), *[F.sum(x) / most for x, most in limits])).cast("int").alias("blocks"))
        both = (
            rows.join(cut, "key")
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("block", "with"))
            .withColumn("j", F.greatest("block", "with"))
        )
        return both.drop("blocks", "with")

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def divided(labels: DataFrame) -> DataFrame:
        """(key, band, node, label, n, regs, block, i, j) of buckets with
        items of several components."""
        named = shared.select("key", "band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("rows"))
        left = named.join(several.where("x < y and rows > 2").select("key"), "key")
        return buckets(left, [(F.lit(1.0), BLOCK)]).join(info, "node")

    def across(work: Callable, result: Callable) -> Callable:
        return _across(bins, band_size, threshold, chance, sized, work, result)

    # at most one pair an item: pairs with a centre have been tried
    likely = in_order(divided(labels)).mapInArrow(across(lambda b, _: _forest(b), _pairs), "a long, b long").distinct()
    found = confirmed(stored(likely.join(tried, ["a", "b"], "left_anti"), "near-likely"))
    if not found.isEmpty():
        links = links.unionByName(found)
        labels = components(links)
    # the rest exactly: items with a pair that is still open, then such pairs on their sets
    open_ = in_order(divided(labels)).mapInArrow(across(_open_rows, _tables), "key long, band int, node long, label long, n long")
    open_ = stored(open_.distinct(), "near-open")
    if open_.isEmpty():
        return labels
    sets = stored(sets_of(open_.select("node").distinct()), "near-sets")
    whole = buckets(open_, [(F.lit(1.0), BLOCK), (F.col("n"), ELEMENTS)]).join(info.select("node", "regs"), "node").join(sets, "node")

    def compared(bucket: _Bucket, rows: pa.Table) -> list:
        return _true_links(bucket, unpack(rows.column("set").to_pylist()), percent)

    found = stored(in_order(whole).mapInArrow(across(compared, _pairs), "a long, b long").distinct(), "near-links")
    return labels if found.isEmpty() else components(links.unionByName(found))
