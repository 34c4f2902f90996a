"""Which sources of a language use its words differently, and which words.

A first pass counts in how many documents of a language each term occurs,
exactly, and keeps those in ``MIN_DOCS`` or more. Minimal perfect hashes over
them are built in shards on the executors and broadcast; the second pass looks
every term up (stored keys settle what is no key) and increments dense slots,
one array for each (lang, source) group that a task meets. Shards go out in
rounds of at most ``ROUND_BYTES``, each with its own pass, so what is broadcast
has a bound whatever the vocabulary.

Terms are runs of letters (ASCII letters, A-Z lowered, and everything beyond
ASCII). Within a language with V kept terms, a group that has N occurrences
of them gives a term seen c times p = 1 + floor(1e9 (c + 5) / (N + 5 V)),
by integer arithmetic throughout. Parts of the result:

* ``pair``: for each other source of the language, the sum over all kept
  terms of the differences of p; all ranks.
* ``term``: the terms that the group has and whose p is above the language's,
  by how much; the first ``TOP`` ranks.

Pairs of sources are summed up in blocks of terms, cut by hash so that a
block holds about ``CELLS`` cells whatever the number of terms and sources: a
task emits a row a pair, not a row a pair and term.

Edge cases: null text, lang and source are empty strings; rows are counted as
they come, repeated doc_ids included; a group without terms is a group; a
language without kept terms has value 0 for its pairs and no terms; very long
texts are worked through whole. Columns other than text, lang and source are
not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mooclens.llm.common import ship, stored
from mooclens.llm.perfect_hash import SCHEMA, PerfectHash, build, hashed, joined, shard_of
from mooclens.llm.textnum import NOT_LETTERS, Layout, as_bytes, parts

MIN_DOCS = 30
TOP = 50
#: Keys of a shard, bytes of keys in a broadcast round, slots that a task holds,
#: cells (term, source) of a block.
SHARD_KEYS = 1 << 15
ROUND_BYTES = 64 << 20
SLOTS = 1 << 20
CELLS = 1 << 16
PART = 4 << 20
_GROUPS = "lang string, source string, term string, n long"


def _text_columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _terms(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the terms in order, the terms by code, bounds by text."""
    lay = Layout(texts, lower=True)
    start, end = lay.words(NOT_LETTERS)
    letters = lay.buf[~NOT_LETTERS[lay.buf]]
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]
    )
    found = words.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary, np.searchsorted(start, lay.begin)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, number of documents), added up for each part of a task."""
    for t in parts(batches, "text", PART):
        codes, terms, bounds = _terms(as_bytes(t.column("text")))
        langs = t.column("lang").dictionary_encode()
        if not len(codes):
            continue
        doc = np.repeat(np.arange(t.num_rows), np.diff(bounds))
        once = np.unique(doc * len(terms) + codes)
        lang = langs.indices.to_numpy()[once // len(terms)].astype(np.int64)
        pairs, n = np.unique(lang * len(terms) + once % len(terms), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(pairs // len(terms))).cast(pa.string()),
                terms.take(pa.array(pairs % len(terms))).cast(pa.string()),
                pa.array(n, pa.int64()),
            ],
            ["lang", "term", "n"],
        )


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) of the terms that occur in so many documents of a lang."""
    counts = _text_columns(docs).mapInArrow(_document_counts, "lang string, term string, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")


def _sharded(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keys = [joined(*x) for x in zip(t.column("lang").to_pylist(), t.column("term").to_pylist(), strict=True)]
            yield t.append_column("shard", pa.array(shard_of(hashed(keys), shards), pa.int32()))

    return run


def _build(group: pd.DataFrame) -> pd.DataFrame:
    keys = [joined(*x) for x in zip(group["lang"], group["term"], strict=True)]
    sizes, bits, order = build(hashed(keys))
    row = {"shard": group["shard"].iloc[0], "n": len(keys), "sizes": sizes, "bits": np.packbits(bits).tobytes()}
    row |= {c + "s": group[c].to_numpy()[order].tolist() for c in ("lang", "term")}
    return pd.DataFrame([row | {"bytes": sum(map(len, keys)) + 16 * len(keys)}])


def perfect_hashes(kept: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """A row for each shard, and the number of shards."""
    shards = kept.count() // shard_keys + 1
    numbered = kept.mapInArrow(_sharded(shards), "lang string, term string, shard int")
    return stored(numbered.groupBy("shard").applyInPandas(_build, SCHEMA), "perfect-hashes"), shards


def _counter(table, shards: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = PerfectHash(table.value, shards)
        slots: dict[tuple[str, str], np.ndarray] = {}
        held = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for (lang, source), dense in slots.items():
                seen = np.flatnonzero(dense)
                own = keys.lang_slots[lang][seen]
                columns = [pa.array([x] * len(seen), pa.string()) for x in (lang, source)]
                columns += [keys.terms.take(pa.array(own)).cast(pa.string()), pa.array(dense[seen])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n"])
            slots.clear()

        for t in parts(batches, "text", PART):
            codes, terms, bounds = _terms(as_bytes(t.column("text")))
            if not len(codes):
                continue
            both = list(zip(t.column("lang").to_pylist(), t.column("source").to_pylist(), strict=True))
            names = list(dict.fromkeys(both))
            numbers = {x: k for k, x in enumerate(names)}
            group = np.repeat(np.fromiter((numbers[x] for x in both), np.int64, len(both)), np.diff(bounds))
            cells, n = np.unique(group * len(terms) + codes, return_counts=True)
            group, code = cells // len(terms), cells % len(terms)
            words = terms.to_pylist()
            langs: dict[str, list[int]] = {}
            for (lang, _), k in numbers.items():
                langs.setdefault(lang, []).append(k)
            for lang, own in langs.items():
                if lang not in keys.lang_slots:
                    continue
                here = np.flatnonzero(np.isin(group, own))
                asked, back = np.unique(code[here], return_inverse=True)
                prefix = lang.encode() + b"\0"
                at = keys.positions([prefix + words[k] for k in asked.tolist()])[back]
                here, at = here[at >= 0], at[at >= 0]
                for k in own:
                    mine = group[here] == k
                    if names[k] not in slots:
                        slots[names[k]] = np.zeros(len(keys.lang_slots[lang]), np.int64)
                        held += len(slots[names[k]])
                    slots[names[k]][keys.local[at[mine]]] += n[here[mine]]
            if held > most:
                yield from emptied()
                held = 0
        yield from emptied()

    return run


def group_counts(docs: DataFrame, kept: DataFrame, round_bytes: int = ROUND_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(lang, source, term, n) of the kept terms that a group has."""
    spark = docs.sparkSession
    table, shards = perfect_hashes(kept, shard_keys)
    rounds, filled = [[]], 0
    for row in table.select("shard", "bytes").orderBy("shard").collect():  # a row for 32,768 keys
        if rounds[-1] and filled + row.bytes > round_bytes:
            rounds.append([])
            filled = 0
        rounds[-1].append(row.shard)
        filled += row.bytes
    found = None
    for own in rounds:
        some = table.where(F.col("shard").between(own[0], own[-1])) if own else table.limit(0)
        held = spark.sparkContext.broadcast(some.toArrow())
        counts = _text_columns(docs).mapInArrow(_counter(held, shards, SLOTS), _GROUPS)
        found = counts if found is None else found.unionByName(counts)
    return stored(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "group-counts")


def share(count: Column, total: str, terms: str) -> Column:
    """p of a term seen ``count`` times, from the group's total."""
    above = (count + 5).cast("decimal(20,0)") * F.lit(1000000000).cast("decimal(10,0)")
    below = (F.col(total) + 5 * F.col(terms)).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def _block_pairs(cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums of differences over the block's terms, for each pair of sources."""
    if not len(cells):
        return pd.DataFrame({c: [] for c in ("lang", "source", "item", "value")})
    terms, row = np.unique(cells["term"].to_numpy(object), return_inverse=True)
    sources = groups.sort_values("source").reset_index(drop=True)
    at = pd.Series(np.arange(len(sources)), sources["source"])[cells["source"]].to_numpy()
    p = np.empty((len(sources), len(terms)), np.int64)
    p[:] = sources["rest"].to_numpy()[:, None]
    p[at, row] = cells["p"].to_numpy()
    names = sources["source"].to_numpy(object)
    one, two, value = [], [], []
    for k in range(len(sources) - 1):
        one += [names[k]] * (len(names) - k - 1)
        two += names[k + 1 :].tolist()
        value.append(np.abs(p[k + 1 :] - p[k]).sum(axis=1))
    value = np.concatenate([np.zeros(0, np.int64), *value])
    return pd.DataFrame({"lang": cells["lang"].iloc[0], "source": one, "item": two, "value": value})


def divergence(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, round_bytes: int = ROUND_BYTES, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """(lang, source, part, item, value, rank) as in the module's text."""
    spark = docs.sparkSession
    ship(spark)
    kept = stored(kept_terms(docs, min_docs), "kept-terms")
    counts = group_counts(docs, kept, round_bytes, shard_keys)
    groups = stored(_text_columns(docs).select("lang", "source").distinct(), "groups")
    langs = (
        groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
        .join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang")
    )
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = groups.join(langs, "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    blocks = F.ceil(F.col("terms") * F.col("sources") / CELLS).cast("int")
    stats = stats.select("*", blocks.alias("blocks"), share(F.lit(0).cast("long"), "total", "terms").alias("rest"))
    cells = counts.join(stats, ["lang", "source"]).withColumn("p", share(F.col("n"), "total", "terms"))

    spread = stats.select("lang", "source", "rest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    blocked = cells.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"))
    sums = (
        blocked.groupBy("lang", "block")
        .cogroup(spread.groupBy("lang", "block"))
        .applyInPandas(_block_pairs, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    sums = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = (
        groups.join(other, "lang").where("source <> item")
        .join(sums, ["lang", "source", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    )

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    lang_totals = totals.groupBy("lang").agg(F.sum("total").alias("total")).join(langs, "lang")
    whole = whole.join(lang_totals, "lang").select("lang", "term", share(F.col("n"), "total", "terms").alias("q"))
    terms = cells.join(whole, ["lang", "term"]).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    def ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(order))

    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
