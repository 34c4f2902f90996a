"""Repair of conversations: the cheapest edits that make the turns follow
``(s?(ua)+)?``, with an audit of them.

Turns become symbols (repair_grammar.py). Conversations are cut into blocks
of about ``BLOCK`` symbols, equal blocks are worked out once, Re-Pair rules
learnt over all different blocks have one transfer matrix each, and a block's
matrix is the product over its compressed symbols. Blocks of one conversation
are joined ``FAN`` at a time. A conversation that holds a third of all turns
is many blocks; only its audit (a byte a turn, part of the result) and the
digest of its repaired text, which SHA-256 defines from the first byte to the
last, are made in one place: the text streams through a task in order and is
never held.

Rows: a null role or text is one space. Turns are taken in order, nulls
first; rows of equal turn by role and SHA-256 of the text, equal rows one
after another. The first fault counts: blank (nothing but white space),
duplicate (role and text seen earlier in the conversation), truncated (the
last other character is not one of .!?).

Edge cases: a null conv_id is a conversation; one of whose rows none is left
has no faults, cost 0, an empty audit and the digest of nothing; roles other
than those beginning with s, u or a are never kept; very long texts stream;
other columns are not read, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooclens.llm import repair_grammar as rg
from mooclens.llm.common import ship, stored
from mooclens.operators.prefix import prefix_sums

BLOCK = 4096
FAN = 32
#: Rules of the grammar; a rule must replace this many pairs.
MAX_RULES = 64
LEAST_PAIRS = 4
WHITE = " \t\n\x0b\f\r"
NOTHING = hashlib.sha256(b"").hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` (conv_id, turn, role, text) with faults planted by
    crc32 of "conv_id:turn": one in twenty each is dropped, emptied, robbed of
    its .!?, repeated (copies = 2) or given the role user."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _symbol(fault: Column) -> Column:
    initial = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in "sua"]), F.substring("role", 1, 1)), F.lit(0))
    role = F.when(initial == 0, 3).otherwise(initial - 1)
    return F.char(F.lit(rg.FIRST) + role * 4 + fault)


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, part, symbols): one row for equal turns
    of a conversation, in pieces of at most ``BLOCK`` symbols."""
    rest = F.rtrim("text", F.lit(WHITE))
    lines = rows.select("conv_id", "turn", "role", _digest().alias("digest"), "copies", rest.alias("rest"))
    lines = lines.select(
        "conv_id", "turn", "role", "digest", "copies",
        F.when(F.col("rest") == "", rg.BLANK)
        .when(~F.substring("rest", -1, 1).isin(".", "!", "?"), rg.TRUNCATED)
        .otherwise(rg.OK).alias("fault"),
    )
    lines = lines.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.min("fault").alias("fault"))
    lines = stored(lines, "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = lines.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(when).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    met = lines.join(first, same).withColumn("new", when == F.col("first"))
    blank = F.col("fault") == rg.BLANK
    again = F.when(blank, F.lit(rg.BLANK)).otherwise(rg.DUPLICATE)
    one = F.when(blank | F.col("new"), F.col("fault")).otherwise(rg.DUPLICATE)
    pieces = met.select("conv_id", "turn", "role", "digest", "n", _symbol(one).alias("one"), _symbol(again).alias("again"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("part"))
    size = F.least(F.lit(BLOCK).cast("long"), F.col("n") - F.col("part") * BLOCK).cast("int")
    text = F.when(F.col("part") == 0, F.concat("one", F.expr("repeat(again, cast(size - 1 as int))"))).otherwise(F.expr("repeat(again, size)"))
    return pieces.withColumn("size", size).select("conv_id", "turn", "role", "digest", "part", text.alias("symbols"))


def blocks(pieces: DataFrame) -> DataFrame:
    """(conv_id, block, symbols): symbols in order, cut into blocks."""
    order = ["turn", "role", "digest", "part"]
    placed = prefix_sums(pieces, ["conv_id"], order, {"at": F.length("symbols").cast("long")}, inclusive=False)
    held = placed.groupBy("conv_id", F.floor(F.col("at") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", "symbols"))).alias("found")
    )
    return held.select("conv_id", "block", F.array_join(F.col("found.symbols"), "").alias("symbols"))


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = Counter()
    for t in batches:
        for x in t.column("short").to_pylist():
            total += rg.pairs(x)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["pair", "n"])


def learn(different: DataFrame, most: int = MAX_RULES, least: int = LEAST_PAIRS) -> tuple[rg.Grammar, DataFrame]:
    """A grammar over all rows of ``different`` (symbols), and those rows with
    their compressed form (short). Rounds replace the most frequent pairs
    that share no symbol; the driver sees at most (16 + rules)^2 counts."""
    grammar = rg.Grammar()
    rows = different.select("symbols", F.col("symbols").alias("short"))
    while len(grammar.rules) < most:
        counts = rows.mapInArrow(_pair_counts, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        found = [(x.pair, x.n) for x in counts.where(F.col("n") >= least).collect()]
        new = rg.apart(found, most - len(grammar.rules))
        if not new:
            break
        since = len(grammar.rules)
        grammar.extend(new)
        short = F.col("short")
        for k, pair in enumerate(new, since):
            short = F.replace(short, F.lit(pair), F.lit(chr(rg.RULES + k)))
        rows = stored(rows.select("symbols", short.alias("short")), "short")
    return grammar, rows


_MATRIX = "costs array<int>, audits array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string"
_FACTS = ["costs", "audits", "blank", "duplicate", "truncated", "illegal", "first", "last"]


def _facts(symbols: str) -> list:
    """What is counted over the symbols themselves."""
    role, fault = zip(*((rg.ROLES[k // 4], k % 4) for k in (ord(x) - rg.FIRST for x in symbols)), strict=True)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(role, role[1:], strict=False))
    return [*(fault.count(k) for k in (rg.BLANK, rg.DUPLICATE, rg.TRUNCATED)), illegal, role[0], role[-1]]


def _evaluated(rules: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = rg.Grammar(rules)
        for t in batches:
            rows = []
            for symbols, short in zip(t.column("symbols").to_pylist(), t.column("short").to_pylist(), strict=True):
                rows.append([symbols, *rg.packed(grammar.evaluate(short)), *_facts(symbols)])
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), *[pa.int64()] * 4, pa.string(), pa.string()]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["symbols", *_FACTS])

    return run


def _joined(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Consecutive blocks of a conversation as one."""
    group = group.sort_values("block")
    matrix, out = None, None
    for x in group.itertuples(index=False):
        own = rg.unpacked(x.costs, x.audits)
        facts = [x.blank, x.duplicate, x.truncated, x.illegal, x.first, x.last]
        if matrix is None:
            matrix, out = own, facts
            continue
        matrix = rg.product(matrix, own)
        border = out[5] + x.first not in ("su", "ua", "au")
        out = [out[0] + x.blank, out[1] + x.duplicate, out[2] + x.truncated, out[3] + x.illegal + border, out[4], x.last]
    costs, audits = rg.packed(matrix)
    row = dict(zip(_FACTS, [costs, audits, *out], strict=True))
    return pd.DataFrame([{"conv_id": group["conv_id"].iloc[0], "block": key[1]} | row])


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        both = zip(t.column("costs").to_pylist(), t.column("audits").to_pylist(), strict=True)
        found = [rg.best(rg.unpacked(*x)) for x in both]
        t = t.select(["conv_id", "blank", "duplicate", "truncated", "illegal"])
        t = t.append_column("cost", pa.array([x for x, _ in found], pa.int64()))
        yield t.append_column("audit", pa.array([x for _, x in found], pa.string()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation's repaired text. Rows come in order: a
    conversation's audit, then its turns."""
    conv, audit, place, state, digest, empty = None, None, 0, 0, None, True

    def said(role: str, text: str) -> None:
        nonlocal empty
        digest.update((("" if empty else "\n") + role + ":" + text).encode())
        empty = False

    def inserted() -> None:
        nonlocal place, state
        while place < len(audit) and audit[place] == "I":
            state = rg.NEXT[state]
            said("user" if state == 2 else "assistant", "")
            place += 1

    def ended() -> Iterator[tuple]:
        if audit is not None:
            inserted()
            yield conv, digest.hexdigest()

    for t in batches:
        out = []
        for c, is_turn, role, text, copies in zip(*(t.column(x).to_pylist() for x in ("conv_id", "is_turn", "role", "text", "copies")), strict=True):
            if not is_turn:
                out += ended()
                conv, audit, place, state, digest, empty = c, text, 0, 0, hashlib.sha256(), True
                continue
            for _ in range(copies):
                inserted()
                edit = audit[place]
                place += 1
                if edit == "D":
                    continue
                if edit == "R":
                    state = rg.NEXT[state]
                    said("user" if state == 2 else "assistant", text)
                else:
                    state = {"s": 1, "u": 2, "a": 3}[role[:1]]
                    said(role, text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in ((0, t.schema.field("conv_id").type), (1, pa.string()))], ["conv_id", "repaired_sha256"])
    if audit is not None:
        out = list(ended())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in ((0, t.schema.field("conv_id").type), (1, pa.string()))], ["conv_id", "repaired_sha256"])


def _by_conversation(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("conv_id", "_conv")
    return left.join(right, left["conv_id"].eqNullSafe(right["_conv"]), "left").drop("_conv")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of each conversation in ``rows`` (conv_id, turn, role,
    text, copies)."""
    spark = rows.sparkSession
    ship(spark)
    held = stored(blocks(symbols(rows)), "blocks")
    grammar, short = learn(stored(held.select("symbols").distinct(), "different-blocks"))
    results = short.mapInArrow(_evaluated(grammar.rules), f"symbols string, {_MATRIX}")
    found = held.join(stored(results, "block-matrices"), "symbols").select("conv_id", "block", *_FACTS)
    most = held.agg(F.max("block")).first()[0] or 0
    kind = rows.schema["conv_id"].dataType.simpleString()
    while most > 0:  # conversations of more than one block
        several = F.floor(F.col("block") / FAN)
        found = found.groupBy("conv_id", several.alias("upper")).applyInPandas(_joined, f"conv_id {kind}, block long, {_MATRIX}")
        found = stored(found, "joined-blocks")
        most //= FAN
    schema = f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    best = stored(found.mapInArrow(_best, schema), "repairs")
    turns = rows.select("conv_id", F.lit(True).alias("is_turn"), "turn", "role", _digest().alias("digest"), "text", "copies")
    heads = best.select("conv_id", F.lit(False).alias("is_turn"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                        F.lit("").alias("role"), F.lit(b"").alias("digest"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
    stream = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "is_turn", "turn", "role", "digest")
    return _by_conversation(best, stream.mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string"))


def gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps): turn numbers that are missing between a
    conversation's least and greatest."""
    turns = rows.select("conv_id", "turn").distinct()
    missing = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv_id").agg(F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"))


def repaired(conversations: DataFrame) -> DataFrame:
    """Damage, then repair: a row for each conv_id of ``conversations``."""
    rows = damaged(conversations)
    out = _by_conversation(_by_conversation(conversations.select("conv_id").distinct(), gaps(rows)), repair(rows))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))
