"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

Each source's rows form blocks of ``block_rows``. With weight w a source's block i is released at
slot floor(i / w) and due by slot ceil((i + 1) / w); each slot goes to the released block with the
earliest deadline. While no source runs out, each has had within one block of its share at every
slot. Weights are whole numbers of ``slots`` (their sum), so the schedule repeats with that period
and one period, of bounded size, is all that is worked out; every row then finds its slot from its
place in its source. When a source runs out its later slots stay empty and the others go on in their
proportions; every row has exactly one place.

A source's rows are numbered without gathering them: they are dealt over shards of about
``shard_rows`` by a hash, numbered in each, and the shards' counts are summed.

Defined results: a null source is a source of its own; rows that repeat are placed each; sources
without a target get one slot; no target at all means weights by the square root of row counts; extra
columns are carried by ``mixed`` and ignored by ``schedule``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 1000
BLOCK_ROWS = 16
SHARD_ROWS = 2_000
#: More sources than this are not a mixture to plan for: the plan, one row for each, goes to the driver.
MAX_SOURCES = 10_000
_P = "_mix_"


def whole_weights(weights: dict, slots: int) -> dict:
    """Whole numbers of at least one that add up to ``slots``, nearest to the shares by largest remainder."""
    total = sum(weights.values())
    exact = {s: slots * w / total if total else 0.0 for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    rank = lambda s: (exact[s] - out[s], repr(s))
    while (gap := slots - sum(out.values())) != 0:
        some = sorted((s for s in out if gap > 0 or out[s] > 1), key=rank, reverse=gap > 0)[: abs(gap)]
        for s in some:
            out[s] += 1 if gap > 0 else -1
    return out


def period(weights: list[int]) -> Column:
    """The source that each slot of one period belongs to, by earliest deadline first."""
    slots = sum(weights)
    k = F.array(*[F.lit(w) for w in weights])
    start = F.struct(F.array_repeat(F.lit(0), len(weights)).alias("done"), F.array().cast("array<int>").alias("order"))

    def step(state: Column, t: Column) -> Column:
        due = lambda done, w: F.ceil((done + 1) * F.lit(slots) / w).cast("int")
        release = lambda done, w: F.floor(done * F.lit(slots) / w)
        waiting = F.zip_with(state["done"], k, lambda d, w: F.when(release(d, w) <= t, due(d, w)))
        ranked = F.transform(waiting, lambda d, i: F.when(d.isNotNull(), F.struct(d.alias("due"), i.alias("at"))))

        def taken(choice: Column) -> Column:
            done = F.transform(state["done"], lambda d, i: F.when(i == choice["at"], d + 1).otherwise(d))
            return F.struct(done.alias("done"), F.concat(state["order"], F.array(choice["at"])).alias("order"))

        return F.transform(F.array(F.array_min(ranked)), taken)[0]

    return F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), start, step, lambda s: s["order"])


def _placed(docs: DataFrame, target: dict | None, block_rows: int, slots: int, shard_rows: int) -> DataFrame:
    """``docs`` with block, slot and place within the block, in columns of their own."""
    spark = docs.sparkSession
    counts = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not counts:
        return docs.withColumns({f"{_P}{c}": F.lit(None).cast("long") for c in ("block", "slot", "at")})
    slots = max(slots, 2 * len(counts))
    weights = whole_weights({s: n**0.5 for s, n in counts.items()} if target is None else {s: float(target.get(s, 0.0)) for s in counts}, slots)
    names = sorted(counts, key=lambda s: (s is not None, s))
    plan = spark.createDataFrame([(i, s, weights[s], -(-counts[s] // shard_rows)) for i, s in enumerate(names)], f"{_P}no int, {_P}source string, {_P}k int, {_P}shards int")
    order = spark.range(1).select(F.posexplode(period([weights[s] for s in names])).alias(f"{_P}offset", f"{_P}no"))
    turn = order.withColumn(f"{_P}turn", F.row_number().over(Window.partitionBy(f"{_P}no").orderBy(f"{_P}offset")) - 1)

    known = docs.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col(f"{_P}source"))).drop(f"{_P}source")
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.col(f"{_P}shards")).cast("int")
    known = known.withColumns({f"{_P}shard": shard, f"{_P}hash": F.xxhash64("doc_id", F.lit("order"))})
    sizes = known.groupBy(f"{_P}no", f"{_P}shard").agg(F.count("*").alias(f"{_P}size"))
    before = Window.partitionBy(f"{_P}no").orderBy(f"{_P}shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(f"{_P}no", f"{_P}shard", F.coalesce(F.sum(f"{_P}size").over(before), F.lit(0)).alias(f"{_P}start"))
    tie = [c for c in ("doc_id", "text", "ids") if c in docs.columns]
    within = Window.partitionBy(f"{_P}no", f"{_P}shard").orderBy(f"{_P}hash", *tie)
    numbered = known.withColumn(f"{_P}rank", F.row_number().over(within) - 1).join(starts, [f"{_P}no", f"{_P}shard"])
    place = F.col(f"{_P}start") + F.col(f"{_P}rank")
    blocks = numbered.withColumns({f"{_P}block": F.floor(place / block_rows), f"{_P}at": (place % block_rows).cast("long")})
    blocks = blocks.withColumn(f"{_P}turn", (F.col(f"{_P}block") % F.col(f"{_P}k")).cast("int"))
    # one period of the schedule: ``slots`` rows
    slotted = blocks.join(F.broadcast(turn), [f"{_P}no", f"{_P}turn"])
    return slotted.withColumn(f"{_P}slot", F.floor(F.col(f"{_P}block") / F.col(f"{_P}k")) * slots + F.col(f"{_P}offset"))


def schedule(docs: DataFrame, target: dict | None = None, block_rows: int = BLOCK_ROWS, slots: int = SLOTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, source, block (within the source), slot and position (of the row in the mixture) of every row.

    Positions: rows are counted by slot, then by period; only the periods' counts, one for each
    ``slots`` blocks, are summed in one task.
    """
    rows = _placed(docs.select("doc_id", "source"), target, block_rows, slots, shard_rows)
    rows = rows.select("doc_id", "source", F.col(f"{_P}block").alias("block"), F.col(f"{_P}slot").alias("slot"), F.col(f"{_P}at").alias("at"))
    width = max(slots, 1)
    by_slot = rows.groupBy("slot").agg(F.count("*").alias("n")).withColumn("period", F.floor(F.col("slot") / width))
    by_period = by_slot.groupBy("period").agg(F.sum("n").alias("n"))
    earlier = by_period.select("period", (F.sum("n").over(Window.orderBy("period")) - F.col("n")).alias("earlier"))
    running = Window.partitionBy("period").orderBy("slot")
    first = by_slot.select("slot", "period", (F.sum("n").over(running) - F.col("n")).alias("inside")).join(earlier, "period").select("slot", (F.col("inside") + F.col("earlier")).alias("first"))
    return rows.join(first, "slot").select("doc_id", "source", "block", "slot", (F.col("first") + F.col("at")).alias("position"))


def mixed(docs: DataFrame, target: dict | None = None, block_rows: int = BLOCK_ROWS, slots: int = SLOTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, with their own columns only: partitions are
    consecutive stretches of it. Stored and read again, rows have no order: ``schedule`` has their positions."""
    rows = _placed(docs, target, block_rows, slots, shard_rows)
    return rows.repartitionByRange(f"{_P}slot", f"{_P}at").sortWithinPartitions(f"{_P}slot", f"{_P}at").select(*[F.col(f"`{c}`") for c in docs.columns])
