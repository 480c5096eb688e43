"""Exact order statistics by distributed selection.

A sketch of each key's values gives a bracket close around each rank that is wanted. Values in a
bracket are counted one by one, equal ones as one row; all others only by the bracket below which
they lie. Sums of these counts locate every rank exactly. No task holds or sorts all values of a
key, but about ``BRACKET`` of them for each quantile. With ``levels`` above one, bins are located and
cut again first: a hundredth of that is left after each further level, whatever the sketch is worth.

Values that are null are left out, NaN is above all others, null keys are keys. The rows are read
twice (and twice more a level), so give a stored table or a cheap one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of the sketch: ranks are right to one part in so many.
ACCURACY = 10_000
#: How far, in such parts, cuts lie from the rank that is wanted: three times what the sketch may be off.
REACH = 3
#: Values of a key that are counted one by one anyway: fewer, and a bracket would be a few ranks wide.
SMALL = 20_000
#: Share of a key's values that a bracket holds.
BRACKET = 2 * (REACH + 1) / ACCURACY
#: Equal parts into which each further level cuts a bin.
PARTS = 128

#: Ranks (from 0, ascending) and their weights, from the number of values.
Ranks = Callable[[Column], list[tuple[Column, Column]]]


def at_quantile(q: float) -> Ranks:
    """Linear between the two ranks beside q * (n - 1)."""

    def ranks(n: Column) -> list[tuple[Column, Column]]:
        place = F.lit(float(q)) * (n - 1)
        low = F.floor(place)
        return [(low, low + 1 - place), (low + 1, place - low)]

    return ranks


def at_top(percent: float) -> Ranks:
    """The least of the largest ``percent`` of all values, of which there is one at least."""
    return lambda n: [(n - top_count(n, percent), F.lit(1.0))]


def top_count(n: Column, percent: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * percent / 100))


def selected(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str | Column, float, Ranks]], levels: int = 1) -> DataFrame:
    """``keys`` and one column for each name of ``wanted``: (value, fraction about which the ranks lie, ranks).

    A key without any value has nulls.
    """
    values = {str(v): (v if isinstance(v, Column) else F.col(v)).cast("double") for v, _, _ in wanted.values()}
    places = list(values)
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), v.alias("v")) for i, v in enumerate(values.values())]))
    rows = df.select(key.alias("key"), stacked.alias("x")).select(F.struct("key", "x.m").alias("g"), "x.v").where("v IS NOT NULL")

    around = sorted({q for _, q, _ in wanted.values()})
    near = [min(1.0, max(0.0, q + side * REACH / ACCURACY)) for side in (-1, 1) for q in around]
    n = F.col("n")
    by_value = [
        [F.struct(F.lit(j).alias("j"), r.cast("long").alias("r"), w.cast("double").alias("w")) for j, (v, _, ranks) in enumerate(wanted.values()) if str(v) == name for r, w in ranks(n)]
        for name in places
    ]
    ranks = F.element_at(F.array(*[F.filter(F.array(*x), lambda s: s["w"] > 0) for x in by_value]), F.col("g.m") + 1)
    sketch = rows.groupBy("g").agg(F.percentile_approx("v", F.array(*[F.lit(q) for q in near]), ACCURACY).alias("cuts"), F.count("*").alias("n"))
    if levels == 1:
        counted = _bracketed(rows, sketch, len(around)).withColumn("ranks", ranks)
    else:
        sketch = sketch.select("g", F.array_sort(F.array_distinct("cuts")).alias("cuts"), ranks.alias("ranks"))
        for level in range(levels - 1):
            if level:
                parts = F.percentile_approx("v", F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), 10 * PARTS)
                sketch = rows.groupBy("g").agg(F.array_sort(F.array_distinct(parts)).alias("cuts")).join(held, "g")
            rows, held = _narrowed(rows, sketch)
        counted = rows.groupBy("g", "v").agg(F.count("*").alias("c")).join(held, "g").withColumn("upto", F.sum("c").over(Window.partitionBy("g").orderBy("v")))
    t = F.explode(_inside("ranks", F.col("upto") - F.col("c"), F.col("upto"))).alias("t")
    found = counted.select(F.col(".".join(["g", *["g"] * (levels - 1), "key"])).alias("key"), "v", t)
    # a rank outside its bracket: the sketch was three times as far off as it may be
    value = F.coalesce("v", F.raise_error(F.lit("a rank lies outside its bracket: select with levels=2")).cast("double"))
    best = [F.sum(F.when(F.col("t.j") == j, F.col("t.w") * value)).alias(name) for j, name in enumerate(wanted)]
    return found.groupBy("key").agg(*best).select(*[F.col("key")[k].alias(k) for k in keys], *wanted)


def _bracketed(rows: DataFrame, sketch: DataFrame, brackets: int) -> DataFrame:
    """g, v, c, upto, n: how often each value of a bracket occurs and how many values lie up to it; a row without v stands
    for those above one bracket and below the next."""
    ends = sketch.select("g", "n", F.slice("cuts", 1, brackets).alias("lows"), F.slice("cuts", brackets + 1, brackets).alias("highs"))
    v = F.col("v")
    inside = (F.col("n") <= SMALL) | F.exists(F.zip_with("lows", "highs", lambda a, b: (v >= a) & (v <= b)), lambda x: x)
    at = F.size(F.filter("highs", lambda h: h < v))
    placed = rows.join(ends, "g").select("g", "n", at.alias("bin"), F.when(inside, v).alias("v"))
    counted = placed.groupBy("g", "bin", "v").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    w = Window.partitionBy("g").orderBy("bin", F.col("v").asc_nulls_first())
    return counted.withColumn("upto", F.sum("c").over(w))


def _inside(ranks: str, begin: Column, end: Column) -> Column:
    """The ranks from ``begin`` on and below ``end``."""
    return F.filter(ranks, lambda t: (t["r"] >= begin) & (t["r"] < end))


def _narrowed(rows: DataFrame, sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the bins that hold a wanted rank, and the ranks within each of these bins."""
    binned = rows.join(sketch.select("g", "cuts"), "g").select(F.struct("g", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bin")).alias("g"), "v")
    bins = binned.groupBy("g").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("g.g").orderBy("g.bin")))
    begin = F.col("upto") - F.col("c")
    bins = bins.join(sketch.select(F.col("g").alias("_g"), "ranks"), F.col("g.g") == F.col("_g"))
    inside = F.transform(_inside("ranks", begin, F.col("upto")), lambda t: F.struct(t["j"].alias("j"), (t["r"] - begin).alias("r"), t["w"].alias("w")))
    held = bins.select("g", inside.alias("ranks")).where(F.size("ranks") > 0)
    return binned.join(held.select("g"), "g", "left_semi"), held


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str | Column, float]], levels: int = 1) -> DataFrame:
    """``keys`` and exact quantiles, linear between ranks: name -> (value, q)."""
    return selected(df, keys, {name: (v, q, at_quantile(q)) for name, (v, q) in wanted.items()}, levels)


def joined(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``other``, a row of each key; null keys are equal."""
    if not keys:
        return df.withColumn("_one", F.lit(1)).join(other.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    right = other.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(right, same, "left").drop(*[f"_{k}" for k in keys])
