"""Liquidity statistics, tiers, ranks and point-in-time membership."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: names that point to funds.
FUND_NAMES = r"(ETF|ETN|FUND|TRUST|INDEX|PORTFOLIO|ISHARES|SPDR|VANGUARD|INVESCO|DIREXION|PROSHARES|WISDOMTREE|GLOBAL X|FIRST TRUST)"


@dataclass(frozen=True)
class UniverseConfig:
    #: (tier, least bars a day, least median dollar volume), best first; all others are D.
    tiers: tuple[tuple[str, float, float], ...] = (("A", 300, 50e6), ("B", 150, 10e6), ("C", 50, 1e6))
    minimum_days: int = 20
    minimum_bars: float = 20.0
    minimum_dollar_volume: float = 1e6
    minimum_price: float = 1.0
    include: str | None = None
    exclude: str | None = None
    exclude_funds: bool = True
    fund_names: str = FUND_NAMES
    maximum_symbols: int = 1500


def daily_liquidity(bars: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """Bars, dollar volume and last close of each symbol's day; ``tie`` orders bars of one instant."""
    last = F.max_by("close", F.struct("bar_ts", *tie)) if tie else F.max_by("close", "bar_ts")
    return bars.groupBy("symbol", "trade_date").agg(F.count("*").alias("bar_count"), F.sum(F.col("close") * F.col("volume")).alias("daily_dollar_volume"), last.alias("day_close"))


def symbol_stats(daily: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    half = F.lit(0.5)
    return daily.groupBy(*keys).agg(
        F.count("*").alias("trading_days"), F.avg("bar_count").alias("average_bars_per_day"), F.percentile("daily_dollar_volume", half).alias("median_daily_dollar_volume"),
        F.avg("daily_dollar_volume").alias("average_daily_dollar_volume"), F.percentile("day_close", half).alias("median_close"),
    )


def join_assets(stats: DataFrame, assets: DataFrame) -> DataFrame:
    return stats.join(assets.select("symbol", "exchange", F.col("name").alias("asset_name")), "symbol", "left")


def liquidity_tier(config: UniverseConfig) -> Column:
    out = None
    for tier, bars, dollars in config.tiers:
        fits = (F.col("average_bars_per_day") >= bars) & (F.col("median_daily_dollar_volume") >= dollars)
        out = F.when(fits, tier) if out is None else out.when(fits, tier)
    return out.otherwise("D")


def exclusion_reason(config: UniverseConfig) -> Column:
    """The first reason that applies, or null."""
    out = F.when(F.col("trading_days") < config.minimum_days, "insufficient trading days")
    out = out.when(F.col("average_bars_per_day") < config.minimum_bars, "insufficient bars per day")
    out = out.when(F.col("median_daily_dollar_volume") < config.minimum_dollar_volume, "insufficient dollar volume")
    out = out.when(F.col("median_close") < config.minimum_price, "price below minimum")
    if config.include:
        out = out.when(~F.col("symbol").rlike(config.include), "does not match include regex")
    if config.exclude:
        out = out.when(F.col("symbol").rlike(config.exclude), "matches exclude regex")
    if config.exclude_funds:
        out = out.when(F.coalesce("asset_name", F.lit("")).rlike(f"(?i){config.fund_names}"), "likely fund or exchange-traded product")
    return out


def rank_universe(stats: DataFrame, maximum: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rank of eligible symbols by median dollar volume; the first ``maximum`` are included.

    One row a symbol: thousands, so one task may rank a universe.
    """
    w = Window.partitionBy(*keys, F.col("exclusion_reason").isNull()).orderBy(F.col("median_daily_dollar_volume").desc_nulls_last(), "symbol")
    eligible = F.col("exclusion_reason").isNull()
    out = stats.withColumn("eligible_rank", F.when(eligible, F.row_number().over(w)))
    out = out.withColumn("included", eligible & (F.col("eligible_rank") <= maximum))
    return out.withColumn("exclusion_reason", F.when(eligible & ~F.col("included"), "outside maximum-symbol limit").otherwise(F.col("exclusion_reason")))


def build_universe(daily: DataFrame, assets: DataFrame, config: UniverseConfig, keys: tuple[str, ...] = ()) -> DataFrame:
    stats = join_assets(symbol_stats(daily, (*keys, "symbol")), assets)
    stats = stats.withColumns({"liquidity_tier": liquidity_tier(config), "exclusion_reason": exclusion_reason(config)})
    return rank_universe(stats, config.maximum_symbols, keys)


def universe_summary(universe: DataFrame) -> DataFrame:
    tier = lambda x: F.count_if(F.col("included") & (F.col("liquidity_tier") == x))
    return universe.agg(F.count("*").alias("symbols"), F.count_if("included").alias("included"), *[tier(x).alias(f"tier_{x.lower()}") for x in "ABCD"])


def join_universe(bars: DataFrame, universe: DataFrame, tiers=("A", "B", "C")) -> DataFrame:
    """Bars of included symbols of the tiers. A universe is bounded by its maximum of symbols, so it is broadcast."""
    chosen = universe.where(F.col("included") & F.col("liquidity_tier").isin(*tiers)).select("symbol", "liquidity_tier")
    return bars.drop("liquidity_tier").join(F.broadcast(chosen), "symbol")


def available_on(universe: DataFrame, bars: DataFrame, date) -> DataFrame:
    """Whether each symbol has a bar on a date."""
    traded = bars.where(F.col("trade_date") == F.lit(date).cast("date")).select("symbol").distinct().withColumn("available", F.lit(True))
    return universe.join(traded, "symbol", "left").withColumn("available", F.coalesce("available", F.lit(False)))


def refill_universe(available: DataFrame, maximum: int) -> DataFrame:
    """Included symbols again after unavailable ones go: ranks close up, the next in line move in."""
    w = Window.partitionBy("available").orderBy(F.col("eligible_rank").asc_nulls_last(), "symbol")
    fits = F.col("available") & F.col("eligible_rank").isNotNull()
    out = available.withColumn("new_rank", F.when(fits, F.row_number().over(w)))
    return out.withColumn("included", fits & (F.col("new_rank") <= maximum))


def plan_snapshots(dates: DataFrame, sessions: int = 20, lookback_days: int = 61) -> DataFrame:
    """The first date of each month with enough benchmark sessions before it, and until when it holds.

    dates: the trade_date of each benchmark session.
    """
    days = F.datediff("trade_date", F.lit("1970-01-01"))
    back = Window.orderBy(days).rangeBetween(-lookback_days, -1)
    every = Window.partitionBy(F.lit(1))
    ready = dates.withColumns({"sessions": F.count("*").over(back), "last": F.max("trade_date").over(every)}).where(F.col("sessions") >= sessions)
    first = ready.groupBy(F.trunc("trade_date", "month").alias("month")).agg(F.min("trade_date").alias("snapshot_date"), F.max("last").alias("last"))
    until = F.date_sub(F.lead("snapshot_date").over(Window.orderBy("snapshot_date")), 1)
    out = first.withColumn("effective_end", until)
    return out.select("snapshot_date", F.date_sub("snapshot_date", lookback_days).alias("lookback_start"), F.date_sub("snapshot_date", 1).alias("lookback_end"), F.col("snapshot_date").alias("effective_start"), F.coalesce("effective_end", "last").alias("effective_end"))


def build_pit_universes(daily: DataFrame, snapshots: DataFrame, assets: DataFrame, config: UniverseConfig) -> DataFrame:
    """A universe for each snapshot, from days before it only: all months in one job.

    Snapshots are one a month, so they are broadcast.
    """
    s = F.broadcast(snapshots.select("snapshot_date", "lookback_start", "lookback_end"))
    rows = daily.join(s, daily["trade_date"].between(F.col("lookback_start"), F.col("lookback_end")))
    return build_universe(rows, assets, config, ("snapshot_date",))


def reference_session(bars: DataFrame, symbol: str, date) -> DataFrame:
    """The last session of a benchmark before a date."""
    return bars.where((F.col("symbol") == symbol) & (F.col("trade_date") < F.lit(date).cast("date"))).agg(F.max("trade_date").alias("session"))


def join_membership(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows with the membership in force on their date: the latest snapshot whose range holds it.

    members: symbol, snapshot_date, effective_start, effective_end, lookback_end, completed and dollar volume.
    """
    m = members.withColumnRenamed("symbol", "_symbol")
    joined = df.join(m, (df["symbol"] == F.col("_symbol")) & df["trade_date"].between(F.col("effective_start"), F.col("effective_end")), "left")
    w = Window.partitionBy("symbol", "bar_ts").orderBy(F.col("snapshot_date").desc_nulls_last())
    return joined.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_symbol")


def pit_dollar_volume(df: DataFrame) -> DataFrame:
    """The snapshot's dollar volume, only from lookbacks that ended before the row's date and were completed."""
    return df.withColumn("pit_dollar_volume", F.when((F.col("lookback_end") < F.col("trade_date")) & F.col("completed"), F.col("median_daily_dollar_volume")))


def covers_range(ranges: DataFrame, keys: tuple[str, ...], start: str, end: str) -> DataFrame:
    """Whether each key's ranges (range_start, range_end) cover a required range without a gap."""
    w = Window.partitionBy(*keys).orderBy("range_start", "range_end")
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    r = ranges.where((F.col("range_end") >= s) & (F.col("range_start") <= e))
    reach = F.max("range_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("gap", F.col("range_start") > F.date_add(F.coalesce(reach, F.date_sub(s, 1)), 1))
    found = r.groupBy(*keys).agg((~F.bool_or("gap") & (F.max("range_end") >= e)).alias("covered"))
    return ranges.select(*keys).distinct().join(found, list(keys), "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def source_readiness(sessions: DataFrame, ranges: DataFrame, start: str, end: str, least: int = 20) -> DataFrame:
    """One row: benchmark sessions in the lookback, coverage by kind of load, and what stands in the way.

    ranges: kind, range_start, range_end.
    """
    n = sessions.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).agg(F.count("*").alias("sessions"), F.lit(1).alias("one"))
    kinds = covers_range(ranges, ("kind",), start, end).groupBy(F.lit(1).alias("one")).agg(F.sort_array(F.collect_list(F.when(~F.col("covered"), F.concat(F.col("kind"), F.lit(" does not cover the lookback"))))).alias("open"))
    out = n.join(kinds, "one", "left").withColumn("open", F.coalesce("open", F.array().cast("array<string>")))
    few = F.when(F.col("sessions") < least, F.lit("too few benchmark sessions"))
    return out.select("sessions", F.array_compact(F.concat(F.array(few), "open")).alias("blockers")).withColumn("ready", F.size("blockers") == 0)


def uncovered(planned: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """Planned ranges less covered ones, as maximal ranges by key (range_start, range_end, inclusive).

    Ranges are swept by their ends, never spread into days: a key has a row for each day on which the
    number of its open ranges changes. Ranges that end before they start are empty; a null key is a key.
    """
    end = lambda day, plan, cover: F.struct(day.alias("day"), F.lit(plan).cast("long").alias("plan"), F.lit(cover).cast("long").alias("cover"))
    ends = lambda df, plan, cover: df.where("range_start <= range_end").select(key, F.explode(F.array(end(F.col("range_start"), plan, cover), end(F.date_add("range_end", 1), -plan, -cover))).alias("e")).select(key, "e.*")
    changes = ends(planned, 1, 0).unionByName(ends(covered, 0, 1)).groupBy(key, "day").agg(F.sum("plan").alias("plan"), F.sum("cover").alias("cover")).where("plan <> 0 OR cover <> 0")
    w = Window.partitionBy(key).orderBy("day")
    spans = changes.select(key, "day", F.lead("day").over(w).alias("until"), ((F.sum("plan").over(w) > 0) & (F.sum("cover").over(w) == 0)).alias("open"))
    spans = spans.withColumn("new", F.col("open") & ~F.coalesce(F.lag("open").over(w), F.lit(False)))
    spans = spans.withColumn("island", F.count_if("new").over(w)).where("open")
    return spans.groupBy(key, "island").agg(F.min("day").alias("range_start"), F.date_sub(F.max("until"), 1).alias("range_end")).drop("island")


def stage_of(ranges: DataFrame, periods: DataFrame) -> DataFrame:
    """The research stage that holds each range whole, null if none does. Periods are a few rows."""
    p = F.broadcast(periods.select("stage", "stage_start", "stage_end"))
    return ranges.join(p, (ranges["range_start"] >= F.col("stage_start")) & (ranges["range_end"] <= F.col("stage_end")), "left").drop("stage_start", "stage_end")


def tag_periods(df: DataFrame, periods: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows of each named period with its name; periods must not overlap."""
    spans = sorted((a, b) for a, b in periods.values())
    if any(a > b for a, b in spans) or any(x[1] >= y[0] for x, y in zip(spans, spans[1:])):
        raise ValueError("periods must be in order and apart")
    label = F.lit(None).cast("string")
    for name, (a, b) in periods.items():
        label = F.when(F.col("trade_date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), name).otherwise(label)
    return df.withColumn("period", label).where("period IS NOT NULL")
