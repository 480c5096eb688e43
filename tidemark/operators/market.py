"""Cross-sections of the market by timestamp, benchmarks, and waves of a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import features as fo

#: Volatility and activity impact count as abnormal above so many times their reference.
ABNORMAL_VOLATILITY, ABNORMAL_IMPACT = 1.5, 2.0


def market_breadth(features: DataFrame, horizons=(5, 15, 30, 60)) -> DataFrame:
    """Distribution of backward returns over all symbols at each timestamp, one quantile sketch-free pass a horizon."""
    out = [F.count("*").alias("eligible_universe_count")]
    for h in horizons:
        x = F.col(f"ret_{h}m_pct")
        out += [(100.0 * F.avg((x > 0).cast("int"))).alias(f"pct_positive_{h}m"), F.avg(x).alias(f"mean_return_{h}m_pct"), F.stddev_samp(x).alias(f"stddev_return_{h}m_pct"), F.percentile(x, F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias(f"_q{h}")]
    df = features.groupBy("bar_ts").agg(*out)
    for h in horizons:
        q = F.col(f"_q{h}")
        named = {"p10_return": q[0], "p25_return": q[1], "median_return": q[2], "p75_return": q[3], "p90_return": q[4], "dispersion": q[3] - q[1]}
        df = df.withColumns({f"{n}_{h}m_pct": c for n, c in named.items()}).drop(f"_q{h}")
    return df


def _share(condition: Column, known: Column | None = None) -> Column:
    c = condition if known is None else F.when(known, condition)
    return 100.0 * F.avg(c.cast("int"))


def market_breadth_extras(samples: DataFrame) -> DataFrame:
    """Session extremes, range positions, relative activity and abnormal states at each timestamp."""
    c = F.col
    high, low, pos, rvol = c("high") >= c("cumulative_high"), c("low") <= c("cumulative_low"), c("cumulative_range_position"), c("relative_volume_20bar")
    vol, ref = c("rolling_realised_volatility_30bar"), c("previous_day_realised_volatility")
    now, before = c("activity_adjusted_return_5m"), c("prior_activity_adjusted_return_5m")
    return samples.groupBy("bar_ts").agg(
        F.count_if(high).alias("new_session_high_count"), _share(high).alias("new_session_high_pct"), F.count_if(low).alias("new_session_low_count"), _share(low).alias("new_session_low_pct"),
        F.count_if(pos >= 0.8).alias("top_20pct_session_range_count"), _share(pos >= 0.8).alias("top_20pct_session_range_pct"), F.count_if(pos <= 0.2).alias("bottom_20pct_session_range_count"), _share(pos <= 0.2).alias("bottom_20pct_session_range_pct"),
        F.percentile(rvol, F.lit(0.5)).alias("median_relative_volume"), _share(rvol > 1).alias("pct_relative_volume_gt_1"), _share(rvol > 1.5).alias("pct_relative_volume_gt_1_5"),
        F.percentile("relative_trade_count_20bar", F.lit(0.5)).alias("median_relative_trade_count"),
        _share(vol > ref * ABNORMAL_VOLATILITY, vol.isNotNull() & (ref > 0)).alias("pct_abnormal_volatility"), _share(now > before * ABNORMAL_IMPACT, now.isNotNull() & (before > 0)).alias("pct_abnormal_activity_adjusted_price_impact"),
    )


BENCHMARK = ("ret_5m_pct", "ret_30m_pct", "distance_from_cumulative_vwap_pct", "cumulative_range_position", "relative_volume_20bar", "rolling_realised_volatility_30bar")


def benchmark_features(bars: DataFrame, symbols: tuple[str, ...], base_minutes: int = 1) -> DataFrame:
    """Features of index benchmarks from their own bars."""
    b = fo.with_returns(fo.with_prev_bar(bars.where(F.col("symbol").isin(*symbols)), base_minutes), (5, 15, 30, 60), base_minutes)
    return fo.with_realised_vol(fo.with_relative_activity(fo.with_cum_vwap(fo.with_session_range(b))))


def benchmark_pivot(benchmarks: DataFrame, names: dict[str, str], columns=BENCHMARK) -> DataFrame:
    """{name}_{column} of each benchmark symbol, by timestamp."""
    pick = [F.max(F.when(F.col("symbol") == s, F.col(c))).alias(f"{n}_{c}") for s, n in names.items() for c in columns]
    return benchmarks.groupBy("bar_ts").agg(*pick)


def join_benchmark(breadth: DataFrame, pivot: DataFrame) -> DataFrame:
    return breadth.join(pivot, "bar_ts", "left")


def rule_waves(samples: DataFrame, rule: Column, strength: str | None = None) -> DataFrame:
    """How many symbols a rule takes at each timestamp, of how many, by tier and strength: one conditional pass."""
    hit = F.coalesce(rule, F.lit(False))
    s = F.when(hit, F.col(strength)) if strength else F.lit(None).cast("double")
    tier = lambda t: F.count_if(hit & (F.col("liquidity_tier") == t)).alias(f"tier_{t.lower()}_count")
    out = samples.groupBy("bar_ts").agg(
        F.min("trade_date").alias("trade_date"), F.count("*").alias("eligible_universe_count"), F.count_if(hit).alias("qualifying_stock_count"), tier("A"), tier("B"), tier("C"),
        F.avg(s).alias("average_signal_strength"), F.percentile(s, F.lit(0.5)).alias("median_signal_strength"), F.max(s).alias("maximum_signal_strength"), F.stddev_samp(s).alias("signal_strength_dispersion"),
    )
    return out.withColumn("qualifying_stock_pct", 100.0 * F.col("qualifying_stock_count") / F.col("eligible_universe_count"))


def wave_concentration(qualifying: DataFrame, column: str) -> DataFrame:
    """Counts of a rule's symbols by exchange or sector at each timestamp, as a map, and the largest share."""
    counts = qualifying.where(F.col(column).isNotNull()).groupBy("bar_ts", column).agg(F.count("*").alias("n"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(column), F.col("n").cast("double")))))
    return counts.groupBy("bar_ts").agg(entries.alias(f"{column}_concentration"), (100.0 * F.max("n") / F.sum("n")).alias(f"largest_{column}_share_pct"))


def assemble_waves(waves: DataFrame, *concentrations: DataFrame) -> DataFrame:
    for c in concentrations:
        waves = waves.join(c, "bar_ts", "left")
    return waves


def with_wave_change(waves: DataFrame) -> DataFrame:
    """Change against the timestamp before on the same day; no percentage from nothing."""
    before = F.lag("qualifying_stock_count").over(Window.partitionBy("trade_date").orderBy("bar_ts"))
    df = waves.withColumn("previous_wave_qualifying_count", before)
    change = F.col("qualifying_stock_count") - F.col("previous_wave_qualifying_count")
    return df.withColumns({"wave_change": change, "wave_change_pct": F.try_divide(100.0 * change, F.col("previous_wave_qualifying_count"))})


def with_streak(waves: DataFrame, elevated_pct: float) -> DataFrame:
    """How many timestamps in a row, on the same day, the share has been elevated."""
    w = Window.partitionBy("trade_date").orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, 0)
    df = waves.withColumn("elevated", F.col("qualifying_stock_pct") >= elevated_pct)
    df = df.withColumn("_reset", F.count_if(~F.col("elevated")).over(w))
    run = Window.partitionBy("trade_date", "_reset").orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("consecutive_elevated", F.when(F.col("elevated"), F.count_if("elevated").over(run)).otherwise(0)).drop("_reset")
