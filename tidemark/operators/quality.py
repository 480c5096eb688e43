"""Data-quality reports of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Minutes of each kind of session.
SESSION_MINUTES = {"regular": 390, "premarket": 330, "postmarket": 240, "overnight": 480, "all": 1440}


def expected_bars(session: str, timeframe_minutes: int) -> int:
    return max(1, SESSION_MINUTES[session] // timeframe_minutes)


def session_coverage(bars: DataFrame, timeframe_minutes: int) -> DataFrame:
    """Bars of each symbol's session against how many it can have at most."""
    table = F.create_map(*[F.lit(x) for s in SESSION_MINUTES for x in (s, expected_bars(s, timeframe_minutes))])
    days = bars.groupBy("symbol", "trade_date", "session_label").agg(F.count("*").alias("bars"))
    return days.withColumn("expected", table[F.col("session_label")]).withColumn("coverage_pct", 100.0 * F.col("bars") / F.col("expected"))


def quality_inventory(bars: DataFrame) -> DataFrame:
    """Bars, symbols and first and last instant of each session."""
    return bars.groupBy("session_label").agg(F.count("*").alias("bars"), F.countDistinct("symbol").alias("symbols"), F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"))


def quality_coverage(bars: DataFrame) -> DataFrame:
    """Bars and symbols of each day."""
    return bars.groupBy("trade_date").agg(F.count("*").alias("bars"), F.countDistinct("symbol").alias("symbols"))


def quality_bands(bars: DataFrame, expected: int) -> DataFrame:
    """How many symbol-days have how much of the expected bars."""
    days = bars.groupBy("symbol", "trade_date").agg(F.count("*").alias("n"))
    band = F.when(F.col("n") >= 0.95 * expected, "complete").when(F.col("n") >= 0.75 * expected, "75-95%").when(F.col("n") >= 0.25 * expected, "25-75%").otherwise("under 25%")
    return days.groupBy(band.alias("coverage_band")).agg(F.count("*").alias("symbol_days"))


def quality_anomalies(bars: DataFrame) -> DataFrame:
    """Impossible prices and activity, in one pass."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return bars.agg(
        F.count_if((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0)).alias("nonpositive_prices"),
        F.count_if((h < l) | (h < F.greatest(o, c)) | (l > F.least(o, c))).alias("invalid_ohlc"),
        F.count_if((F.col("volume") < 0) | (F.coalesce("trade_count", F.lit(0)) < 0)).alias("negative_activity"),
        F.count_if(F.col("volume") == 0).alias("zero_volume_bars"),
        F.count("*").alias("checked_bars"),
    )


def quality_min_days(bars: DataFrame, least: int) -> DataFrame:
    days = bars.groupBy("symbol").agg(F.countDistinct("trade_date").alias("n"))
    return days.agg(F.count_if(F.col("n") < least).alias("symbols_below_minimum_days"), F.count("*").alias("symbols"))
