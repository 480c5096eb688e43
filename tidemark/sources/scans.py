"""Scans of bars, assets and load logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTES_PER_FEATURE_ROW = 420


@dataclass(frozen=True)
class SourceSelection:
    timeframe: str = "1Min"
    feed: str = "sip"
    adjustment: str = "all"
    session: str = "regular"
    start: str | None = None
    end: str | None = None


def select_bars(bars: DataFrame, s: SourceSelection) -> DataFrame:
    """Bars of one source; session "all" takes every session; dates are inclusive.

    Filters stand on plain columns, so that partitions and row groups are pruned.
    """
    out = bars.where((F.col("timeframe") == s.timeframe) & (F.col("feed") == s.feed) & (F.col("adjustment") == s.adjustment))
    if s.session != "all":
        out = out.where(F.col("session_label") == s.session)
    if s.start:
        out = out.where((F.col("trade_date") >= F.lit(s.start).cast("date")) & (F.col("bar_ts") >= F.lit(s.start).cast("timestamp_ntz")))
    if s.end:
        out = out.where((F.col("trade_date") <= F.lit(s.end).cast("date")) & (F.col("bar_ts") < F.date_add(F.lit(s.end).cast("date"), 1).cast("timestamp_ntz")))
    return out


def scan_bars(spark: SparkSession, path: str, s: SourceSelection) -> DataFrame:
    return select_bars(spark.read.parquet(path), s)


def with_attributes(assets: DataFrame) -> DataFrame:
    """sector, from attributes or else from raw; whether shortable is known, and its value."""
    value = lambda key: F.coalesce(F.get_json_object("attributes", f"$.{key}"), F.get_json_object("raw", f"$.{key}"))
    return assets.withColumns({"sector": value("sector"), "shortable_known": value("shortable").isNotNull(), "shortable": F.expr("try_cast(coalesce(get_json_object(attributes, '$.shortable'), get_json_object(raw, '$.shortable')) AS boolean)")})


def scan_assets(spark: SparkSession, path: str) -> DataFrame:
    return with_attributes(spark.read.parquet(path))


LOAD_CONFIG = "start_date string, end_date string, timeframes array<string>, feed string, adjustment string, universe struct<mode:string>, session struct<mode:string>"


def load_log_ranges(log: DataFrame, mode: str, feed: str, adjustment: str, timeframe: str = "1Min") -> DataFrame:
    """id and date range of completed loads with the given universe mode, feed, adjustment and timeframe."""
    c = log.where("status = 'completed'").withColumn("c", F.from_json("config", LOAD_CONFIG))
    c = c.where((F.col("c.universe.mode") == mode) & (F.col("c.feed") == feed) & (F.col("c.adjustment") == adjustment) & F.array_contains("c.timeframes", timeframe))
    return c.select("id", F.to_date("c.start_date").alias("range_start"), F.to_date("c.end_date").alias("range_end"))


def source_inventory(bars: DataFrame) -> DataFrame:
    keys = ("timeframe", "feed", "adjustment")
    return bars.groupBy(*keys).agg(F.count("*").alias("bars"), F.countDistinct("symbol").alias("symbols"), F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"))


def estimate_features(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Symbols, bars and bytes of a feature build over the included symbols."""
    chosen = bars.join(F.broadcast(universe.where("included").select("symbol")), "symbol", "left_semi")
    return chosen.agg(F.countDistinct("symbol").alias("symbols"), F.count("*").alias("bars")).withColumn("estimated_bytes", F.col("bars") * BYTES_PER_FEATURE_ROW)


def feature_summary(features: DataFrame) -> DataFrame:
    return features.agg(F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def latest_per_key(df: DataFrame, keys: tuple[str, ...], *order) -> DataFrame:
    """The first row of each key in the given order."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
