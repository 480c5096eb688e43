"""Bars, assets and daily liquidity derived from the star-schema tables, for queries and tests.

The expressions are written once here and once in SQL in ``plans.ctes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import FeatureConfig

#: Bars of a symbol's day; what goes beyond becomes the day of a further symbol, so that no event is left out.
LANE = 85
#: Five-minute bars; the first two symbols stand in for index benchmarks.
FEATURES = FeatureConfig(base_minutes=5, predictors=(5, 15, 30, 60), outcomes=(5, 15, 30, 60), baseline_days=10)
BENCHMARKS = ("click_0", "view_0")


def bars_from_events(events: DataFrame) -> DataFrame:
    """Five-minute bars: events in order fill the slots of a symbol's day; some leave a slot before them empty."""
    day = Window.partitionBy("symbol", "trade_date").orderBy("ts", "event_id")
    until = Window.partitionBy("symbol", "trade_date").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    e = events.select(
        F.concat(F.col("event_type"), F.lit("_"), F.floor(F.col("user_id") / 150).cast("string")).alias("symbol"),
        F.to_date("ts").alias("trade_date"), "ts", "event_id", "user_id", "value",
    )
    e = e.withColumn("place", F.row_number().over(day) - 1).withColumn("lane", F.floor(F.col("place") / LANE))
    e = e.withColumn("symbol", F.when(F.col("lane") > 0, F.concat("symbol", F.lit("."), F.col("lane").cast("string"))).otherwise(F.col("symbol")))
    e = e.withColumn("slot", F.col("place") % LANE + F.sum(F.when(F.col("user_id") % 17 == 0, 1).otherwise(0)).over(until))
    e = e.withColumn("minute_of_day", (570 + 5 * F.col("slot")).cast("int"))
    e = e.withColumn("close", 100 + F.col("value") / 100)
    e = e.withColumn("open", F.coalesce(F.lag("close").over(Window.partitionBy("symbol", "trade_date").orderBy("slot")), F.col("close")))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return e.select(
        "symbol", F.lit("5Min").alias("timeframe"), F.lit("sip").alias("feed"), F.lit("raw").alias("adjustment"),
        F.when(F.col("minute_of_day") < 960, "regular").otherwise("postmarket").alias("session_label"),
        F.expr("cast(trade_date as timestamp_ntz) + make_dt_interval(0, 0, minute_of_day, 0)").alias("bar_ts"),
        "open", (top + 0.01 * (F.col("user_id") % 5)).alias("high"), (bottom - 0.01 * (F.col("event_id") % 5)).alias("low"), "close",
        ((top + bottom + F.col("close")) / 3).alias("vwap"), (1000 + (F.col("user_id") % 50) * 100).alias("volume"), (1 + F.col("event_id") % 20).alias("trade_count"),
        "trade_date", "minute_of_day", (F.weekday("trade_date") + 1).alias("weekday_iso"),
        F.element_at(F.array(*[F.lit(x) for x in "ABC"]), (F.length("symbol") % 3 + 1).cast("int")).alias("liquidity_tier"),
    )


def daily_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Trades by part and ship date, as bars of a day."""
    return lineitem.select(
        F.col("l_partkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), F.col("l_shipdate").alias("bar_ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.col("l_quantity").alias("volume"), F.col("l_orderkey"), F.col("l_linenumber"),
    )


def assets_from_part(part: DataFrame) -> DataFrame:
    """Assets with JSON attributes, a sector in one or the other column."""
    sector = F.concat(F.lit('{"sector":"'), F.col("p_type"), F.lit('","shortable":'), F.when(F.col("p_size") % 3 == 0, "true").otherwise("false"), F.lit("}"))
    return part.select(
        F.col("p_partkey").cast("string").alias("symbol"), F.col("p_name").alias("name"), F.col("p_brand").alias("exchange"),
        F.when(F.col("p_size") % 2 == 0, sector).otherwise(F.lit("{}")).alias("attributes"), F.when(F.col("p_size") % 5 != 0, sector).otherwise(F.lit("{}")).alias("raw"),
    )
