"""Market-local calendar columns and small date helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"


def with_market_calendar(df: DataFrame, zone: str = MARKET_ZONE, ts: str = "bar_ts") -> DataFrame:
    """trade_date, minute_of_day and weekday_iso (1 is Monday) of an instant in UTC, as the market's clock has them.

    ``ts`` is a timestamp without zone that holds UTC, or an instant in a session set to UTC.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts).cast("timestamp_ntz"))
    return df.withColumn("_local", local).withColumns({"trade_date": F.to_date("_local"), "minute_of_day": F.hour("_local") * 60 + F.minute("_local"), "weekday_iso": F.weekday("_local") + 1}).drop("_local")


def market_date_bounds(first, last, zone: str = MARKET_ZONE) -> tuple[Column, Column]:
    """The half-open UTC bounds of inclusive market dates, as literals that a scan can use."""
    utc = lambda day: F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))
    return utc(F.lit(first).cast("date")), utc(F.date_add(F.lit(last).cast("date"), 1))


def weekday_calendar(spark, first: str, last: str) -> DataFrame:
    """One row for each weekday of the inclusive range."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("trade_date"))
    return days.where(F.weekday("trade_date") < 5)


def week_label(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), day).cast("string"), 2, "0"))


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_ranges(df: DataFrame, first: str = "range_start", last: str = "range_end") -> DataFrame:
    """Each range cut at month ends."""
    months = F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")))
    out = df.withColumn("month", months)
    return out.withColumns({"part_start": F.greatest(F.col(first), F.col("month")), "part_end": F.least(F.col(last), F.last_day("month"))})


def finite(x: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
