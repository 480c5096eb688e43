"""Windowed features and forward labels of bars.

All session windows share one specification, (symbol, trade_date, session_label) by bar_ts, so they
share one exchange and one sort; the same-minute baseline needs a second. Frames of baselines leave
the current bar out. Returns and labels exist only where the bar h / base rows away is exactly h
minutes away: one missing bar inside the span makes them null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def _session() -> WindowSpec:
    return Window.partitionBy("symbol", "trade_date", "session_label").orderBy("bar_ts")


def _so_far() -> WindowSpec:
    return _session().rowsBetween(Window.unboundedPreceding, 0)


@dataclass(frozen=True)
class FeatureConfig:
    base_minutes: int = 1
    predictors: tuple[int, ...] = (1, 5, 15, 30, 60)
    outcomes: tuple[int, ...] = (5, 15, 30, 60)
    baseline_days: int = 20
    activity_bars: int = 20
    range_bars: int = 30
    excursion_minutes: int = 30


def pct_change(a, b) -> Column:
    """Percent by which a is above b; null where b is null or zero."""
    return (F.try_divide(_c(a), _c(b)) - 1) * 100


def ratio(a, b) -> Column:
    """a / b; null where b is null or zero."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _minutes(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' MINUTE")


def _gated(value: Column, later, earlier, minutes: int) -> Column:
    return F.when(_c(later) - _c(earlier) == _minutes(minutes), value)


def with_bar_number(df: DataFrame) -> DataFrame:
    return df.withColumn("session_bar_number", F.row_number().over(_session()))


def with_prev_bar(df: DataFrame, base_minutes: int = 1) -> DataFrame:
    """Gap to the bar before, and log and percent return from it if it is one step away."""
    ts, close = F.lag("bar_ts").over(_session()), F.lag("close").over(_session())
    df = df.withColumns({"_ts": ts, "_close": close})
    seconds = F.expr("cast(extract(day from bar_ts - _ts) * 86400 + extract(hour from bar_ts - _ts) * 3600 + extract(minute from bar_ts - _ts) * 60 + extract(second from bar_ts - _ts) as int)")
    positive = (F.col("close") > 0) & (F.col("_close") > 0)
    return df.withColumns(
        {
            "prior_bar_gap_seconds": seconds,
            "bar_log_return": _gated(F.when(positive, F.ln(F.try_divide(F.col("close"), F.col("_close")))), "bar_ts", "_ts", base_minutes),
            "bar_return_pct": _gated(pct_change("close", "_close"), "bar_ts", "_ts", base_minutes),
        }
    ).drop("_ts", "_close")


_SESSION = "(PARTITION BY symbol, trade_date, session_label ORDER BY bar_ts)"


def _stepped(df: DataFrame, horizons, base_minutes: int, move: str, value, name: str, flag: str) -> DataFrame:
    """Percent change between each bar and the one ``horizon`` minutes away, if it is exactly there; all horizons at once."""
    whole = [h for h in horizons if h % base_minutes == 0]
    df = df.withColumns({f"_{c}_{h}": F.expr(f"{move}({s}, {h // base_minutes}) OVER {_SESSION}") for h in whole for c, s in (("ts", "bar_ts"), ("close", "close"))})
    out = {}
    for h in horizons:
        gap = f"bar_ts - _ts_{h}" if move == "lag" else f"_ts_{h} - bar_ts"
        out[name.format(h)] = F.expr(f"CASE WHEN {gap} = INTERVAL '{h}' MINUTE THEN {value(f'_close_{h}')} END" if h in whole else "CAST(NULL AS DOUBLE)")
        out[flag.format(h)] = F.expr(f"coalesce({gap} = INTERVAL '{h}' MINUTE, false)" if h in whole else "false")
    return df.withColumns(out).drop(*[f"_{c}_{h}" for h in whole for c in ("ts", "close")])


def with_returns(df: DataFrame, horizons=(1, 5, 15, 30, 60), base_minutes: int = 1) -> DataFrame:
    """ret_{h}m_pct and history_{h}m_complete; horizons that are no multiple of the bar are null."""
    return _stepped(df, horizons, base_minutes, "lag", lambda c: f"(try_divide(close, {c}) - 1) * 100", "ret_{}m_pct", "history_{}m_complete")


def with_labels(df: DataFrame, horizons=(5, 15, 30, 60), base_minutes: int = 1) -> DataFrame:
    """fwd_return_{h}m_pct and future_{h}m_complete."""
    return _stepped(df, horizons, base_minutes, "lead", lambda c: f"(try_divide({c}, close) - 1) * 100", "fwd_return_{}m_pct", "future_{}m_complete")


def with_session_open(df: DataFrame) -> DataFrame:
    df = df.withColumn("session_open", F.first("open").over(_so_far()))
    return df.withColumn("ret_from_session_open_pct", pct_change("close", "session_open"))


def with_session_range(df: DataFrame) -> DataFrame:
    df = df.withColumns({"cumulative_high": F.max("high").over(_so_far()), "cumulative_low": F.min("low").over(_so_far())})
    return df.withColumn("cumulative_range_position", ratio(F.col("close") - F.col("cumulative_low"), F.col("cumulative_high") - F.col("cumulative_low")))


def with_cum_vwap(df: DataFrame) -> DataFrame:
    value = F.sum(F.coalesce("vwap", "close") * F.col("volume")).over(_so_far())
    df = df.withColumn("cumulative_vwap", F.try_divide(value, F.sum("volume").over(_so_far())))
    return df.withColumn("distance_from_cumulative_vwap_pct", pct_change("close", "cumulative_vwap"))


def with_relative_activity(df: DataFrame, bars: int = 20) -> DataFrame:
    w = _session().rowsBetween(-bars, -1)
    df = df.withColumns({"previous_20bar_avg_volume": F.avg("volume").over(w), "previous_20bar_avg_trade_count": F.avg("trade_count").over(w)})
    return df.withColumns({"relative_volume_20bar": ratio("volume", "previous_20bar_avg_volume"), "relative_trade_count_20bar": ratio("trade_count", "previous_20bar_avg_trade_count")})


def with_rolling_range(df: DataFrame, bars: int = 30) -> DataFrame:
    w = _session().rowsBetween(1 - bars, 0)
    return df.withColumn("rolling_range_30bar_pct", ratio(F.max("high").over(w) - F.min("low").over(w), "close") * 100)


def with_realised_vol(df: DataFrame, bars: int = 30) -> DataFrame:
    """Needs bar_log_return."""
    return df.withColumn("rolling_realised_volatility_30bar", F.stddev_samp("bar_log_return").over(_session().rowsBetween(1 - bars, 0)))


def with_mfe_mae(df: DataFrame, minutes: int = 30, base_minutes: int = 1) -> DataFrame:
    """Best and worst excursion over the next ``minutes``, where all of them are there."""
    if minutes % base_minutes:
        return df.withColumns({f"fwd_mfe_{minutes}m_pct": F.lit(None).cast("double"), f"fwd_mae_{minutes}m_pct": F.lit(None).cast("double")})
    k = minutes // base_minutes
    w = _session().rowsBetween(1, k)
    df = df.withColumns({"_ts": F.lead("bar_ts", k).over(_session()), "_high": F.max("high").over(w), "_low": F.min("low").over(w)})
    out = {f"fwd_mfe_{minutes}m_pct": "_high", f"fwd_mae_{minutes}m_pct": "_low"}
    return df.withColumns({n: _gated(pct_change(c, "close"), "_ts", "bar_ts", minutes) for n, c in out.items()}).drop("_ts", "_high", "_low")


def with_minute_baseline(df: DataFrame, days: int = 20) -> DataFrame:
    """Means of the same minute over the ``days`` earlier days that have it. Needs bar_return_pct."""
    w = Window.partitionBy("symbol", "session_label", "minute_of_day").orderBy("trade_date").rowsBetween(-days, -1)
    df = df.withColumns({"same_minute_avg_volume_prior_days": F.avg("volume").over(w), "same_minute_avg_abs_return_prior_days": F.avg(F.abs("bar_return_pct")).over(w)})
    return df.withColumn("same_minute_relative_volume", ratio("volume", "same_minute_avg_volume_prior_days"))


def daily_bars(bars: DataFrame) -> DataFrame:
    """Open, high, low, close, volume and realised volatility of regular sessions, by symbol and day."""
    day = Window.partitionBy("symbol", "trade_date").orderBy("bar_ts")
    b = bars.where("session_label = 'regular'").withColumn("_prev", F.lag("close").over(day))
    b = b.withColumn("_log", F.when((F.col("close") > 0) & (F.col("_prev") > 0), F.ln(F.try_divide("close", "_prev"))))
    return b.groupBy("symbol", "trade_date").agg(
        F.min_by("open", "bar_ts").alias("day_open"), F.max("high").alias("day_high"), F.min("low").alias("day_low"), F.max_by("close", "bar_ts").alias("day_close"),
        F.sum("volume").alias("day_volume"), F.stddev_samp("_log").alias("realised_volatility"),
    )


def with_prev_day(daily: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("trade_date")
    change = F.when(F.col("day_open") != 0, pct_change("day_close", "day_open"))
    span = F.when(F.col("day_open") != 0, F.try_divide(F.col("day_high") - F.col("day_low"), F.col("day_open")) * 100)
    return daily.withColumns(
        {
            "previous_regular_close": F.lag("day_close").over(w),
            "previous_day_return_pct": F.lag(change).over(w),
            "previous_day_range_pct": F.lag(span).over(w),
            "previous_day_volume": F.lag("day_volume").over(w),
            "previous_day_realised_volatility": F.lag("realised_volatility").over(w),
        }
    )


PREV_DAY = ("previous_regular_close", "previous_day_return_pct", "previous_day_range_pct", "previous_day_volume", "previous_day_realised_volatility")


def join_prev_day(features: DataFrame, daily: DataFrame) -> DataFrame:
    """Features with the day before of each symbol, and the opening gap. Needs session_open."""
    out = features.join(daily.select("symbol", "trade_date", *PREV_DAY), ["symbol", "trade_date"], "left")
    return out.withColumn("gap_from_previous_regular_close_pct", pct_change("session_open", "previous_regular_close"))


#: What a day's row holds, besides symbol and trade_date.
DAY_COLUMNS = ("day_open", "day_high", "day_low", "day_close", "day_volume", "realised_volatility")


def session_features(bars: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The features and labels that look at bars of the same session only."""
    df = with_prev_bar(with_bar_number(bars), config.base_minutes)
    df = with_labels(with_returns(df, config.predictors, config.base_minutes), config.outcomes, config.base_minutes)
    df = with_cum_vwap(with_session_range(with_session_open(df)))
    df = with_rolling_range(with_relative_activity(df, config.activity_bars), config.range_bars)
    df = with_mfe_mae(with_realised_vol(df, config.range_bars), config.excursion_minutes, config.base_minutes)
    return df.withColumn("bar_dollar_volume", F.col("close") * F.col("volume"))


def build_features(bars: DataFrame, config: FeatureConfig = FeatureConfig(), minutes: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """All features and labels of the bars.

    ``minutes`` (symbol, session_label, minute_of_day, trade_date, volume, bar_return_pct) and ``days`` (as of
    ``daily_bars``) stand for earlier bars that are not given; they have no rows of their own in the result.
    """
    df, daily = session_features(bars, config), daily_bars(bars)
    if minutes is not None:
        df = df.withColumn("_given", F.lit(True)).unionByName(minutes.withColumn("_given", F.lit(False)), allowMissingColumns=True)
    df = with_minute_baseline(df, config.baseline_days)
    if minutes is not None:
        df = df.where("_given").drop("_given")
    return join_prev_day(df, with_prev_day(daily if days is None else daily.unionByName(days)))
