"""Market states of a bar: what it is against five minutes ago and the day before, and its bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the state dimensions: column, then (label, low, high) with bins [low, high); None is open.
#: A fourth entry says which ends are inclusive where that differs.
EDGES = {
    "ret30_bin": ("ret_30m_pct", (-5, -3, -2, -1, 0, 1, 2, 3, 5)),
    "ret5_bin": ("ret_5m_pct", (-2, -1, 0, 1, 2)),
    "rvol_bin": ("relative_volume_20bar", (1, 1.5, 2, 3)),
    "vwap_bin": ("distance_from_cumulative_vwap_pct", (-3, -2, -1, 0, 1, 2, 3)),
    "range_bin": ("cumulative_range_position", (0.2, 0.4, 0.6, 0.8)),
    "gap_bin": ("gap_from_previous_regular_close_pct", (-5, -3, -1, 0, 1, 3, 5)),
    "prev_day_bin": ("previous_day_return_pct", (-3, -1, 0, 1, 3)),
    "rtcount_bin": ("relative_trade_count_20bar", (1, 1.5, 2, 3)),
    "abs_ret5_bin": ("abs_ret_5m_pct", (0.25, 0.5, 1, 2)),
    "range_ratio_bin": ("range_vs_previous_day_ratio", (0.15, 0.25, 0.4, 0.6)),
    "vol_ratio_bin": ("volatility_vs_previous_day_ratio", (0.5, 0.8, 1.2, 2)),
}
#: Ends: (edge, whether the bin below includes it).
MIXED_EDGES = {
    "vwap_side": ("distance_from_cumulative_vwap_pct", ((-0.25, False), (0.25, True))),
    "rvol_change_bin": ("relative_volume_change_ratio", ((0.7, False), (0.95, False), (1.05, True), (1.4, True))),
    "rtcount_change_bin": ("relative_trade_count_change_ratio", ((0.7, False), (0.95, False), (1.05, True), (1.4, True))),
    "impact_change_bin": ("activity_impact_change_ratio", ((0.5, False), (0.8, False), (1.2, True), (2, True))),
}
#: Bins of the clock; minutes outside have none.
CLOCK = {"time_bin": (570, 600, 660, 780, 870, 930, 960), "midday_time_bin": (690, 750, 810, 840)}
DIMENSIONS = (*EDGES, *MIXED_EDGES, *CLOCK, "weekday_bin", "opening_state_bin", "touched_high_bin")


def with_prior(df: DataFrame, minutes: int = 5, columns=("ret_5m_pct", "relative_volume_20bar", "relative_trade_count_20bar"), keys=("symbol",), ts: str = "bar_ts") -> DataFrame:
    """prior_{column} of the row exactly ``minutes`` earlier with the same keys, null if there is none.

    A range frame of one instant finds it without a join.
    """
    span = f"INTERVAL '{minutes}' MINUTE PRECEDING"
    part = ", ".join(keys)
    by = f"PARTITION BY {part} ORDER BY {ts}" if part else f"ORDER BY {ts}"
    return df.withColumns({f"prior_{c}": F.expr(f"max({c}) OVER ({by} RANGE BETWEEN {span} AND {span})") for c in columns})


def price_group(close: Column) -> Column:
    return F.when(close < 5, "lt_5").when(close < 10, "5_10").when(close < 25, "10_25").when(close < 100, "25_100").otherwise("ge_100")


def _over(a: Column, b: Column) -> Column:
    """a / b where b is positive."""
    return F.when(a.isNotNull() & (b > 0), F.try_divide(a, b))


def activity_impact(df: DataFrame) -> DataFrame:
    """Absolute five-minute return per relative volume, now and before, and their ratio. Needs the prior columns."""
    now = _over(F.abs("ret_5m_pct"), F.col("relative_volume_20bar"))
    before = _over(F.abs("prior_ret_5m_pct"), F.col("prior_relative_volume_20bar"))
    df = df.withColumns({"activity_adjusted_return_5m": now, "prior_activity_adjusted_return_5m": before})
    return df.withColumn("activity_impact_change_ratio", _over(F.col("activity_adjusted_return_5m"), F.col("prior_activity_adjusted_return_5m")))


def rvol_change(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "relative_volume_change_ratio": _over(F.col("relative_volume_20bar"), F.col("prior_relative_volume_20bar")),
            "relative_trade_count_change_ratio": _over(F.col("relative_trade_count_20bar"), F.col("prior_relative_trade_count_20bar")),
        }
    )


def vs_prev_day(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "range_vs_previous_day_ratio": _over(F.col("rolling_range_30bar_pct"), F.col("previous_day_range_pct")),
            "volatility_vs_previous_day_ratio": _over(F.col("rolling_realised_volatility_30bar"), F.col("previous_day_realised_volatility")),
        }
    )


def with_opening_range(df: DataFrame) -> DataFrame:
    """High and low before 10:00, on every row of the symbol's day."""
    day, early = Window.partitionBy("symbol", "trade_date"), F.col("minute_of_day") < 600
    return df.withColumns({"opening_range_high": F.max(F.when(early, F.col("high"))).over(day), "opening_range_low": F.min(F.when(early, F.col("low"))).over(day)})


def opening_position(df: DataFrame) -> DataFrame:
    known = (F.col("minute_of_day") >= 600) & F.col("opening_range_high").isNotNull() & F.col("opening_range_low").isNotNull()
    side = F.when(F.col("close") > F.col("opening_range_high"), "above").when(F.col("close") < F.col("opening_range_low"), "below").otherwise("inside")
    return df.withColumn("opening_range_position", F.when(known, side))


def touched_extremes(df: DataFrame) -> DataFrame:
    return df.withColumns({"touched_session_high": F.col("high") >= F.col("cumulative_high"), "touched_session_low": F.col("low") <= F.col("cumulative_low")})


def enrich(features: DataFrame) -> DataFrame:
    """Features with all columns that states need."""
    df = vs_prev_day(rvol_change(activity_impact(with_prior(features))))
    df = touched_extremes(opening_position(with_opening_range(df)))
    return df.withColumns({"price_group": price_group(F.col("close")), "abs_ret_5m_pct": F.abs("ret_5m_pct")})


def bin_of(value: str, edges) -> str:
    """0 below the first edge, 1 from it on, and so forth; null for null."""
    steps = []
    for i, e in enumerate(edges):
        edge, below = e if isinstance(e, tuple) else (e, False)
        steps.append(f"WHEN {value} {'<=' if below else '<'} {edge} THEN {i}")
    return f"CASE WHEN {value} IS NULL THEN CAST(NULL AS INT) {' '.join(steps)} ELSE {len(edges)} END"


def bin_column(name: str) -> Column:
    """The bin number of one dimension; null where the dimension has no value."""
    if name in EDGES or name in MIXED_EDGES:
        return F.expr(bin_of(*(EDGES.get(name) or MIXED_EDGES[name])))
    if name in CLOCK:
        edges = CLOCK[name]
        return F.expr(f"CASE WHEN minute_of_day >= {edges[0]} AND minute_of_day < {edges[-1]} THEN {bin_of('minute_of_day', edges[1:-1])} END")
    if name == "weekday_bin":
        return F.expr("CAST(CASE WHEN weekday_iso BETWEEN 1 AND 5 THEN weekday_iso - 1 END AS INT)")
    if name == "opening_state_bin":
        return F.expr("CASE opening_range_position WHEN 'above' THEN 0 WHEN 'inside' THEN 1 WHEN 'below' THEN 2 END")
    if name == "touched_high_bin":
        return F.expr("CASE WHEN touched_session_high THEN 1 WHEN NOT touched_session_high THEN 0 END")
    raise KeyError(name)


def bin_state(samples: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    return samples.withColumns({d: bin_column(d) for d in dimensions})
