"""Rules as data: families of state grids, conditions as documents, and their columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.states import CLOCK, EDGES, MIXED_EDGES

#: Dimensions and eligibility filter of each family of rules.
FAMILIES: dict[str, tuple[tuple[str, ...], str]] = {
    "time_of_day": (("time_bin", "weekday_bin"), "minute_of_day >= 570 AND minute_of_day < 960 AND weekday_iso BETWEEN 1 AND 5"),
    "oversold_reversal": (("time_bin", "ret30_bin", "vwap_bin", "rvol_bin"), "ret_30m_pct < 0 AND distance_from_cumulative_vwap_pct < 0 AND relative_volume_20bar IS NOT NULL"),
    "momentum_continuation": (("time_bin", "ret30_bin", "range_bin", "rvol_bin"), "ret_30m_pct > 0 AND cumulative_range_position >= 0.5 AND relative_volume_20bar IS NOT NULL"),
    "vwap_reversion": (("time_bin", "vwap_bin", "range_bin", "rvol_bin"), "abs(distance_from_cumulative_vwap_pct) >= 1 AND cumulative_range_position IS NOT NULL AND relative_volume_20bar IS NOT NULL"),
    "gap_behavior": (("time_bin", "gap_bin", "prev_day_bin"), "abs(gap_from_previous_regular_close_pct) >= 1 AND previous_day_return_pct IS NOT NULL"),
    "volume_shock": (("time_bin", "rvol_bin", "ret5_bin"), "relative_volume_20bar >= 1.5 AND ret_5m_pct IS NOT NULL"),
    "dip_repair": (
        ("time_bin", "ret30_bin", "vwap_side", "range_bin", "rvol_change_bin", "rtcount_change_bin"),
        "ret_30m_pct <= -2 AND cumulative_range_position IS NOT NULL AND relative_volume_change_ratio IS NOT NULL AND relative_trade_count_change_ratio IS NOT NULL",
    ),
    "compression_expansion": (
        ("midday_time_bin", "range_ratio_bin", "vol_ratio_bin", "rvol_bin", "rtcount_bin"),
        "minute_of_day >= 690 AND minute_of_day < 840 AND range_vs_previous_day_ratio < 0.6 AND volatility_vs_previous_day_ratio IS NOT NULL AND relative_volume_20bar IS NOT NULL AND relative_trade_count_20bar IS NOT NULL",
    ),
    "gap_state": (("time_bin", "gap_bin", "vwap_side", "opening_state_bin", "rvol_bin", "rtcount_bin"), "minute_of_day >= 600 AND abs(gap_from_previous_regular_close_pct) >= 1 AND opening_range_position IS NOT NULL AND relative_volume_20bar IS NOT NULL AND relative_trade_count_20bar IS NOT NULL"),
    "activity_absorption": (("time_bin", "rvol_bin", "rtcount_bin", "abs_ret5_bin", "vwap_side"), "(relative_volume_20bar >= 1.5 OR relative_trade_count_20bar >= 1.5) AND ret_5m_pct IS NOT NULL"),
    "price_efficiency": (("time_bin", "ret5_bin", "impact_change_bin", "rvol_bin"), "abs(ret_5m_pct) >= 1 AND activity_impact_change_ratio IS NOT NULL AND relative_volume_20bar IS NOT NULL"),
    "new_high_liquidity_divergence": (
        ("time_bin", "touched_high_bin", "rvol_change_bin", "rtcount_change_bin", "ret5_bin"),
        "touched_session_high AND relative_volume_change_ratio IS NOT NULL AND relative_trade_count_change_ratio IS NOT NULL",
    ),
}
#: Grids without a filter, always searched too.
OPEN_GRIDS: dict[str, tuple[tuple[str, ...], str]] = {
    "blank_canvas_price_activity": (("ret5_bin", "ret30_bin", "rvol_bin"), "TRUE"),
    "blank_canvas_location_liquidity": (("vwap_side", "range_bin", "rvol_bin"), "TRUE"),
    "blank_canvas_state_change": (("rvol_change_bin", "rtcount_change_bin", "impact_change_bin"), "TRUE"),
    "blank_canvas_range_volatility": (("range_ratio_bin", "vol_ratio_bin", "rvol_bin"), "TRUE"),
    "blank_canvas_temporal_state": (("time_bin", "weekday_bin", "ret5_bin"), "TRUE"),
    "blank_canvas_gap_prior_state": (("gap_bin", "prev_day_bin", "rvol_bin"), "TRUE"),
}
ALL_FAMILIES = FAMILIES | OPEN_GRIDS
#: The columns that a rule may look at.
RULE_COLUMNS = frozenset(
    "minute_of_day weekday_iso ret_5m_pct ret_30m_pct relative_volume_20bar relative_trade_count_20bar distance_from_cumulative_vwap_pct cumulative_range_position "
    "gap_from_previous_regular_close_pct previous_day_return_pct relative_volume_change_ratio relative_trade_count_change_ratio range_vs_previous_day_ratio "
    "volatility_vs_previous_day_ratio activity_impact_change_ratio opening_range_position touched_session_high".split()
)


def bins_of(dimension: str) -> int:
    """How many bins of a dimension a rule can be made of."""
    if dimension in CLOCK:
        return len(CLOCK[dimension]) - 1
    if dimension in EDGES or dimension in MIXED_EDGES:
        return len((EDGES.get(dimension) or MIXED_EDGES[dimension])[1]) + 1
    return {"weekday_bin": 5, "opening_state_bin": 3, "touched_high_bin": 1}[dimension]


def family_filter(name: str) -> Column:
    return F.expr(ALL_FAMILIES[name][1])


def defined_variants(spark, families=ALL_FAMILIES, directions=("long", "short"), horizons=(5, 15, 30, 60)) -> DataFrame:
    """family and the number of rules that its grid defines over all directions and horizons."""
    rows = [(f, bins_of(d)) for f in families for d in ALL_FAMILIES[f][0]]
    grid = spark.createDataFrame(rows, "family string, bins int").groupBy("family").agg(F.round(F.product("bins")).cast("long").alias("grid"))
    return grid.withColumn("variants", F.col("grid") * len(directions) * len(horizons))


def condition(c: dict) -> Column:
    """One condition document, {column, operator, value / low / high / *_inclusive}, as a column."""
    if c["column"] not in RULE_COLUMNS:
        raise ValueError(f"a rule can't look at {c['column']}")
    x, op, v = F.col(c["column"]), c["operator"], c.get("value")
    simple = {
        "eq": lambda: x == F.lit(v), "gt": lambda: x > v, "gte": lambda: x >= v, "lt": lambda: x < v, "lte": lambda: x <= v,
        "abs_gte": lambda: F.abs(x) >= v, "abs_lt": lambda: F.abs(x) < v, "not_null": lambda: x.isNotNull(),
    }
    if op in simple:
        return simple[op]()
    if op not in ("range", "abs_range"):
        raise ValueError(f"no such operator: {op}")
    low, high = c.get("low"), c.get("high")
    if low is None and high is None:
        raise ValueError("a range needs an end")
    x = F.abs(x) if op == "abs_range" else x
    parts = []
    if low is not None:
        parts.append(x >= low if c.get("low_inclusive", True) else x > low)
    if high is not None:
        parts.append(x <= high if c.get("high_inclusive", False) else x < high)
    return reduce(lambda a, b: a & b, parts)


def rule_filter(conditions: list[dict]) -> Column:
    """All conditions of a rule."""
    if not conditions:
        raise ValueError("a rule needs a condition")
    return reduce(lambda a, b: a & b, map(condition, conditions))


def perturb(conditions: list[dict], percent: float, mode: str) -> list[dict]:
    """The rule with each threshold ``relaxed`` or ``tightened`` by a percentage: two-sided ranges
    change their width, one-sided thresholds move by their own size, whatever its sign."""
    out, share = [], percent / 100 * (1 if mode == "relaxed" else -1)
    fixed = ("minute_of_day", "weekday_iso", "opening_range_position", "touched_session_high")
    for c in map(dict, conditions):
        op = c["operator"]
        if c["column"] in fixed or op in ("eq", "not_null"):
            pass
        elif op in ("range", "abs_range"):
            low, high = c.get("low"), c.get("high")
            if low is not None and high is not None:
                grow = (high - low) * share / 2
                c["low"], c["high"] = low - grow, high + grow
            elif low is not None:
                c["low"] = low - abs(low) * share
            else:
                c["high"] = high + abs(high) * share
        elif op in ("gt", "gte"):
            c["value"] = c["value"] - abs(c["value"]) * share
        elif op in ("lt", "lte"):
            c["value"] = c["value"] + abs(c["value"]) * share
        elif op == "abs_gte":
            c["value"] = c["value"] * (1 - share)
        elif op == "abs_lt":
            c["value"] = c["value"] * (1 + share)
        out.append(c)
    return out


def group_key(dimensions) -> Column:
    return F.concat_ws("|", *[F.col(d).cast("string") for d in dimensions])


def group_values(dimensions) -> Column:
    return F.to_json(F.struct(*[F.col(d) for d in dimensions]))


def rule_text(direction: Column, key: Column, horizon: Column, family: Column) -> Column:
    """A sentence for a rule, from the bins of its key."""
    dims = F.create_map(*[F.lit(x) for f, (d, _) in ALL_FAMILIES.items() for x in (f, ",".join(d))])
    named = F.zip_with(F.split(dims[family], ","), F.split(key, r"\|"), lambda d, b: F.concat(F.regexp_replace(d, "_bin$", ""), F.lit(" is in bin "), b))
    last = F.element_at(named, -1)
    head = F.array_join(F.slice(named, F.lit(1), F.size(named) - 1), ", ")
    listed = F.when(F.size(named) > 1, F.concat(head, F.lit(" and "), last)).otherwise(last)
    return F.concat(F.when(direction == "long", "Buy").otherwise("Short"), F.lit(" when "), listed, F.lit("; exit after "), horizon.cast("string"), F.lit(" minutes."))
