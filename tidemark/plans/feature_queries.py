"""Queries of scans, features and states."""

from __future__ import annotations

from tidemark.operators import features as fo
from tidemark.operators import states as so
from tidemark.plans.registry import register

KEY = "symbol, bar_ts, session_label"


def load() -> None:
    base = 5
    horizons = (5, 15, 30, 60)
    feature = lambda name, columns, query: register(name, f"{KEY}, {columns}", query, "SELECT * FROM feat")
    feature("e1_bar_number", "session_bar_number:l", lambda t: fo.with_bar_number(t.bars))
    feature("e2_prev_bar", "prior_bar_gap_seconds:l, bar_log_return:d, bar_return_pct:d", lambda t: fo.with_prev_bar(t.bars, base))
    feature("e3_backward_returns", ", ".join(f"ret_{h}m_pct:d, history_{h}m_complete" for h in horizons), lambda t: fo.with_returns(t.bars, horizons, base))
    feature("e4_forward_labels", ", ".join(f"fwd_return_{h}m_pct:d, future_{h}m_complete" for h in horizons), lambda t: fo.with_labels(t.bars, horizons, base))
    feature("e5_session_open", "session_open:d, ret_from_session_open_pct:d", lambda t: fo.with_session_open(t.bars))
    feature("e6_session_range", "cumulative_high:d, cumulative_low:d, cumulative_range_position:d", lambda t: fo.with_session_range(t.bars))
    feature("e7_cumulative_vwap", "cumulative_vwap:d, distance_from_cumulative_vwap_pct:d", lambda t: fo.with_cum_vwap(t.bars))
    feature("e8_relative_activity", "previous_20bar_avg_volume:d, relative_volume_20bar:d, relative_trade_count_20bar:d", lambda t: fo.with_relative_activity(t.bars))
    feature("e9_rolling_range", "rolling_range_30bar_pct:d", lambda t: fo.with_rolling_range(t.bars))
    feature("e10_realised_volatility", "rolling_realised_volatility_30bar:d", lambda t: fo.with_realised_vol(fo.with_prev_bar(t.bars, base)))
    feature("e11_mfe_mae", "fwd_mfe_30m_pct:d, fwd_mae_30m_pct:d", lambda t: fo.with_mfe_mae(t.bars, 30, base))
    feature("e12_minute_baseline", "same_minute_avg_volume_prior_days:d, same_minute_avg_abs_return_prior_days:d, same_minute_relative_volume:d", lambda t: fo.with_minute_baseline(fo.with_prev_bar(t.bars, base), 10))
    daily = "day_open:d, day_high:d, day_low:d, day_close:d, day_volume:l, realised_volatility:d"
    register("d2_daily_bars", f"symbol, trade_date, {daily}", lambda t: fo.daily_bars(t.bars), "SELECT * FROM daily_bars")
    previous = "previous_regular_close:d, previous_day_return_pct:d, previous_day_range_pct:d, previous_day_volume:l, previous_day_realised_volatility:d"
    register("e13_previous_day", f"symbol, trade_date, {previous}", lambda t: fo.with_prev_day(fo.daily_bars(t.bars)), "SELECT * FROM daily_context")
    feature("c4_join_previous_day", f"{previous}, gap_from_previous_regular_close_pct:d", lambda t: t.features)
    sample = lambda name, columns, query: register(name, f"{KEY}, {columns}", query, "SELECT * FROM samples")
    sample("c3_prior_row", "prior_ret_5m_pct:d, prior_relative_volume_20bar:d, prior_relative_trade_count_20bar:d", lambda t: so.with_prior(t.features))
    sample("b6_price_group", "price_group", lambda t: t.bars.withColumn("price_group", so.price_group(so.F.col("close"))))
    sample("b10_activity_impact", "activity_adjusted_return_5m:d, prior_activity_adjusted_return_5m:d, activity_impact_change_ratio:d", lambda t: so.activity_impact(so.with_prior(t.features)))
    sample("b11_activity_change", "relative_volume_change_ratio:d, relative_trade_count_change_ratio:d", lambda t: so.rvol_change(so.with_prior(t.features)))
    sample("b12_versus_previous_day", "range_vs_previous_day_ratio:d, volatility_vs_previous_day_ratio:d", lambda t: so.vs_prev_day(t.features))
    sample("e14_opening_range", "opening_range_high:d, opening_range_low:d", lambda t: so.with_opening_range(t.bars))
    sample("b13_opening_position", "opening_range_position", lambda t: so.opening_position(so.with_opening_range(t.bars)))
    sample("b14_touched_extremes", "touched_session_high, touched_session_low", lambda t: so.touched_extremes(fo.with_session_range(t.bars)))
    register("b15_state_bins", f"{KEY}, " + ", ".join(f"{d}:l" for d in so.DIMENSIONS), lambda t: so.bin_state(t.samples), "SELECT * FROM binned")
