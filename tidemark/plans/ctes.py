"""Common table expressions of the SQL counterparts, in order of dependence."""

from __future__ import annotations


def _gated(value: str, later: str, earlier: str, minutes: int) -> str:
    return f"CASE WHEN {later} - {earlier} = INTERVAL {minutes} MINUTE THEN {value} END"


def _pct(a: str, b: str) -> str:
    return f"({a} / nullif({b}, 0) - 1) * 100"


_S = "(PARTITION BY symbol, trade_date, session_label ORDER BY bar_ts"
_H = (5, 15, 30, 60)

CTES: dict[str, str] = {}

CTES["event_places"] = """
SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY ts, event_id) - 1 AS place
FROM (SELECT event_type || '_' || CAST(CAST(floor(user_id / 150) AS BIGINT) AS VARCHAR) AS symbol, CAST(ts AS DATE) AS trade_date, ts, event_id, user_id, 100 + value / 100 AS close FROM events)"""

CTES["event_lanes"] = """
SELECT * EXCLUDE symbol, symbol || CASE WHEN place >= 85 THEN '.' || CAST(place // 85 AS VARCHAR) ELSE '' END AS symbol FROM event_places"""

CTES["event_slots"] = """
SELECT *, place % 85 + sum(CASE WHEN user_id % 17 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, trade_date ORDER BY place ROWS UNBOUNDED PRECEDING) AS slot FROM event_lanes"""

CTES["event_open"] = """
SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol, trade_date ORDER BY slot), close) AS open FROM event_slots"""

CTES["bars"] = """
SELECT symbol, '5Min' AS timeframe, 'sip' AS feed, 'raw' AS adjustment, CASE WHEN 570 + 5 * slot < 960 THEN 'regular' ELSE 'postmarket' END AS session_label,
  CAST(trade_date AS TIMESTAMP) + to_minutes(CAST(570 + 5 * slot AS BIGINT)) AS bar_ts, open, greatest(open, close) + 0.01 * (user_id % 5) AS high, least(open, close) - 0.01 * (event_id % 5) AS low, close,
  (greatest(open, close) + least(open, close) + close) / 3 AS vwap, 1000 + (user_id % 50) * 100 AS volume, 1 + event_id % 20 AS trade_count,
  trade_date, CAST(570 + 5 * slot AS INTEGER) AS minute_of_day, CAST(isodow(trade_date) AS INTEGER) AS weekday_iso, substr('ABC', length(symbol) % 3 + 1, 1) AS liquidity_tier
FROM event_open"""

_lags = ", ".join(f"lag(bar_ts, {h // 5}) OVER {_S}) AS lag_ts_{h}, lag(close, {h // 5}) OVER {_S}) AS lag_close_{h}, lead(bar_ts, {h // 5}) OVER {_S}) AS lead_ts_{h}, lead(close, {h // 5}) OVER {_S}) AS lead_close_{h}" for h in _H)
CTES["bar_windows"] = f"""
SELECT *, row_number() OVER {_S}) AS session_bar_number, {_lags},
  first_value(open) OVER {_S} ROWS UNBOUNDED PRECEDING) AS session_open,
  max(high) OVER {_S} ROWS UNBOUNDED PRECEDING) AS cumulative_high, min(low) OVER {_S} ROWS UNBOUNDED PRECEDING) AS cumulative_low,
  sum(coalesce(vwap, close) * volume) OVER {_S} ROWS UNBOUNDED PRECEDING) / nullif(sum(volume) OVER {_S} ROWS UNBOUNDED PRECEDING), 0) AS cumulative_vwap,
  avg(volume) OVER {_S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS previous_20bar_avg_volume, avg(trade_count) OVER {_S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS previous_20bar_avg_trade_count,
  max(high) OVER {_S} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS high_30, min(low) OVER {_S} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS low_30,
  max(high) OVER {_S} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS future_high, min(low) OVER {_S} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS future_low
FROM bars"""

_returns = ", ".join(
    f"{_gated(_pct('close', f'lag_close_{h}'), 'bar_ts', f'lag_ts_{h}', h)} AS ret_{h}m_pct, coalesce(bar_ts - lag_ts_{h} = INTERVAL {h} MINUTE, false) AS history_{h}m_complete, "
    f"{_gated(_pct(f'lead_close_{h}', 'close'), f'lead_ts_{h}', 'bar_ts', h)} AS fwd_return_{h}m_pct, coalesce(lead_ts_{h} - bar_ts = INTERVAL {h} MINUTE, false) AS future_{h}m_complete"
    for h in _H
)
CTES["bar_derived"] = f"""
SELECT *, {_gated("ln(close / nullif(lag_close_5, 0))", "bar_ts", "lag_ts_5", 5)} AS bar_log_return, {_gated(_pct("close", "lag_close_5"), "bar_ts", "lag_ts_5", 5)} AS bar_return_pct,
  CAST(epoch(bar_ts - lag_ts_5) AS INTEGER) AS prior_bar_gap_seconds, {_returns}, close * volume AS bar_dollar_volume,
  {_pct("close", "session_open")} AS ret_from_session_open_pct, {_pct("close", "cumulative_vwap")} AS distance_from_cumulative_vwap_pct,
  (close - cumulative_low) / nullif(cumulative_high - cumulative_low, 0) AS cumulative_range_position,
  volume / nullif(previous_20bar_avg_volume, 0) AS relative_volume_20bar, trade_count / nullif(previous_20bar_avg_trade_count, 0) AS relative_trade_count_20bar,
  (high_30 - low_30) / nullif(close, 0) * 100 AS rolling_range_30bar_pct,
  {_gated(_pct("future_high", "close"), "lead_ts_30", "bar_ts", 30)} AS fwd_mfe_30m_pct, {_gated(_pct("future_low", "close"), "lead_ts_30", "bar_ts", 30)} AS fwd_mae_30m_pct
FROM bar_windows"""

CTES["bar_baselined"] = f"""
SELECT *, volume / nullif(same_minute_avg_volume_prior_days, 0) AS same_minute_relative_volume
FROM (SELECT *, stddev_samp(bar_log_return) OVER {_S} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rolling_realised_volatility_30bar,
    avg(volume) OVER (PARTITION BY symbol, session_label, minute_of_day ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS same_minute_avg_volume_prior_days,
    avg(abs(bar_return_pct)) OVER (PARTITION BY symbol, session_label, minute_of_day ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS same_minute_avg_abs_return_prior_days
  FROM bar_derived)"""

CTES["daily_bars"] = """
SELECT symbol, trade_date, arg_min(open, bar_ts) AS day_open, max(high) AS day_high, min(low) AS day_low, arg_max(close, bar_ts) AS day_close, sum(volume) AS day_volume, stddev_samp(log_return) AS realised_volatility
FROM (SELECT *, ln(close / nullif(lag(close) OVER (PARTITION BY symbol, trade_date ORDER BY bar_ts), 0)) AS log_return FROM bars WHERE session_label = 'regular') GROUP BY symbol, trade_date"""

_D = "OVER (PARTITION BY symbol ORDER BY trade_date)"
CTES["daily_context"] = f"""
SELECT *, lag(day_close) {_D} AS previous_regular_close, lag(CASE WHEN day_open <> 0 THEN (day_close / day_open - 1) * 100 END) {_D} AS previous_day_return_pct,
  lag(CASE WHEN day_open <> 0 THEN (day_high - day_low) / day_open * 100 END) {_D} AS previous_day_range_pct, lag(day_volume) {_D} AS previous_day_volume, lag(realised_volatility) {_D} AS previous_day_realised_volatility
FROM daily_bars"""

CTES["feat"] = f"""
SELECT b.*, c.previous_regular_close, c.previous_day_return_pct, c.previous_day_range_pct, c.previous_day_volume, c.previous_day_realised_volatility,
  {_pct("b.session_open", "c.previous_regular_close")} AS gap_from_previous_regular_close_pct
FROM bar_baselined b LEFT JOIN daily_context c ON b.symbol = c.symbol AND b.trade_date = c.trade_date"""

CTES["feat_prior"] = """
SELECT f.*, p.ret_5m_pct AS prior_ret_5m_pct, p.relative_volume_20bar AS prior_relative_volume_20bar, p.relative_trade_count_20bar AS prior_relative_trade_count_20bar,
  max(CASE WHEN f.minute_of_day < 600 THEN f.high END) OVER (PARTITION BY f.symbol, f.trade_date) AS opening_range_high, min(CASE WHEN f.minute_of_day < 600 THEN f.low END) OVER (PARTITION BY f.symbol, f.trade_date) AS opening_range_low
FROM feat f LEFT JOIN feat p ON p.symbol = f.symbol AND p.bar_ts = f.bar_ts - INTERVAL 5 MINUTE"""

CTES["samples_impact"] = """
SELECT *, CASE WHEN relative_volume_20bar > 0 THEN abs(ret_5m_pct) / relative_volume_20bar END AS activity_adjusted_return_5m,
  CASE WHEN prior_relative_volume_20bar > 0 THEN abs(prior_ret_5m_pct) / prior_relative_volume_20bar END AS prior_activity_adjusted_return_5m FROM feat_prior"""

CTES["samples"] = """
SELECT *, abs(ret_5m_pct) AS abs_ret_5m_pct,
  CASE WHEN close < 5 THEN 'lt_5' WHEN close < 10 THEN '5_10' WHEN close < 25 THEN '10_25' WHEN close < 100 THEN '25_100' ELSE 'ge_100' END AS price_group,
  CASE WHEN prior_activity_adjusted_return_5m > 0 THEN activity_adjusted_return_5m / prior_activity_adjusted_return_5m END AS activity_impact_change_ratio,
  CASE WHEN prior_relative_volume_20bar > 0 THEN relative_volume_20bar / prior_relative_volume_20bar END AS relative_volume_change_ratio,
  CASE WHEN prior_relative_trade_count_20bar > 0 THEN relative_trade_count_20bar / prior_relative_trade_count_20bar END AS relative_trade_count_change_ratio,
  CASE WHEN previous_day_range_pct > 0 THEN rolling_range_30bar_pct / previous_day_range_pct END AS range_vs_previous_day_ratio,
  CASE WHEN previous_day_realised_volatility > 0 THEN rolling_realised_volatility_30bar / previous_day_realised_volatility END AS volatility_vs_previous_day_ratio,
  CASE WHEN minute_of_day < 600 OR opening_range_high IS NULL OR opening_range_low IS NULL THEN NULL WHEN close > opening_range_high THEN 'above' WHEN close < opening_range_low THEN 'below' ELSE 'inside' END AS opening_range_position,
  high >= cumulative_high AS touched_session_high, low <= cumulative_low AS touched_session_low FROM samples_impact"""


def bin_sql(name: str) -> str:
    """The bin number of one state dimension; the edges are the ones of ``operators.states``."""
    from tidemark.operators import states

    if name in states.CLOCK:
        e = states.CLOCK[name]
        cases = " ".join(f"WHEN minute_of_day < {x} THEN {i}" for i, x in enumerate(e[1:]))
        return f"CASE WHEN minute_of_day < {e[0]} THEN NULL {cases} END"
    if name == "weekday_bin":
        return "CASE WHEN weekday_iso BETWEEN 1 AND 5 THEN weekday_iso - 1 END"
    if name == "opening_state_bin":
        return "CASE opening_range_position WHEN 'above' THEN 0 WHEN 'inside' THEN 1 WHEN 'below' THEN 2 END"
    if name == "touched_high_bin":
        return "CASE WHEN touched_session_high THEN 1 WHEN NOT touched_session_high THEN 0 END"
    column, edges = states.EDGES.get(name) or states.MIXED_EDGES[name]
    pairs = [e if isinstance(e, tuple) else (e, False) for e in edges]
    cases = " ".join(f"WHEN {column} {'<=' if below else '<'} {x} THEN {i}" for i, (x, below) in enumerate(pairs))
    return f"CASE WHEN {column} IS NULL THEN NULL {cases} ELSE {len(pairs)} END"


def _binned() -> str:
    from tidemark.operators import states

    return "SELECT *, " + ", ".join(f"CAST({bin_sql(d)} AS INTEGER) AS {d}" for d in states.DIMENSIONS) + " FROM samples"


CTES["binned"] = _binned()

def _outcomes() -> str:
    from tidemark.operators.rules import ALL_FAMILIES

    parts = []
    for f, (dims, condition) in ALL_FAMILIES.items():
        key = " || '|' || ".join(f"CAST({d} AS VARCHAR)" for d in dims)
        present = " AND ".join(f"{d} IS NOT NULL" for d in dims)
        parts.append(f"SELECT '{f}' AS family, {key} AS group_key, * FROM binned WHERE ({condition}) AND {present}")
    return " UNION ALL ".join(parts)


CTES["grouped_states"] = _outcomes()
CTES["outcomes"] = " UNION ALL ".join(
    f"SELECT family, '{d}' AS direction, {h} AS horizon, group_key, symbol, trade_date, bar_ts, {s}fwd_return_{h}m_pct AS gross, {s}fwd_return_{h}m_pct - 0.2 AS net FROM grouped_states WHERE fwd_return_{h}m_pct IS NOT NULL AND (minute_of_day - 570) % {h} = 0"
    for d, s in (("long", ""), ("short", "-"))
    for h in (5,)
)
_G = "family, direction, horizon, group_key"
CTES["group_sums"] = f"""
SELECT {_G}, count(*) AS observations, sum(gross) AS gross_sum, sum(net) AS net_sum, sum(net * net) AS net_sum_squares, count_if(net > 0) AS wins, sum(CASE WHEN net > 0 THEN net ELSE 0 END) AS positive_sum,
  sum(CASE WHEN net < 0 THEN -net ELSE 0 END) AS negative_sum_abs, min(net) AS worst_pct, max(net) AS best_pct FROM outcomes GROUP BY {_G}"""
CTES["group_hist"] = f"SELECT {_G}, CAST(greatest(-200, least(200, floor(net * 10))) AS INTEGER) AS bin, count(*) AS n FROM outcomes GROUP BY ALL"
CTES["group_shares"] = f"""
SELECT * FROM (SELECT {_G}, count(*) AS symbols, 100.0 * max(n) / sum(n) AS max_symbol_share_pct FROM (SELECT {_G}, symbol, count(*) AS n FROM outcomes GROUP BY ALL) GROUP BY {_G})
JOIN (SELECT {_G}, count(*) AS dates, 100.0 * max(n) / sum(n) AS max_date_share_pct FROM (SELECT {_G}, trade_date, count(*) AS n FROM outcomes GROUP BY ALL) GROUP BY {_G}) USING ({_G})"""
_q = ", ".join(f"min(CASE WHEN seen >= greatest(1, ceil({q} * total)) THEN bin END) AS b{i}" for i, q in enumerate((0.05, 0.25, 0.5, 0.75, 0.95)))
_m = ", ".join(f"CASE WHEN b{i} <= -200 THEN -20.0 WHEN b{i} >= 200 THEN 20.0 ELSE (b{i} + 0.5) / 10.0 END AS {n}" for i, n in enumerate(("p05_pct", "p25_pct", "median_pct", "p75_pct", "p95_pct")))
CTES["group_quantiles"] = f"SELECT {_G}, {_m} FROM (SELECT {_G}, {_q} FROM (SELECT *, sum(n) OVER (PARTITION BY {_G} ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY {_G}) AS total FROM group_hist) GROUP BY {_G})"
CTES["group_final"] = """
SELECT *, CASE WHEN stdev_pct > 1e-9 THEN net_avg_pct / stdev_pct * sqrt(observations) END AS t_stat FROM (
  SELECT *, gross_sum / observations AS gross_avg_pct, net_sum / observations AS net_avg_pct, 100.0 * wins / observations AS win_rate_pct,
    CASE WHEN observations > 1 THEN sqrt(greatest(0, (net_sum_squares - net_sum * net_sum / observations) / (observations - 1))) END AS stdev_pct, CASE WHEN negative_sum_abs > 0 THEN positive_sum / negative_sum_abs END AS profit_factor FROM group_sums)"""
CTES["screened"] = f"SELECT * FROM group_final JOIN group_shares USING ({_G}) JOIN group_quantiles USING ({_G})"
CTES["screened_early"] = f"SELECT {_G}, count(*) AS v_observations, sum(net) / count(*) AS v_net_avg_pct, CASE WHEN sum(CASE WHEN net < 0 THEN -net ELSE 0 END) > 0 THEN sum(CASE WHEN net > 0 THEN net ELSE 0 END) / sum(CASE WHEN net < 0 THEN -net ELSE 0 END) END AS v_profit_factor FROM outcomes WHERE trade_date >= DATE '2024-01-16' GROUP BY {_G}"

CTES["daily_source"] = "SELECT CAST(l_partkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS trade_date, l_shipdate AS bar_ts, l_extendedprice / l_quantity AS close, l_quantity AS volume, l_orderkey, l_linenumber FROM lineitem"
_sector = """'{"sector":"' || p_type || '","shortable":' || CASE WHEN p_size % 3 = 0 THEN 'true' ELSE 'false' END || '}'"""
CTES["assets"] = f"SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_name AS name, p_brand AS exchange, CASE WHEN p_size % 2 = 0 THEN {_sector} ELSE '{{}}' END AS attributes, CASE WHEN p_size % 5 <> 0 THEN {_sector} ELSE '{{}}' END AS raw FROM part"
