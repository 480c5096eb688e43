"""Queries of replay, economics, execution, regimes, decisions and integrity."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidemark.operators import economics as eo
from tidemark.operators import execution as xo
from tidemark.operators import integrity as io
from tidemark.operators import market as mo
from tidemark.operators import robustness as bo
from tidemark.operators import rules as ro
from tidemark.operators import universe as uo
from tidemark.operators.selection import joined
from tidemark.plans.ctes import CTES
from tidemark.plans.discovery_queries import RULE, RULE_SQL, scored, screened
from tidemark.plans.registry import register
from tidemark.plans.universe_queries import _PLAN
from tidemark.sources import proxies, scans
from tidemark.sources.sinks import scratch, scratch_table as kept
from tidemark.streaming import refresh as stream

FIRST, LAST = "2024-01-01", "2024-01-31"
RULES = {"base": RULE, "relaxed": ro.perturb(RULE, 10, "relaxed"), "tightened": ro.perturb(RULE, 10, "tightened")}
_RELAXED = "abs(ret_5m_pct) >= 0.45 AND relative_volume_20bar >= 0.425 AND relative_volume_20bar <= 2.075 AND minute_of_day >= 600 AND cumulative_range_position IS NOT NULL"
_TIGHT = "abs(ret_5m_pct) >= 0.55 AND relative_volume_20bar >= 0.575 AND relative_volume_20bar <= 1.925 AND minute_of_day >= 600 AND cumulative_range_position IS NOT NULL"
CTES["obs_all"] = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, symbol, bar_ts, trade_date, minute_of_day, liquidity_tier, price_group, bar_dollar_volume, fwd_return_5m_pct AS gross_return_pct, fwd_return_5m_pct - 0.2 AS net, fwd_mfe_30m_pct AS mfe_pct, fwd_mae_30m_pct AS mae_pct FROM samples WHERE {c}"
    for n, c in (("base", RULE_SQL), ("relaxed", _RELAXED), ("tightened", _TIGHT))
)
CTES["obs"] = "SELECT * FROM obs_all WHERE rule = 'base'"
CTES["obs_net"] = "SELECT * FROM obs WHERE net IS NOT NULL"
CTES["obs_day"] = "SELECT trade_date, avg(net) AS m, sum(net) AS s, count(*) AS n FROM obs_net GROUP BY 1"
CTES["calendar"] = f"SELECT d.trade_date, coalesce(o.m, 0) AS return_pct, coalesce(o.n, 0) AS trades FROM (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS trade_date) d LEFT JOIN obs_day o USING (trade_date) WHERE isodow(d.trade_date) <= 5"
CTES["market_now"] = """
SELECT bar_ts, count(*) AS eligible_universe_count, quantile_cont(ret_5m_pct, 0.5) AS median_return_5m_pct, quantile_cont(ret_30m_pct, 0.5) AS median_return_30m_pct, 100.0 * avg(CASE WHEN ret_30m_pct > 0 THEN 1 WHEN ret_30m_pct <= 0 THEN 0 END) AS pct_positive_30m,
  stddev_samp(ret_30m_pct) AS stddev_return_30m_pct, quantile_cont(ret_30m_pct, 0.75) - quantile_cont(ret_30m_pct, 0.25) AS dispersion_30m_pct, quantile_cont(relative_volume_20bar, 0.5) AS median_relative_volume FROM samples GROUP BY bar_ts"""
CTES["equity_days"] = "SELECT *, exp(sum(ln(1 + return_pct / 100)) OVER (ORDER BY trade_date)) AS equity FROM calendar"
CTES["drawdowns"] = "SELECT *, (equity / peak - 1) * 100 AS drawdown_pct FROM (SELECT *, greatest(1.0, max(equity) OVER (ORDER BY trade_date)) AS peak FROM equity_days)"
_PF = lambda x: f"CASE WHEN sum(CASE WHEN {x} < 0 THEN -{x} END) > 0 THEN coalesce(sum(CASE WHEN {x} > 0 THEN {x} END), 0) / sum(CASE WHEN {x} < 0 THEN -{x} END) END"
_WEEK, _MONTH = "strftime(trade_date, '%G-W%V')", "strftime(trade_date, '%Y-%m')"
EXECUTION = xo.ExecutionConfig(max_positions=3, bar_participation_pct=5.0, costs_bps=(20.0, 30.0))


def all_obs(t):
    return bo.with_net(bo.observations(bo.match_rules(t.samples, RULES), 5, "long"), 20.0)


def obs(t):
    return bo.with_net(bo.observations(bo.match_rules(t.samples, {"base": RULE}), 5, "long"), 20.0)


OUTCOMES = ("rule", "symbol", "bar_ts", "trade_date", "minute_of_day", "liquidity_tier", "price_group", "bar_dollar_volume", "gross_return_pct", "net", "mfe_pct", "mae_pct")


def outcomes(t, df=None):
    """Observations (of the base rule, if none are given) as a table of few columns, for operators that read them more than once."""
    return kept((obs(t) if df is None else df).select(*OUTCOMES), "outcomes")


STATE = ("bar_ts", "high", "low", "cumulative_high", "cumulative_low", "cumulative_range_position", "relative_volume_20bar", "relative_trade_count_20bar", "ret_5m_pct", "ret_30m_pct", "rolling_realised_volatility_30bar",
         "previous_day_realised_volatility", "activity_adjusted_return_5m", "prior_activity_adjusted_return_5m")


def calendar(t):
    return eo.calendar_returns(obs(t), FIRST, LAST)


def market(t):
    s = kept(t.samples.select(*STATE), "market-samples")
    b = mo.market_breadth(s, (5, 30))
    return b.join(mo.market_breadth_extras(s).select("bar_ts", "median_relative_volume"), "bar_ts", "left")


DELAYS = (0, 1, 2, 5)


def entries(t):
    """Signals of the rule entered so many bars later and left three bars after that, on the same day."""
    bars = t.bars.withColumn("bar_dollar_volume", F.col("close") * F.col("volume"))
    e = bo.join_entry(t.samples.where(ro.rule_filter(RULE)), bars, DELAYS, ("close", "bar_dollar_volume"), 5)
    return bo.join_exit(e, bars, 15)


def symbol_snapshots(t):
    """Each symbol's median daily dollar volume in the lookback of each monthly snapshot, with the days for which it holds."""
    shots = uo.plan_snapshots(t.bars.where("symbol = 'click_0'").select("trade_date").distinct(), 5, 20)
    days = t.bars.groupBy("symbol", "trade_date").agg(F.sum(F.col("close") * F.col("volume")).alias("daily_dollar_volume"))
    back = days.join(F.broadcast(shots), days["trade_date"].between(F.col("lookback_start"), F.col("lookback_end")))
    keys = ("symbol", "snapshot_date", "lookback_end", "effective_start", "effective_end")
    return back.groupBy(*keys).agg(F.percentile("daily_dollar_volume", F.lit(0.5)).alias("median_daily_dollar_volume")).withColumn("completed", F.lit(True))


def signals(t):
    """Sized signals; daily volume is that of the snapshot in force, from days before the signal's only."""
    e = uo.pit_dollar_volume(entries(t).alias("e").join(symbol_snapshots(t).alias("m"), (F.col("e.symbol") == F.col("m.symbol")) & F.col("trade_date").between(F.col("effective_start"), F.col("effective_end")), "left").drop(F.col("m.symbol")))
    e = e.withColumn("capital", F.explode(F.array(*[F.lit(c) for c in EXECUTION.capitals])))
    e = e.select(
        "capital", "delay", "trade_date", "symbol", F.col("bar_ts").alias("signal_ts"), "entry_ts", "exit_ts", F.lit("long").alias("direction"), F.col("entry_close").alias("entry_price"), "exit_price",
        ((F.col("exit_price") / F.col("entry_close") - 1) * 100).alias("gross_return_pct"), F.col("entry_bar_dollar_volume"), F.col("pit_dollar_volume").alias("daily_dollar_volume"),
    )
    return xo.size_fills(e, F.col("capital"), EXECUTION)


def trades(t):
    return xo.allocate_day(signals(t), EXECUTION)


def costed(t):
    return xo.with_costs(trades(t), EXECUTION.costs_bps)


def costed_table(t):
    return kept(costed(t), "costed-trades")


def trades_table(t):
    return kept(trades(t), "trades")


def equity(t):
    return xo.equity_curve(trades_table(t), t.bars, EXECUTION.costs_bps, 5)


def summary(t):
    """One row: all that decisions about the base rule look at."""
    r, k = outcomes(t, all_obs(t)), ["rule"]
    base = bo.obs_metrics(r, k).join(bo.clustered_t(r, k), k).join(bo.top_share(r, k), k).join(eo.event_dependence(r, k), k)
    other = {n: base.where(f"rule = '{n}'").select(F.col("net_avg_pct").alias(f"{n}_net_avg_pct"), F.lit(1).alias("one")) for n in ("relaxed", "tightened")}
    out = base.where("rule = 'base'").withColumn("one", F.lit(1))
    for o in other.values():
        out = out.join(o, "one")
    late = bo.join_entry(t.samples.where(ro.rule_filter(RULE)), t.features, (2,), step_minutes=5).agg((F.avg("entry_fwd_return_5m_pct") - 0.2).alias("delay2_net_avg_pct"), F.lit(1).alias("one"))
    return out.join(late, "one").withColumn("cost30_net_avg_pct", F.col("gross_avg_pct") - 0.3)


_BASE = f"""SELECT (SELECT avg(net) FROM obs_net) AS net_avg_pct, (SELECT avg(gross_return_pct) - 0.3 FROM obs_net) AS cost30, (SELECT {_PF('net')} FROM obs_net) AS pf, (SELECT avg(m) / stddev_samp(m) * sqrt(count(*)) FROM obs_day) AS ct,
(SELECT avg(net) FROM obs_all WHERE rule = 'relaxed') AS relaxed, (SELECT avg(net) FROM obs_all WHERE rule = 'tightened') AS tightened"""
_ENTRY = "SELECT s.symbol, s.bar_ts, s.trade_date, d.delay, s.bar_ts + to_minutes(5 * d.delay) AS entry_ts FROM (SELECT * FROM samples WHERE {}) s, (VALUES (0), (1), (2), (5)) d(delay)".format(RULE_SQL)
_EXIT = f"SELECT e.*, f.close AS entry_close, f.bar_dollar_volume AS entry_bar_dollar_volume, x.close AS exit_price FROM ({_ENTRY}) e LEFT JOIN feat f ON f.symbol = e.symbol AND f.bar_ts = e.entry_ts LEFT JOIN feat x ON x.symbol = e.symbol AND x.bar_ts = e.entry_ts + INTERVAL 15 MINUTE AND x.trade_date = e.trade_date"


CTES["symbol_snapshots"] = f"SELECT d.symbol, p.snapshot_date, p.effective_start, p.effective_end, quantile_cont(v, 0.5) AS median_volume FROM (SELECT symbol, trade_date, sum(close * volume) AS v FROM bars GROUP BY ALL) d JOIN ({_PLAN}) p ON d.trade_date BETWEEN p.lookback_start AND p.lookback_end GROUP BY ALL"
_share = lambda x, pct: f"CASE WHEN {x} * {pct} > 0 THEN {x} * {pct} END"
CTES["sized_signals"] = f"""
SELECT c AS capital, e.delay, e.trade_date, e.symbol, e.bar_ts AS signal_ts, e.entry_ts, e.entry_ts + INTERVAL 15 MINUTE AS exit_ts, e.entry_close AS entry_price, e.exit_price, (e.exit_price / e.entry_close - 1) * 100 AS gross_return_pct,
  p.median_volume AS daily_dollar_volume, c * 0.05 AS desired_notional, coalesce(least({_share('e.entry_bar_dollar_volume', 0.05)}, {_share('p.median_volume', 0.001)}), 0) AS capacity_notional
FROM ({_EXIT}) e LEFT JOIN symbol_snapshots p ON p.symbol = e.symbol AND e.trade_date BETWEEN p.effective_start AND p.effective_end, (VALUES (10000.0::DOUBLE), (100000.0::DOUBLE)) v(c)"""
_KEYS = "capital, delay, trade_date"
CTES["allocated"] = f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY signal_ts, coalesce(daily_dollar_volume, 0) DESC, symbol) AS n FROM sized_signals),
k AS (
  SELECT DISTINCT {_KEYS}, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS filled_notional, CAST(NULL AS VARCHAR) AS rejection_reason, CAST([] AS STRUCT(exit_ts TIMESTAMP, symbol VARCHAR, notional DOUBLE)[]) AS held FROM o
  UNION ALL
  SELECT {_KEYS}, n, CASE WHEN why IS NULL OR why IN ('liquidity_capacity_unavailable', 'minimum_fill_fraction') THEN fill END, why, CASE WHEN why IS NULL THEN list_append(live, {{'exit_ts': exit_ts, 'symbol': symbol, 'notional': fill}}) ELSE live END
  FROM (SELECT *, CASE WHEN entry_price IS NULL THEN 'unavailable_entry_fill' WHEN exit_price IS NULL THEN 'unavailable_exit_fill' WHEN list_contains(list_transform(live, lambda x: x.symbol), symbol) THEN 'existing_symbol_position' WHEN len(live) >= 3 THEN 'max_positions'
      WHEN capacity_notional <= 0 THEN 'liquidity_capacity_unavailable' WHEN fill <= 0 OR fill / desired_notional < 0.25 THEN 'minimum_fill_fraction' END AS why
    FROM (SELECT *, greatest(0, least(desired_notional, capital * 0.1, capacity_notional, capital - coalesce(list_sum(list_transform(live, lambda x: x.notional)), 0))) AS fill
      FROM (SELECT o.*, CASE WHEN o.entry_price IS NULL OR o.exit_price IS NULL THEN k.held ELSE list_filter(k.held, lambda x: x.exit_ts > o.entry_ts) END AS live FROM k JOIN o ON o.capital = k.capital AND o.delay = k.delay AND o.trade_date = k.trade_date AND o.n = k.n + 1))))
SELECT o.*, k.filled_notional, k.rejection_reason, k.rejection_reason IS NULL AS accepted FROM k JOIN o USING ({_KEYS}, n)"""
CTES["costed_trades"] = "SELECT a.*, c AS cost_bps, gross_return_pct - c / 100 AS net_return_pct, filled_notional * c / 10000 AS estimated_cost FROM allocated a, (VALUES (20.0::DOUBLE), (30.0::DOUBLE)) v(c) WHERE accepted"
_SCENE = "capital, delay, cost_bps"
CTES["money"] = f"""
SELECT {_SCENE}, count(*) AS trades, avg(net_return_pct) AS net_expected_value_pct, 100.0 * avg(CASE WHEN net_return_pct > 0.01 THEN 1 ELSE 0 END) AS trade_win_rate_pct, 100.0 * avg(CASE WHEN net_return_pct < -0.01 THEN 1 ELSE 0 END) AS loss_rate_pct, sum(filled_notional * gross_return_pct / 100) AS gross_pnl, sum(filled_notional * net_return_pct / 100) AS net_pnl,
  sum(estimated_cost) AS estimated_costs, quantile_cont(capacity_notional, 0.5) AS median_trade_capacity, count(DISTINCT signal_ts) AS independent_event_count, {_PF('net_return_pct')} AS profit_factor FROM costed_trades GROUP BY ALL"""
_OPEN = "SELECT t.*, b.close AS mark FROM (SELECT *, unnest(generate_series(entry_ts, exit_ts - INTERVAL 5 MINUTE, INTERVAL 5 MINUTE)) AS ts FROM {}) t LEFT JOIN bars b ON b.symbol = t.symbol AND b.bar_ts = t.ts"
CTES["equity_points"] = f"""
SELECT *, capital + realised_pnl + open_pnl AS equity FROM (
  SELECT {_SCENE}, trade_date, ts, coalesce(open_pnl, 0) AS open_pnl, coalesce(gross_exposure, 0) AS gross_exposure, coalesce(gross_exposure, 0) AS net_exposure, coalesce(open_positions, 0) AS open_positions, sum(coalesce(closed, 0)) OVER (PARTITION BY {_SCENE} ORDER BY trade_date, ts ROWS UNBOUNDED PRECEDING) AS realised_pnl
  FROM (SELECT {_SCENE}, trade_date, ts, sum(filled_notional * (mark / entry_price - 1)) AS open_pnl, sum(filled_notional) AS gross_exposure, count(*) AS open_positions FROM ({_OPEN.format('costed_trades')}) GROUP BY ALL)
  FULL JOIN (SELECT {_SCENE}, trade_date, exit_ts AS ts, sum(filled_notional * net_return_pct / 100) AS closed FROM costed_trades GROUP BY ALL) USING ({_SCENE}, trade_date, ts))"""
CTES["equity_peaks"] = f"SELECT *, (equity / peak - 1) * 100 AS drawdown_pct FROM (SELECT *, greatest(capital, max(equity) OVER (PARTITION BY {_SCENE} ORDER BY trade_date, ts ROWS UNBOUNDED PRECEDING)) AS peak FROM equity_points)"
CTES["portfolio_days"] = f"""
SELECT e.*, (end_equity / coalesce(lag(end_equity) OVER (PARTITION BY {_SCENE} ORDER BY trade_date), capital) - 1) * 100 AS return_pct, t.turnover, t.costs
FROM (SELECT {_SCENE}, trade_date, arg_max(equity, ts) AS end_equity, max(gross_exposure) AS peak_gross_exposure, min(drawdown_pct) AS worst_drawdown_pct FROM equity_peaks GROUP BY ALL) e
LEFT JOIN (SELECT {_SCENE}, trade_date, 2 * sum(filled_notional) AS turnover, sum(estimated_cost) AS costs FROM costed_trades GROUP BY ALL) t USING ({_SCENE}, trade_date)"""


def load() -> None:
    _replay()
    _economics()
    _execution()
    _decisions()
    _integrity()


def _replay() -> None:
    key = "symbol, bar_ts, session_label"
    range_sql = lambda low: f"SELECT *, max(high) OVER w AS path_high, min(low) OVER w AS path_low FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts RANGE BETWEEN {low} AND INTERVAL 30 MINUTE FOLLOWING)"
    register("c7_excursion", f"{key}, path_high:d, path_low:d", lambda t: bo.with_excursion(t.bars, 30), range_sql("INTERVAL 1 MINUTE FOLLOWING"))
    register("c8_path", f"{key}, path_high:d, path_low:d", lambda t: bo.with_path(t.bars, 30), range_sql("CURRENT ROW"))
    register("c5_join_entry", "symbol, bar_ts, delay:l, entry_ts, entry_close:d", lambda t: bo.join_entry(t.samples.where(ro.rule_filter(RULE)), t.features, DELAYS, step_minutes=5), f"SELECT e.*, f.close AS entry_close FROM ({_ENTRY}) e LEFT JOIN feat f ON f.symbol = e.symbol AND f.bar_ts = e.entry_ts")
    register("c6_join_exit", "symbol, bar_ts, delay:l, exit_price:d", entries, _EXIT)
    register("c21_match_rules", "rule, symbol, bar_ts", all_obs, "SELECT * FROM obs_all")
    register("b23_perturbed_rules", "rule, n:l", lambda t: all_obs(t).groupBy("rule").agg(F.count("*").alias("n")), "SELECT rule, count(*) AS n FROM obs_all GROUP BY 1")
    def variants(t):
        late = bo.join_entry(t.samples.where(ro.rule_filter(RULE)), t.features, DELAYS, step_minutes=5)
        late = late.select("delay", F.col("entry_fwd_return_5m_pct").alias("gross_return_pct"), F.lit(0.0).alias("mfe_pct"), F.lit(0.0).alias("mae_pct"))
        return bo.obs_metrics(kept(bo.with_net(late, 20.0), "variants"), ["delay"])

    metrics = "candidate_signals:l, observations:l, missing_outcomes:l, missing_data_rate_pct:d, gross_avg_pct:d, net_avg_pct:d, median_pct:d, p05_pct:d, p25_pct:d, p75_pct:d, p95_pct:d, worst_pct:d, best_pct:d, win_rate_pct:d, stdev_pct:d, t_stat:d, profit_factor:d, mfe_avg_pct:d, mfe_median_pct:d, mae_avg_pct:d, mae_median_pct:d"
    sql = f"""count(*) AS candidate_signals, count(net) AS observations, count(*) - count(net) AS missing_outcomes, 100.0 * (count(*) - count(net)) / count(*) AS missing_data_rate_pct, avg(gross_return_pct) AS gross_avg_pct, avg(net) AS net_avg_pct,
      {', '.join(f'quantile_cont(net, {q}) AS {n}' for n, q in bo.PERCENTILES.items())}, min(net) AS worst_pct, max(net) AS best_pct, 100.0 * avg(CASE WHEN net > 0 THEN 1 WHEN net <= 0 THEN 0 END) AS win_rate_pct, stddev_samp(net) AS stdev_pct,
      avg(net) / stddev_samp(net) * sqrt(count(net)) AS t_stat, {_PF('net')} AS profit_factor, avg(mfe_pct) AS mfe_avg_pct, quantile_cont(mfe_pct, 0.5) AS mfe_median_pct, avg(mae_pct) AS mae_avg_pct, quantile_cont(mae_pct, 0.5) AS mae_median_pct"""
    register("d20_observation_metrics", f"rule, {metrics}", lambda t: bo.obs_metrics(outcomes(t, all_obs(t)), ["rule"]), f"SELECT rule, {sql} FROM obs_all GROUP BY rule")
    register("d26_variant_metrics", "delay:l, observations:l, net_avg_pct:d", variants,
             f"SELECT d.delay, count(f.fwd_return_5m_pct) AS observations, avg(f.fwd_return_5m_pct - 0.2) AS net_avg_pct FROM (SELECT * FROM samples WHERE {RULE_SQL}) s CROSS JOIN (VALUES (0), (1), (2), (5)) d(delay) LEFT JOIN feat f ON f.symbol = s.symbol AND f.bar_ts = s.bar_ts + to_minutes(5 * d.delay) GROUP BY 1")
    register("d21_clustered_t", "rule, dates:l, date_clustered_t_stat:d", lambda t: bo.clustered_t(all_obs(t), ["rule"]), "SELECT rule, count(*) AS dates, avg(m) / stddev_samp(m) * sqrt(count(*)) AS date_clustered_t_stat FROM (SELECT rule, trade_date, avg(net) AS m FROM obs_all WHERE net IS NOT NULL GROUP BY ALL) GROUP BY rule")
    register("d22_leave_one_date_out", "leave_one_date_out_min_net_avg_pct:d", lambda t: bo.loo_min(obs(t), ["rule"]), "SELECT min(((SELECT sum(s) FROM obs_day) - s) / nullif((SELECT sum(n) FROM obs_day) - n, 0)) AS leave_one_date_out_min_net_avg_pct FROM obs_day")
    k = lambda p: f"greatest(1, ceil(n * {p} / 100.0))"
    tops = ", ".join(f"100.0 * sum(CASE WHEN r <= {k(p)} THEN net END) / any_value(total) AS top_{p}pct_return_share_pct, avg(CASE WHEN r > {k(p)} THEN net END) AS net_expectancy_excluding_top_{p}pct_pct" for p in (1, 5, 10))
    register("d23_top_share", "rule, " + ", ".join(f"top_{p}pct_return_share_pct:d, net_expectancy_excluding_top_{p}pct_pct:d" for p in (1, 5, 10)), lambda t: bo.top_share(outcomes(t, all_obs(t)), ["rule"]), f"SELECT rule, {tops} FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY net DESC) AS r, count(*) OVER (PARTITION BY rule) AS n, sum(net) OVER (PARTITION BY rule) AS total FROM obs_all WHERE net IS NOT NULL) GROUP BY rule")
    dims = {"liquidity_tier": "liquidity_tier", "price_group": "price_group", "symbol": "symbol", "trade_date": "CAST(trade_date AS VARCHAR)", "month": _MONTH, "year": "strftime(trade_date, '%Y')"}
    register("d24_breakdown", "dimension, value, observations:l, net_avg_pct:d, median_pct:d", lambda t: bo.breakdown(outcomes(t)), " UNION ALL ".join(f"SELECT '{n}' AS dimension, {e} AS value, count(net) AS observations, avg(net) AS net_avg_pct, quantile_cont(net, 0.5) AS median_pct FROM obs GROUP BY {e}" for n, e in dims.items()))
    register("d25_cost_grid", "cost_bps:d, observations:l, net_avg_pct:d, win_rate_pct:d, profit_factor:d", lambda t: bo.obs_metrics(bo.cost_grid(outcomes(t)), ["cost_bps"]), f"SELECT cost_bps, count(x) AS observations, avg(x) AS net_avg_pct, 100.0 * avg(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS win_rate_pct, {_PF('x')} AS profit_factor FROM (SELECT c AS cost_bps, gross_return_pct - c / 100.0 AS x FROM obs_net, (VALUES (20), (25), (30), (40)) v(c)) GROUP BY 1")
    context = "median_return_5m_pct:d, pct_positive_30m:d, prior_median_return_5m_pct:d, prior_pct_positive_30m:d"
    register("c12_join_context", f"symbol, bar_ts, bar_dollar_volume:d, {context}", lambda t: bo.join_context(obs(t).drop("bar_dollar_volume"), t.features, market(t)),
             "SELECT o.symbol, o.bar_ts, o.bar_dollar_volume, m.median_return_5m_pct, m.pct_positive_30m, p.median_return_5m_pct AS prior_median_return_5m_pct, p.pct_positive_30m AS prior_pct_positive_30m FROM obs o LEFT JOIN market_now m USING (bar_ts) LEFT JOIN market_now p ON p.bar_ts = o.bar_ts - INTERVAL 5 MINUTE")
    states = ("stddev_return_30m_pct", "dispersion_30m_pct", "median_relative_volume")
    register("d48_regime_thresholds", ", ".join(f"{c}_p25:d, {c}_p75:d, {c}_n:l" for c in states), lambda t: bo.regime_thresholds(kept(market(t), "market")), "SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS {c}_p25, quantile_cont({c}, 0.75) AS {c}_p75, count({c}) AS {c}_n" for c in states) + " FROM market_now")

    def regimes(t):
        m = kept(market(t), "market")
        limits = bo.regime_thresholds(m)  # one row, which goes to every task
        table = outcomes(t)
        o = bo.join_context(table.drop("bar_dollar_volume"), table, m, ("median_return_30m_pct", "pct_positive_30m", "stddev_return_30m_pct", "dispersion_30m_pct", "median_relative_volume"))
        o = kept(joined(o, F.broadcast(limits), []).select("bar_ts", "trade_date", "net", *[v.alias(k) for k, v in bo.regime_labels({c: F.col(c) for c in limits.columns}).items()]), "regimes")
        return bo.regime_stats(o, {k: F.col(k) for k in o.columns[3:]})

    band = lambda x, low, high, a, b, c: f"CASE WHEN {x} < {low} THEN '{a}' WHEN {x} > {high} THEN '{c}' WHEN {x} IS NOT NULL THEN '{b}' END"
    q = lambda c, p: f"(SELECT quantile_cont({c}, {p}) FROM market_now)"
    labels = {
        "market_direction": band("median_return_30m_pct", -0.1, 0.1, "falling", "sideways", "rising"), "breadth": band("pct_positive_30m", 40, 60, "weak", "neutral", "strong"),
        "session": "CASE WHEN minute_of_day < 660 THEN 'opening' WHEN minute_of_day >= 900 THEN 'closing' ELSE 'midday' END", "volatility_change": band("(stddev_return_30m_pct - prior_stddev)", -0.02, 0.02, "falling", "steady", "rising"),
        **{n: band(c, q(c, 0.25), q(c, 0.75), "low", "normal", "high") for n, c in (("volatility_level", "stddev_return_30m_pct"), ("dispersion", "dispersion_30m_pct"), ("activity", "median_relative_volume"))},
    }
    ctx = "SELECT o.*, m.median_return_30m_pct, m.pct_positive_30m, m.stddev_return_30m_pct, m.dispersion_30m_pct, m.median_relative_volume, p.stddev_return_30m_pct AS prior_stddev FROM obs_net o LEFT JOIN market_now m USING (bar_ts) LEFT JOIN market_now p ON p.bar_ts = o.bar_ts - INTERVAL 5 MINUTE"
    union = " UNION ALL ".join(f"SELECT '{n}' AS regime, {e} AS label, bar_ts, net FROM c" for n, e in labels.items())
    regime_sql = f"""WITH c AS ({ctx}), u AS ({union}), l AS (SELECT * FROM u WHERE label IS NOT NULL), e AS (SELECT regime, label, avg(m) AS em, count(*) AS events FROM (SELECT regime, label, bar_ts, avg(net) AS m FROM l GROUP BY ALL) GROUP BY ALL),
      a AS (SELECT regime, label, count(*) AS observations, avg(net) AS net_avg_pct, quantile_cont(net, 0.5) AS median_pct, {_PF('net')} AS profit_factor FROM l GROUP BY ALL)
    SELECT *, observations >= 30 AND events >= 5 AS supported, observations >= 30 AND events >= 5 AND (net_avg_pct <= 0 OR em <= 0) AS negative FROM a JOIN e USING (regime, label)"""
    register("d49_regime_stats", "regime, label, observations:l, events:l, net_avg_pct:d, median_pct:d, profit_factor:d, supported, negative", regimes, regime_sql)


def _economics() -> None:
    x = "net"
    register("d27_trade_distribution", "observations:l, average_winner_pct:d, median_winner_pct:d, average_loser_pct:d, median_loser_pct:d, breakeven_trades:l, win_loss_magnitude_ratio:d, p01_pct:d, skewness:d, excess_kurtosis:d", lambda t: eo.trade_distribution(outcomes(t), ["rule"]),
             f"""SELECT count(*) AS observations, avg(CASE WHEN {x} > 0 THEN {x} END) AS average_winner_pct, quantile_cont(CASE WHEN {x} > 0 THEN {x} END, 0.5) AS median_winner_pct, avg(CASE WHEN {x} < 0 THEN {x} END) AS average_loser_pct, quantile_cont(CASE WHEN {x} < 0 THEN {x} END, 0.5) AS median_loser_pct,
             count_if({x} = 0) AS breakeven_trades, abs(avg(CASE WHEN {x} > 0 THEN {x} END) / avg(CASE WHEN {x} < 0 THEN {x} END)) AS win_loss_magnitude_ratio, quantile_cont({x}, 0.01) AS p01_pct, avg(pow((net - mu) / sd, 3)) AS skewness, avg(pow((net - mu) / sd, 4)) - 3 AS excess_kurtosis FROM (SELECT net, avg(net) OVER () AS mu, stddev_pop(net) OVER () AS sd FROM obs_net) HAVING count(*) > 0""")  # fmt: skip
    register("d28_expected_shortfall", "expected_shortfall_95_pct:d, expected_shortfall_99_pct:d", lambda t: eo.expected_shortfall(outcomes(t), ["rule"]), "SELECT avg(CASE WHEN net <= (SELECT quantile_cont(net, 0.05) FROM obs_net) THEN net END) AS expected_shortfall_95_pct, avg(CASE WHEN net <= (SELECT quantile_cont(net, 0.01) FROM obs_net) THEN net END) AS expected_shortfall_99_pct FROM obs_net HAVING count(*) > 0")
    events = "SELECT bar_ts, avg(net) AS m, count(*) AS n FROM obs_net GROUP BY 1"
    register("d29_event_dependence", "independent_timestamp_events:l, event_ratio:d, average_trades_per_event:d, max_trades_per_event:l, p95_trades_per_event:d, event_level_net_expectancy_pct:d, event_level_median_pct:d, event_level_win_rate_pct:d", lambda t: eo.event_dependence(outcomes(t), ["rule"]),
             f"SELECT count(*) AS independent_timestamp_events, count(*) / sum(n) AS event_ratio, avg(n) AS average_trades_per_event, max(n) AS max_trades_per_event, quantile_cont(n, 0.95) AS p95_trades_per_event, avg(m) AS event_level_net_expectancy_pct, quantile_cont(m, 0.5) AS event_level_median_pct, 100.0 * avg(CASE WHEN m > 0 THEN 1 ELSE 0 END) AS event_level_win_rate_pct FROM ({events}) HAVING count(*) > 0")
    register("d30_intraclass_correlation", "icc:d", lambda t: eo.icc(obs(t), ["bar_ts"], ["rule"]),
             "WITH g AS (SELECT bar_ts, count(*) AS n, avg(net) AS m FROM obs_net GROUP BY 1), a AS (SELECT (SELECT count(*) FROM g) AS k, (SELECT count(*) FROM obs_net) AS t, (SELECT avg(net) FROM obs_net) AS mu), b AS (SELECT (SELECT sum(n * pow(m - mu, 2)) FROM g, a) / (k - 1) AS bt, (SELECT sum(pow(o.net - g.m, 2)) FROM obs_net o JOIN g USING (bar_ts)) / (t - k) AS wi, (t - (SELECT sum(n * n) FROM g) / t) / (k - 1) AS n0 FROM a) SELECT (bt - wi) / (bt + (n0 - 1) * wi) AS icc FROM b WHERE (SELECT count(*) FROM obs_net) > 0")
    register("d31_effective_events", "effective_events:d", lambda t: eo.event_dependence(outcomes(t), ["rule"]), f"SELECT sum(n) * sum(n) / sum(n * n) AS effective_events FROM ({events}) HAVING count(*) > 0")
    register("d32_mae_correlation", "pairs:l, mae_final_outcome_correlation:d", lambda t: eo.mae_corr(obs(t), ["rule"]), "SELECT count(*) AS pairs, CASE WHEN count(*) >= 3 THEN corr(mae_pct, net) END AS mae_final_outcome_correlation FROM obs_net WHERE mae_pct IS NOT NULL HAVING count(*) > 0")
    register("d33_calendar_returns", "trade_date, return_pct:d, trades:l", calendar, "SELECT * FROM calendar")
    register("d33_calendar_summary", "active_days:l, market_days:l, average_return_per_active_day_pct:d, average_return_per_market_day_pct:d, median_return_per_market_day_pct:d, profitable_market_day_pct:d", lambda t: eo.calendar_summary(calendar(t)), "SELECT count_if(trades > 0) AS active_days, count(*) AS market_days, avg(CASE WHEN trades > 0 THEN return_pct END) AS average_return_per_active_day_pct, avg(return_pct) AS average_return_per_market_day_pct, quantile_cont(return_pct, 0.5) AS median_return_per_market_day_pct, 100.0 * avg(CASE WHEN return_pct > 0 THEN 1 ELSE 0 END) AS profitable_market_day_pct FROM calendar")
    register("d34_period_compound", "period, return_pct:d", lambda t: eo.period_compound(calendar(t), "week").unionByName(eo.period_compound(calendar(t), "month")), " UNION ALL ".join(f"SELECT {w} AS period, (exp(sum(ln(1 + return_pct / 100))) - 1) * 100 AS return_pct FROM calendar GROUP BY 1" for w in (_WEEK, _MONTH)))
    register("d35_risk_ratios", "compounded_pct:d, annualised_return_pct:d, sharpe:d, sortino:d", lambda t: eo.risk_ratios(calendar(t)), "SELECT (w - 1) * 100 AS compounded_pct, CASE WHEN n >= 20 THEN pow(w, 252.0 / n) * 100 - 100 END AS annualised_return_pct, m / sd * sqrt(252) AS sharpe, m / down * sqrt(252) AS sortino FROM (SELECT count(*) AS n, exp(sum(ln(1 + return_pct / 100))) AS w, avg(return_pct) AS m, stddev_samp(return_pct) AS sd, sqrt(avg(pow(least(return_pct, 0), 2))) AS down FROM calendar)")
    register("d36_turnover", "trades:l, trades_per_active_day:d, cost_drag_pct:d", lambda t: eo.turnover(obs(t), 20.0), "SELECT count(*) AS trades, count(*) / count(DISTINCT trade_date) AS trades_per_active_day, CASE WHEN avg(gross_return_pct) > 0 THEN 20.0 / avg(gross_return_pct) END AS cost_drag_pct FROM obs_net")
    sweep = "SELECT trade_date, bar_ts AS ts, 1 AS delta FROM obs UNION ALL SELECT trade_date, bar_ts + INTERVAL 15 MINUTE, -1 FROM obs"
    register("g2_boundary_events", "trade_date, ts, delta:l", lambda t: eo.boundary_events(obs(t), 15), sweep)
    register("d37_concurrency", "trade_date, maximum_concurrent_positions:l, position_minutes:d", lambda t: eo.concurrency(obs(t), 15), f"SELECT trade_date, max(open) AS maximum_concurrent_positions, sum(open * coalesce(epoch(nx - ts) / 60, 0)) AS position_minutes FROM (SELECT *, sum(d) OVER (PARTITION BY trade_date ORDER BY ts) AS open, lead(ts) OVER (PARTITION BY trade_date ORDER BY ts) AS nx FROM (SELECT trade_date, ts, sum(delta) AS d FROM ({sweep}) GROUP BY ALL)) GROUP BY 1")
    register("d38_occupancy", "trade_date, occupied_minutes:d", lambda t: eo.occupancy(obs(t), 15), "SELECT trade_date, count(DISTINCT m) * 5 AS occupied_minutes FROM (SELECT trade_date, unnest(generate_series(bar_ts, bar_ts + INTERVAL 10 MINUTE, INTERVAL 5 MINUTE)) AS m FROM obs) GROUP BY 1")
    register("d39_capacity", "rate:d, least:d, p05:d, median:d, p95:d, capacity_least:d, capacity_median:d, missing_pct:d", lambda t: eo.capacity_metrics(outcomes(t)), "SELECT rate, least, p05, median, p95, least * rate AS capacity_least, median * rate AS capacity_median, 0 AS missing_pct FROM (SELECT min(bar_dollar_volume) AS least, quantile_cont(bar_dollar_volume, 0.05) AS p05, quantile_cont(bar_dollar_volume, 0.5) AS median, quantile_cont(bar_dollar_volume, 0.95) AS p95 FROM obs), (VALUES (0.01), (0.02), (0.05)) r(rate)")
    register("e20_drawdown", "trade_date, equity:d, peak:d, drawdown_pct:d", lambda t: eo.with_drawdown(calendar(t)), "SELECT * FROM drawdowns")
    runs = "SELECT g, count(*) AS n FROM (SELECT *, count_if(drawdown_pct >= -1e-9) OVER (ORDER BY trade_date) AS g FROM drawdowns) WHERE drawdown_pct < -1e-9 GROUP BY g"
    register("e21_drawdown_stats", "maximum_drawdown_pct:d, average_drawdown_pct:d, underwater_market_days:l, maximum_underwater_duration_market_days:l, average_drawdown_duration_market_days:d, ending_equity_multiple:d", lambda t: eo.drawdown_stats(calendar(t)),
             f"SELECT (SELECT min(drawdown_pct) FROM drawdowns) AS maximum_drawdown_pct, (SELECT avg(drawdown_pct) FROM drawdowns WHERE drawdown_pct < -1e-9) AS average_drawdown_pct, (SELECT count(*) FROM drawdowns WHERE drawdown_pct < -1e-9) AS underwater_market_days, (SELECT max(n) FROM ({runs})) AS maximum_underwater_duration_market_days, (SELECT avg(n) FROM ({runs})) AS average_drawdown_duration_market_days, (SELECT arg_max(equity, trade_date) FROM drawdowns) AS ending_equity_multiple")
    w = "(ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    rolled = f"SELECT *, m / nullif(sd, 0) * sqrt(252) AS rolling_sharpe FROM (SELECT trade_date, count(*) OVER {w} AS size, avg(return_pct) OVER {w} AS m, stddev_samp(return_pct) OVER {w} AS sd, sum(CASE WHEN return_pct > 0 THEN return_pct ELSE 0 END) OVER {w} / nullif(sum(CASE WHEN return_pct < 0 THEN -return_pct ELSE 0 END) OVER {w}, 0) AS rolling_profit_factor, (exp(sum(ln(1 + return_pct / 100)) OVER {w}) - 1) * 100 AS rolling_return_pct FROM calendar) WHERE size = 5"
    register("e22_rolling_stats", "trade_date, rolling_mean_pct:d, rolling_profit_factor:d, rolling_return_pct:d, rolling_sharpe:d", lambda t: eo.rolling_stats(calendar(t), 5), f"SELECT *, m AS rolling_mean_pct FROM ({rolled})")
    register("e22_rolling_summary", "minimum_rolling_mean_pct:d, median_rolling_mean_pct:d, minimum_rolling_return_pct:d", lambda t: eo.rolling_summary(eo.rolling_stats(calendar(t), 5)), f"SELECT min(m) AS minimum_rolling_mean_pct, quantile_cont(m, 0.5) AS median_rolling_mean_pct, min(rolling_return_pct) AS minimum_rolling_return_pct FROM ({rolled})")
    register("e23_losing_streak", "longest_losing_streak:l", lambda t: eo.losing_streak(calendar(t)), "SELECT coalesce(max(n), 0) AS longest_losing_streak FROM (SELECT g, count(*) AS n FROM (SELECT *, count_if(return_pct >= 0) OVER (ORDER BY trade_date) AS g FROM calendar WHERE trades > 0) WHERE return_pct < 0 GROUP BY g)")
    share = lambda e: f"(SELECT 100.0 * max(r) / sum(r) FROM (SELECT {e} AS g, sum(return_pct) AS r FROM calendar GROUP BY 1))"
    register("e24_best_share", "best_day_share_pct:d, best_week_share_pct:d, best_month_share_pct:d", lambda t: eo.best_share(calendar(t)), f"SELECT {share('trade_date')} AS best_day_share_pct, {share(_WEEK)} AS best_week_share_pct, {share(_MONTH)} AS best_month_share_pct")


REQUIRED = ("discovery", "validation", "robustness")


def runs(t):
    """A ledger of research runs from orders."""
    o = t["orders"]
    return o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 50).alias("rule_id"), F.element_at(F.array(*[F.lit(x) for x in REQUIRED]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("stage"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("config_hash"), (F.col("o_totalprice") - 150_000).alias("net_expected_value_pct"), F.col("o_orderdate").alias("completed_at"))


_PASSED = "SELECT ['discovery', 'validation', 'robustness'][o_orderkey % 3 + 1] FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 = 3 AND o_totalprice > 150000"


def _execution() -> None:
    scenario = "capital:d, delay:l"
    reason = "CASE WHEN entry_price IS NULL THEN 'unavailable_entry_fill' WHEN exit_price IS NULL THEN 'unavailable_exit_fill' WHEN capacity_notional <= 0 THEN 'liquidity_capacity_unavailable' WHEN filled_notional / desired_notional < 0.25 THEN 'minimum_fill_fraction' END"
    def portfolio(t):
        table = trades_table(t)
        return xo.daily_portfolio(xo.equity_curve(table, t.bars, EXECUTION.costs_bps, 5), xo.with_costs(table, EXECUTION.costs_bps))

    register("d40_size_fills", f"{scenario}, symbol, signal_ts, capacity_notional:d, filled_notional:d, fill_fraction:d, rejection_reason", signals, f"SELECT *, filled_notional / desired_notional AS fill_fraction, {reason} AS rejection_reason FROM (SELECT *, greatest(0, least(desired_notional, capital * 0.1, capacity_notional)) AS filled_notional FROM sized_signals)")
    register("d41_allocate_day", f"{scenario}, trade_date, symbol, signal_ts, accepted, rejection_reason, filled_notional:d", trades, "SELECT * FROM allocated")
    register("d42_dedupe_overlaps", "symbol, trade_date, bar_ts", lambda t: xo.dedupe_overlaps(obs(t), 15),
             "WITH RECURSIVE o AS MATERIALIZED (SELECT DISTINCT symbol, trade_date, bar_ts FROM obs), k AS (SELECT symbol, trade_date, min(bar_ts) AS bar_ts FROM o GROUP BY ALL UNION ALL SELECT symbol, trade_date, nx FROM (SELECT k.symbol, k.trade_date, (SELECT min(o.bar_ts) FROM o WHERE o.symbol = k.symbol AND o.trade_date = k.trade_date AND o.bar_ts >= k.bar_ts + INTERVAL 15 MINUTE) AS nx FROM k) WHERE nx IS NOT NULL) SELECT * FROM k")
    register("d43_rejections", f"{scenario}, reason, n:l, share_pct:d", lambda t: xo.rejections(trades(t)), "SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY capital, delay) AS share_pct FROM (SELECT capital, delay, coalesce(rejection_reason, 'accepted') AS reason, count(*) AS n FROM allocated GROUP BY ALL)")
    money = "SELECT * FROM money"
    register("d44_money_metrics", f"{scenario}, cost_bps:d, trades:l, net_expected_value_pct:d, trade_win_rate_pct:d, loss_rate_pct:d, gross_pnl:d, net_pnl:d, estimated_costs:d, median_trade_capacity:d, profit_factor:d", lambda t: xo.trade_money_metrics(costed_table(t), EXECUTION), money)
    register("d47_stress_matrix", f"{scenario}, cost_bps:d, trades:l, net_expected_value_pct:d, net_pnl:d", lambda t: xo.stress_matrix(trades_table(t), EXECUTION), money)
    register("c13_open_positions", f"{scenario}, symbol, ts, mark:d", lambda t: xo.holdings(trades(t).where("accepted"), t.bars, 5), _OPEN.format("(SELECT * FROM allocated WHERE accepted)"))
    register("d45_equity_curve", f"{scenario}, cost_bps:d, ts, realised_pnl:d, open_pnl:d, gross_exposure:d, net_exposure:d, open_positions:l, equity:d", equity, "SELECT * FROM equity_points")
    register("e20_equity_drawdown", f"{scenario}, cost_bps:d, ts, peak:d, drawdown_pct:d", lambda t: xo.with_drawdown(equity(t)), "SELECT * FROM equity_peaks")
    register("d46_daily_portfolio", f"{scenario}, cost_bps:d, trade_date, end_equity:d, return_pct:d, turnover:d, costs:d, peak_gross_exposure:d, worst_drawdown_pct:d", portfolio, "SELECT * FROM portfolio_days")

    def by_regime(t):
        spy = mo.benchmark_pivot(mo.benchmark_features(t.bars, proxies.BENCHMARKS, 5), {"click_0": "spy"}, ("ret_30m_pct",)).select("bar_ts", F.col("spy_ret_30m_pct").alias("spy_return_30m_pct"))
        m = market(t).join(spy, "bar_ts", "left").withColumn("minute_of_day", F.hour("bar_ts") * 60 + F.minute("bar_ts")).withColumnRenamed("bar_ts", "signal_ts")
        return bo.strategy_regimes(kept(costed(t).where("capital = 10000 AND delay = 0 AND cost_bps = 20").join(m, "signal_ts", "left"), "trades-in-markets"))

    bands = {
        "breadth": "CASE WHEN b < 40 THEN 'weak' WHEN b > 60 THEN 'strong' ELSE 'neutral' END", "spy_30m": "CASE WHEN coalesce(s, 0) < -0.25 THEN 'falling' WHEN coalesce(s, 0) > 0.25 THEN 'rising' ELSE 'sideways' END",
        "dispersion": "CASE WHEN coalesce(d, 0) < 1 THEN 'low' WHEN coalesce(d, 0) >= 2 THEN 'high' ELSE 'medium' END", "market_activity": "CASE WHEN coalesce(v, 0) < 0.8 THEN 'low' WHEN coalesce(v, 0) >= 1.5 THEN 'high' ELSE 'normal' END",
        "session": "CASE WHEN hour(signal_ts) * 60 + minute(signal_ts) < 660 THEN 'opening' WHEN hour(signal_ts) * 60 + minute(signal_ts) >= 900 THEN 'closing' ELSE 'midday' END",
    }
    chosen = "SELECT c.*, m.pct_positive_30m AS b, s.ret_30m_pct AS s, m.stddev_return_30m_pct AS d, m.median_relative_volume AS v FROM (SELECT * FROM costed_trades WHERE capital = 10000 AND delay = 0 AND cost_bps = 20) c LEFT JOIN market_now m ON m.bar_ts = c.signal_ts LEFT JOIN (SELECT * FROM feat WHERE symbol = 'click_0') s ON s.bar_ts = c.signal_ts"
    union = " UNION ALL ".join(f"SELECT '{n}' AS regime_type, {e} AS regime_value, * FROM w WHERE b IS NOT NULL" for n, e in bands.items())
    register("d50_strategy_regimes", "regime_type, regime_value, observations:l, independent_events:l, net_avg_pct:d, median_pct:d, profit_factor:d, win_rate_pct:d, total_pnl:d, coverage_pct:d", by_regime,
             f"""WITH w AS ({chosen}) SELECT regime_type, regime_value, count(*) AS observations, count(DISTINCT signal_ts) AS independent_events, avg(net_return_pct) AS net_avg_pct, quantile_cont(net_return_pct, 0.5) AS median_pct, {_PF('net_return_pct')} AS profit_factor,
             100.0 * avg(CASE WHEN net_return_pct > 0 THEN 1 ELSE 0 END) AS win_rate_pct, sum(filled_notional * net_return_pct / 100) AS total_pnl, (SELECT 100.0 * count(b) / count(*) FROM w) AS coverage_pct FROM ({union}) GROUP BY ALL""")  # fmt: skip

    def scored_card(t):
        table = trades_table(t)
        c = xo.with_costs(table, EXECUTION.costs_bps)
        s = xo.trade_money_metrics(c, EXECUTION).where("capital = 10000")
        pick = lambda cost, delay, name: F.max(F.when((F.col("cost_bps") == cost) & (F.col("delay") == delay), F.col("net_expected_value_pct"))).alias(name)
        stress = s.groupBy("capital").agg(pick(30, 0, "stress_30_0"), pick(20, 1, "stress_base_1"), pick(20, 2, "stress_base_2"), pick(20, 5, "stress_base_5"))
        base = xo.trade_money_metrics(c.where("cost_bps = 20 AND delay = 0"), EXECUTION).where("capital = 10000")
        days = xo.daily_portfolio(xo.equity_curve(table, t.bars, EXECUTION.costs_bps, 5), c).where("capital = 10000 AND cost_bps = 20 AND delay = 0").groupBy("capital").agg(F.avg("return_pct").alias("average_return_per_market_day_pct"), F.min("worst_drawdown_pct").alias("maximum_drawdown_pct"))
        top = bo.top_share(c.where("cost_bps = 20 AND delay = 0 AND capital = 10000").withColumn("net", F.col("net_return_pct")), ["capital"], (10,))
        gate = xo.chronology(runs(t), "c3", REQUIRED).agg((F.count("*") == 0).alias("chronology_pass"), F.lit(10_000.0).alias("capital"))
        return xo.scorecard(base.join(stress, "capital").join(days, "capital").join(top, "capital").join(gate, "capital"))

    at = lambda cost, delay: f"coalesce((SELECT net_expected_value_pct FROM money WHERE capital = 10000 AND cost_bps = {cost} AND delay = {delay}), -1) > 0"
    base = "capital = 10000 AND cost_bps = 20 AND delay = 0"
    top = f"SELECT 100.0 * sum(CASE WHEN r <= greatest(1, ceil(n * 10 / 100.0)) THEN net_return_pct END) / any_value(total) AS x FROM (SELECT net_return_pct, row_number() OVER (ORDER BY net_return_pct DESC) AS r, count(*) OVER () AS n, sum(net_return_pct) OVER () AS total FROM costed_trades WHERE {base})"
    register("h8_scorecard", "capital:d, economic_quality_pass, execution_quality_pass, five_minute_delay_positive, risk_quality_pass, return_concentration_pass, statistical_credibility_pass, chronology_pass, classification", scored_card,
             f"""SELECT *, CASE WHEN NOT economic_quality_pass THEN 'exploratory' WHEN NOT (execution_quality_pass AND risk_quality_pass AND statistical_credibility_pass AND chronology_pass) THEN 'promising' ELSE 'statistically_credible' END AS classification FROM (
             SELECT m.capital, coalesce(net_expected_value_pct, 0) > 0 AND coalesce(profit_factor, 0) > 1 AND coalesce(d.average, 0) > 0 AS economic_quality_pass, {at(30, 0)} AND {at(20, 1)} AND {at(20, 2)} AS execution_quality_pass, {at(20, 5)} AS five_minute_delay_positive, coalesce(d.worst >= -20, false) AS risk_quality_pass,
               coalesce((SELECT x FROM ({top})) <= 150, true) AS return_concentration_pass, independent_event_count >= 30 AND trades >= 100 AS statistical_credibility_pass, (SELECT count(*) = 0 FROM (VALUES ('discovery'), ('validation'), ('robustness')) v(stage) WHERE stage NOT IN ({_PASSED})) AS chronology_pass
             FROM money m JOIN (SELECT capital, avg(return_pct) AS average, min(worst_drawdown_pct) AS worst FROM portfolio_days WHERE {base} GROUP BY capital) d USING (capital) WHERE {base})""")  # fmt: skip


def _decisions() -> None:
    register("h5_verdict", "rule, verdict", lambda t: bo.verdict(summary(t)), f"SELECT 'base' AS rule, CASE WHEN net_avg_pct <= 0 OR coalesce(ct, -99) <= 0 THEN 'REJECT' WHEN NOT (cost30 > 0 AND pf > 1.05 AND ct >= 1 AND relaxed > 0 AND tightened > 0) THEN 'WEAK' ELSE 'PROMISING' END AS verdict FROM ({_BASE})")
    checks = "rule, " + ", ".join(eo.CHECKS) + ", decision, classification"
    top1 = "SELECT avg(CASE WHEN r > greatest(1, ceil(n / 100.0)) THEN net END) FROM (SELECT net, row_number() OVER (ORDER BY net DESC) AS r, count(*) OVER () AS n FROM obs_net)"
    late = f"SELECT avg(f.fwd_return_5m_pct) - 0.2 FROM (SELECT * FROM samples WHERE {RULE_SQL}) s LEFT JOIN feat f ON f.symbol = s.symbol AND f.bar_ts = s.bar_ts + INTERVAL 10 MINUTE"
    tests = {
        "positive_net_expectancy": "net_avg_pct > 0", "positive_event_expectancy": "(SELECT avg(m) FROM (SELECT avg(net) AS m FROM obs_net GROUP BY bar_ts)) > 0", "profit_factor_above_one": "pf > 1", "positive_after_30bps": "cost30 > 0", "positive_after_2m_delay": f"({late}) > 0",
        "positive_relaxed_neighbour": "relaxed > 0", "positive_tightened_neighbour": "tightened > 0", "not_dependent_on_top_1pct": f"({top1}) > 0", "minimum_observations": "(SELECT count(*) FROM obs_net) >= 250", "minimum_dates": "(SELECT count(*) FROM obs_day) >= 10",
    }
    core = "positive_net_expectancy AND positive_event_expectancy AND profit_factor_above_one AND positive_after_30bps AND not_dependent_on_top_1pct"
    robust = "positive_after_2m_delay AND positive_relaxed_neighbour AND positive_tightened_neighbour"
    register("h6_promotion", checks, lambda t: eo.promotion(summary(t)), f"""SELECT 'base' AS rule, *, CASE WHEN NOT ({core}) THEN 'reject' WHEN NOT ({robust}) THEN 'retain_for_research' ELSE 'promote_for_further_validation' END AS decision,
      CASE WHEN NOT ({core}) OR NOT ({robust}) THEN 'exploratory' WHEN minimum_observations AND minimum_dates AND coalesce(ct > 0, false) THEN 'statistically_credible' ELSE 'promising' END AS classification FROM (SELECT ct, {', '.join(f'coalesce({e}, false) AS {n}' for n, e in tests.items())} FROM ({_BASE}))""")  # fmt: skip

    def capped(t):
        s = scored(t).withColumns({"classification": F.when(F.col("t_stat") > 2, "statistically_credible").otherwise("promising"), "adjusted_p": F.lit(0.2) - F.col("t_stat") / 20, "portfolio_available": F.col("observations") % 2 == 0, "regimes_available": F.col("observations") % 3 == 0, "negative_regimes": F.col("wins") % 2})
        return eo.evidence_caps(s).withColumn("blockers", F.size("deployment_blockers"))

    sql = "SELECT *, CASE WHEN t_stat > 2 AND coalesce(0.2 - t_stat / 20 <= 0.05, false) THEN 'statistically_credible' ELSE 'promising' END AS classification, CASE WHEN observations % 3 <> 0 THEN 'not_measured' WHEN wins % 2 > 0 THEN 'mixed' ELSE 'no_negative_supported_regime_detected' END AS regime_stability, 6 + CASE WHEN observations % 3 <> 0 THEN 1 ELSE 0 END AS blockers FROM screened"
    register("h7_evidence_caps", "family, direction, horizon:l, group_key, classification, regime_stability, blockers:l", capped, sql)

    register("h9_chronology", "stage", lambda t: xo.chronology(runs(t), "c3", ("discovery", "validation", "robustness", "holdout")), "SELECT stage FROM (VALUES ('discovery'), ('validation'), ('robustness'), ('holdout')) v(stage) WHERE stage NOT IN (" + _PASSED + ")")
    latest = lambda t: scans.latest_per_key(t["orders"].where("o_orderstatus = 'F'"), ("o_custkey",), F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc())
    latest_sql = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1"
    register("e25_latest_per_key", "o_custkey:l, o_orderkey:l", latest, latest_sql)
    register("c14_latest_run", "c_custkey:l, o_orderkey:l, o_totalprice:d", lambda t: t["customer"].select("c_custkey").join(latest(t), F.col("c_custkey") == F.col("o_custkey"), "left"), f"SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer LEFT JOIN ({latest_sql}) o ON c_custkey = o.o_custkey")
    board = lambda t: t["customer"].select("c_custkey", "c_acctbal").join(latest(t).select("o_custkey", F.col("o_orderkey").alias("robustness_run")), F.col("c_custkey") == F.col("o_custkey"), "left").join(t["orders"].where("o_orderpriority LIKE '1%'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("frozen_order")).withColumnRenamed("o_custkey", "k"), F.col("c_custkey") == F.col("k"), "left")
    register("c20_leaderboard", "c_custkey:l, robustness_run:l, frozen_order:l", board, f"SELECT c_custkey, o.o_orderkey AS robustness_run, f.frozen_order FROM customer LEFT JOIN ({latest_sql}) o ON c_custkey = o.o_custkey LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS frozen_order FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) f ON c_custkey = f.o_custkey")
    order = lambda: (F.col("t_stat").desc_nulls_last(), "family", "direction", "group_key")
    top = lambda n: f"SELECT * FROM screened WHERE direction = 'long' ORDER BY t_stat DESC NULLS LAST, family, direction, group_key LIMIT {n}"
    register("f2_top_rules", "family, group_key, t_stat:d", lambda t: screened(t).where("direction = 'long'").withColumn("t_stat", F.round("t_stat", 9)).orderBy(*order()).limit(50), top(50).replace("FROM screened", "FROM (SELECT * EXCLUDE t_stat, round(t_stat, 9) AS t_stat FROM screened)"))
    register("f3_top_summary", "family, n:l", lambda t: screened(t).where("direction = 'long'").withColumn("t_stat", F.round("t_stat", 9)).orderBy(*order()).limit(20).groupBy("family").agg(F.count("*").alias("n")), f"SELECT family, count(*) AS n FROM ({top(20).replace('FROM screened', 'FROM (SELECT * EXCLUDE t_stat, round(t_stat, 9) AS t_stat FROM screened)')}) GROUP BY 1")


def _integrity() -> None:
    print_sql = """SELECT *, sha256('{"c_mktsegment":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS fingerprint FROM customer"""
    marked = lambda t: t["customer"].withColumn("c_mktsegment", F.col("c_name")).withColumn("fingerprint", io.fingerprint(["c_nationkey", "c_mktsegment"]))
    register("i1_fingerprint", "c_custkey:l, fingerprint", marked, print_sql)
    rules = lambda t: t["customer"].select(F.col("c_custkey").alias("rule_id"), F.sha2(F.col("c_name"), 256).alias("fingerprint"), (F.col("c_custkey") % 2 == 0).alias("frozen"))
    ledger = lambda t: t["customer"].where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("rule_id"), F.when(F.col("c_custkey") % 7 == 0, "changed").otherwise(F.sha2(F.col("c_name"), 256)).alias("fingerprint"), (F.col("c_custkey") % 3 == 0).alias("frozen"))
    register("i2_changed_after_freeze", "rule_id:l, frozen_fingerprint", lambda t: io.changed_after_freeze(rules(t), ledger(t)), "SELECT c_custkey AS rule_id, 'changed' AS frozen_fingerprint FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 = 0 AND c_custkey % 3 = 0")
    runs = lambda t: t["orders"].select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("rule_id"), F.when(F.col("o_orderkey") % 4 == 0, "holdout").otherwise("research").alias("purpose"), F.to_date("o_orderdate").alias("start_date"), F.date_add(F.to_date("o_orderdate"), 20).alias("end_date"))
    violations = """WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS rule_id, o_orderkey % 4 = 0 AS holdout, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 20 AS e FROM orders)
SELECT run_id, 'research touches the holdout' AS violation FROM r WHERE NOT holdout AND e >= DATE '1997-01-01' UNION ALL SELECT run_id, 'holdout begins early' FROM r WHERE holdout AND s < DATE '1997-01-01'
UNION ALL SELECT run_id, 'holdout without a freeze' FROM r WHERE holdout AND NOT (rule_id % 5 <> 0 AND rule_id % 3 = 0 AND rule_id IN (SELECT c_custkey FROM customer))"""
    register("i3_period_violations", "run_id:l, violation", lambda t: io.period_violations(runs(t), "1997-01-01", ledger(t)), violations)
    shots = lambda t: runs(t).select("run_id", F.col("start_date").alias("snapshot_date"), F.date_sub("start_date", (F.col("run_id") % 3).cast("int")).alias("lookback_end"), F.date_add("start_date", (F.col("run_id") % 7 - 1).cast("int")).alias("effective_start"))
    register("i4_lookahead_violations", "run_id:l", lambda t: io.lookahead_violations(shots(t)), "SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 7 = 0")

    def pairs(t):
        side = lambda n: F.struct(F.lit("u").alias("universe"), F.lit("1Min").alias("timeframe"), F.when(F.col("o_orderkey") % n == 0, "iex").otherwise("sip").alias("feed"), F.lit("raw").alias("adjustment"), F.lit("regular").alias("session"), F.array(F.lit("A")).alias("tiers"), (F.col("o_custkey") % 2 + n).alias("baseline_days"), F.lit(None).cast("string").alias("predictors"), F.array(F.lit(5), F.lit(15)).alias("outcomes"))
        return t["orders"].select("o_orderkey", side(2).alias("source"), side(3).alias("target"), F.when(F.col("o_orderkey") % 5 == 0, 60).otherwise(5).alias("horizon"))

    bad = "concat_ws(',', CASE WHEN (o_orderkey % 2 = 0) <> (o_orderkey % 3 = 0) THEN 'feed' END, 'baseline_days', CASE WHEN o_orderkey % 5 = 0 THEN 'horizon' END)"
    register("i5_compatibility", "o_orderkey:l, mismatches", lambda t: io.compatibility(pairs(t)).withColumn("mismatches", F.array_join("mismatches", ",")), f"SELECT o_orderkey, {bad} AS mismatches FROM orders")
    configs = lambda t: t["events"].withColumn("config", F.from_json("props", "map<string,string>"))
    register("i6_missing_fields", "event_id:l, missing", lambda t: io.missing_fields(configs(t), ["k", "seed", "method"]).withColumn("missing", F.array_join("missing", ",")), "SELECT event_id, CASE WHEN json_exists(props, '$.k') THEN 'seed,method' ELSE 'k,seed,method' END AS missing FROM events")
    register("i7_sync_ledger", "rule_id:l, fingerprint, frozen", lambda t: io.sync_ledger(ledger(t), rules(t)), "SELECT c_custkey AS rule_id, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 = 0 AND c_custkey % 7 = 0 THEN 'changed' ELSE sha256(c_name) END AS fingerprint, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 = 0 THEN true ELSE c_custkey % 2 = 0 END AS frozen FROM customer")

    def refreshed(t):
        path, state = scratch(t.spark, "features"), scratch(t.spark, "state")
        early = t.bars.where("trade_date < DATE '2024-01-15'")
        stream.refresh(early, early, path, state, proxies.FEATURES)
        old = t.bars.where("trade_date < DATE '2024-01-20' OR symbol <> 'click_0'")
        stream.refresh(old, old.where("trade_date >= DATE '2024-01-15'"), path, state, proxies.FEATURES)
        stream.refresh(t.bars, t.bars.where("trade_date >= DATE '2024-01-20' AND symbol = 'click_0'"), path, state, proxies.FEATURES)
        return t.spark.read.parquet(path)

    register("j1_incremental_refresh", "symbol, bar_ts, session_label, ret_5m_pct:d, same_minute_avg_volume_prior_days:d, previous_regular_close:d", refreshed, "SELECT * FROM feat")
