"""Queries of rule families, group statistics, scores and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import discovery as do
from tidemark.operators import rules as ro
from tidemark.operators import states as so
from tidemark.plans.registry import register
from tidemark.sources.sinks import scratch_table

G = "family, direction, horizon:l, group_key"
KEY = "symbol, bar_ts, session_label"
RULE = [
    {"column": "ret_5m_pct", "operator": "abs_gte", "value": 0.5},
    {"column": "relative_volume_20bar", "operator": "range", "low": 0.5, "high": 2.0, "high_inclusive": True},
    {"column": "minute_of_day", "operator": "gte", "value": 600},
    {"column": "cumulative_range_position", "operator": "not_null"},
]
RULE_SQL = "abs(ret_5m_pct) >= 0.5 AND relative_volume_20bar >= 0.5 AND relative_volume_20bar <= 2.0 AND minute_of_day >= 600 AND cumulative_range_position IS NOT NULL"
T, A = f"(1 / (1 + {do.ERF_P} * x))", do.ERF_A
ERFC_SQL = f"{T} * ({A[0]} + {T} * ({A[1]} + {T} * ({A[2]} + {T} * ({A[3]} + {T} * {A[4]})))) * exp(-x * x)"


def outcomes(t, horizons=(5,)):
    return do.group_outcomes(so.bin_state(t.samples), horizons=horizons)


def screened(t):
    return do.screen_states(so.bin_state(t.samples))


def scored(t, score=do.rank_score):
    return score(screened(t), validated=False)


_CONC = "greatest(0.05, 1 - max_symbol_share_pct / 100) * greatest(0.05, 1 - max_date_share_pct / 100)"
_LEGACY = f"net_avg_pct * ln(1 + observations) * greatest(0.25, greatest(coalesce(t_stat, 0), 0)) * {_CONC}"
_PF = "CASE WHEN coalesce(profit_factor, 1) = 0 THEN 1 ELSE coalesce(profit_factor, 1) END"
_FALL = lambda c, w: f"(1 / (1 + {w} * greatest(0, -{c}) / greatest(net_avg_pct, 0.05)))"
_TANH = lambda x: f"((exp(2 * ({x})) - 1) / (exp(2 * ({x})) + 1))"
_SCORE = (
    f"CASE WHEN net_avg_pct <= 0 THEN 0 ELSE net_avg_pct * ln(1 + observations) * sqrt(least(4.0, greatest(0.25, {_PF}))) * (1 + 0.2 * {_TANH('greatest(-20, least(20, median_pct / greatest(net_avg_pct, 0.1)))')}) "
    f"* {_FALL('p05_pct', 0.08)} * {_FALL('worst_pct', 0.015)} * (0.8 + 0.2 * {_TANH('least(20, greatest(coalesce(t_stat, 0), 0) / 2)')}) * {_CONC} END"
)
_GATED = "observations >= 10 AND symbols >= 2 AND dates >= 3 AND max_symbol_share_pct <= 80 AND max_date_share_pct <= 50 AND net_avg_pct > 0"
_SCORED = f"SELECT *, {_SCORE} AS score, (SELECT count(*) FROM screened) AS tests FROM screened"
_GATE = {"observations": 10, "symbols": 2, "dates": 3, "symbol_share": 80.0, "date_share": 50.0}


def load() -> None:
    register("b3_symbol_bucket", "symbol, bucket:l", lambda t: t.bars.select("symbol", do.symbol_bucket(F.col("symbol")).alias("bucket")).distinct(), "SELECT DISTINCT symbol, CAST(('0x' || substr(md5(symbol), 1, 8)) AS BIGINT) % 1024 AS bucket FROM bars")
    register("b4_entry_grid", KEY, lambda t: t.bars.where(do.on_entry_grid(F.col("minute_of_day"), 15)), "SELECT * FROM bars WHERE (minute_of_day - 570) % 15 = 0")
    register("b5_has_outcome", KEY, lambda t: t.features.where(do.has_outcome((15, 30))), "SELECT * FROM feat WHERE fwd_return_15m_pct IS NOT NULL OR fwd_return_30m_pct IS NOT NULL")
    families = lambda t: so.bin_state(t.samples).withColumn("family", F.explode(F.array_compact(F.array(*[F.when(ro.family_filter(f), F.lit(f)) for f in ro.ALL_FAMILIES])))).groupBy("family").agg(F.count("*").alias("n"))
    register("b16_family_filters", "family, n:l", families, " UNION ALL ".join(f"SELECT '{f}' AS family, count(*) AS n FROM samples WHERE {c} HAVING count(*) > 0" for f, (_, c) in ro.ALL_FAMILIES.items()))
    register("b17_rule_filter", KEY, lambda t: t.samples.where(ro.rule_filter(RULE)), f"SELECT * FROM samples WHERE {RULE_SQL}")
    register("b18_signed_outcome", f"{G}, symbol, bar_ts, gross:d, net:d", outcomes, "SELECT * FROM outcomes")
    register("b19_hist_bin", f"{G}, bin:l, n:l", lambda t: do.group_hist(outcomes(t)), "SELECT * FROM group_hist")
    values = lambda t: so.bin_state(t.samples).where("time_bin IS NOT NULL AND ret5_bin IS NOT NULL").select("symbol", "bar_ts", "session_label", ro.group_key(("time_bin", "ret5_bin")).alias("group_key"), ro.group_values(("time_bin", "ret5_bin")).alias("group_values"))
    register("b20_group_key", f"{KEY}, group_key, group_values", values, """SELECT *, time_bin || '|' || ret5_bin AS group_key, '{"time_bin":' || time_bin || ',"ret5_bin":' || ret5_bin || '}' AS group_values FROM binned WHERE time_bin IS NOT NULL AND ret5_bin IS NOT NULL""")
    text = lambda t: screened(t).where("family = 'volume_shock'").withColumn("rule", ro.rule_text(F.col("direction"), F.col("group_key"), F.col("horizon"), F.col("family")))
    text_sql = "CASE direction WHEN 'long' THEN 'Buy' ELSE 'Short' END || ' when time is in bin ' || split_part(group_key, '|', 1) || ', rvol is in bin ' || split_part(group_key, '|', 2) || ' and ret5 is in bin ' || split_part(group_key, '|', 3) || '; exit after ' || horizon || ' minutes.'"
    register("b21_rule_text", f"{G}, rule", text, f"SELECT *, {text_sql} AS rule FROM screened WHERE family = 'volume_shock'")
    sums = "observations:l, gross_sum:d, net_sum:d, net_sum_squares:d, wins:l, positive_sum:d, negative_sum_abs:d, worst_pct:d, best_pct:d"
    register("d8_group_stats", f"{G}, {sums}", lambda t: do.group_stats(outcomes(t)), "SELECT * FROM group_sums")
    register("d9_group_histogram", f"{G}, bin:l, n:l", lambda t: do.group_hist(outcomes(t)), "SELECT * FROM group_hist")
    register("d10_group_concentration", f"{G}, symbols:l, dates:l, max_symbol_share_pct:d, max_date_share_pct:d", lambda t: do.group_concentration(outcomes(t)), "SELECT * FROM group_shares")
    parts = lambda t: do.group_stats(outcomes(t), ("trade_date", *do.GROUP))
    register("d11_merged_stats", f"{G}, {sums}", lambda t: do.merge_stats(parts(t)), "SELECT * FROM group_sums")
    register("d12_final_stats", f"{G}, gross_avg_pct:d, net_avg_pct:d, win_rate_pct:d, stdev_pct:d, t_stat:d, profit_factor:d", lambda t: do.finalise_stats(do.group_stats(outcomes(t))), "SELECT * FROM group_final")
    register("d13_histogram_quantiles", f"{G}, p05_pct:d, p25_pct:d, median_pct:d, p75_pct:d, p95_pct:d", lambda t: do.hist_quantiles(do.group_hist(outcomes(t)), do.QUANTILES), "SELECT * FROM group_quantiles")
    hold = lambda t: do.holdout_stats(t.samples, ro.rule_filter(RULE), "short", 5, "2024-01-10", "2024-01-25", 5.0)
    hold_rows = f"SELECT symbol, trade_date, -fwd_return_5m_pct AS gross, -fwd_return_5m_pct - 0.05 AS net FROM samples WHERE {RULE_SQL} AND trade_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-25' AND (minute_of_day - 570) % 5 = 0 AND fwd_return_5m_pct IS NOT NULL"
    hold_sql = f"WITH h AS ({hold_rows}) SELECT count(*) AS observations, avg(gross) AS gross_avg_pct, avg(net) AS net_avg_pct, count(DISTINCT symbol) AS symbols, count(DISTINCT trade_date) AS dates, avg(net) / stddev_samp(net) * sqrt(count(*)) AS t_stat, min(net) AS worst_pct FROM h"
    register("d14_holdout_stats", "observations:l, gross_avg_pct:d, net_avg_pct:d, symbols:l, dates:l, t_stat:d, worst_pct:d", hold, hold_sql)

    def validated(t):
        rows = outcomes(t)
        found = do.group_stats(rows)
        later = do.hist_quantiles(do.group_hist(rows.where("trade_date >= DATE '2024-01-16'")), {"median_pct": 0.5}).join(do.finalise_stats(do.group_stats(rows.where("trade_date >= DATE '2024-01-16'"))), list(do.GROUP))
        return do.join_validation(found, later)

    register("c19_join_validation", f"{G}, observations:l, v_observations:l, v_net_avg_pct:d, v_profit_factor:d", validated, "SELECT s.*, coalesce(v.v_observations, 0) AS v_observations, coalesce(v.v_net_avg_pct, 0) AS v_net_avg_pct, v.v_profit_factor FROM group_sums s LEFT JOIN screened_early v USING (family, direction, horizon, group_key)")
    register("c18_group_screen", f"{G}, observations:l, net_avg_pct:d, symbols:l, dates:l, median_pct:d", screened, "SELECT * FROM screened")
    register("h1_legacy_score", f"{G}, legacy_score:d", lambda t: scored(t, do.rank_score_legacy), f"SELECT *, {_LEGACY} AS legacy_score FROM screened")
    register("h2_economic_score", f"{G}, score:d", scored, _SCORED)

    def tested(t):
        s = do.with_tests(scratch_table(scored(t), "scores"))
        return do.discovery_status(do.adjusted_p(s, F.col("tests")), validated=False)

    p_sql = f"SELECT *, CASE WHEN t_stat IS NULL THEN 1 ELSE least(1, tests * {ERFC_SQL}) END AS adjusted_p FROM (SELECT *, abs(t_stat) / sqrt(2) AS x FROM ({_SCORED}))"
    register("h3_adjusted_p", f"{G}, adjusted_p:d", tested, p_sql)
    register("h4_discovery_status", f"{G}, status", tested, f"SELECT *, CASE WHEN adjusted_p <= 0.10 THEN 'PROMISING' ELSE 'WEAK' END AS status FROM ({p_sql})")
    best = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, direction, horizon, group_key) AS rank FROM ({}) WHERE {}) WHERE rank <= 3"
    register("f1_select_rules", f"{G}, score:d, rank:l", lambda t: do.select_rules(scored(t), 3, **_GATE), best.format(_SCORED, _GATED))
    grids = " UNION ALL ".join(f"SELECT '{f}' AS family, {' * '.join(str(ro.bins_of(d)) for d in dims)} AS grid" for f, (dims, _) in ro.ALL_FAMILIES.items())
    seen = lambda t: ro.defined_variants(t.spark).join(do.group_stats(outcomes(t)).groupBy("family").agg(F.count("*").alias("observed")), "family", "left")
    register("b28_defined_variants", "family, grid:l, variants:l, observed:l", seen, f"SELECT family, grid, grid * 8 AS variants, o.observed FROM ({grids}) LEFT JOIN (SELECT family, count(*) AS observed FROM group_sums GROUP BY family) o USING (family)")
