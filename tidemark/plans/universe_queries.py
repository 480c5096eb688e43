"""Queries of scans, sinks, quality reports, universes, intervals and market states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import market as mo
from tidemark.operators import quality as qo
from tidemark.operators import rules as ro
from tidemark.operators import states as so
from tidemark.operators import universe as uo
from tidemark.plans.discovery_queries import RULE, RULE_SQL, outcomes, screened
from tidemark.plans.registry import register
from tidemark.sources import proxies, scans, sinks
from tidemark.sources.sinks import scratch

CONFIG = uo.UniverseConfig(tiers=(("A", 1, 65_000), ("B", 1, 53_000), ("C", 1, 41_000)), minimum_days=25, minimum_bars=1.0, minimum_dollar_volume=30_000, minimum_price=900, include=r"^[0-9]+$", exclude="7$", fund_names="(1|x3)$", maximum_symbols=400)
#: Orders in parts of neighbouring keys.
ORDER_PART = lambda: sinks.key_range("o_orderkey", 20_000)
DAYS = "SELECT trade_date FROM bars WHERE symbol = 'click_0' GROUP BY trade_date"
_STATS = "trading_days:l, average_bars_per_day:d, median_daily_dollar_volume:d, average_daily_dollar_volume:d, median_close:d"


def daily(t):
    return uo.daily_liquidity(t.daily_source, ("l_orderkey", "l_linenumber"))


def universe(t):
    return uo.build_universe(daily(t), t.assets, CONFIG)


def sessions(t):
    return t.bars.where("symbol = 'click_0'").select("trade_date").distinct()


def snapshots(t):
    return uo.plan_snapshots(sessions(t), 5, 20)


def ranges(t):
    return t["orders"].select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("range_start"), F.date_add(F.to_date("o_orderdate"), 30).alias("range_end"))


def waves(t):
    return mo.rule_waves(t.samples, ro.rule_filter(RULE), "relative_volume_20bar")


def log(t):
    """A load log from orders: each order stands for a load of a month."""
    o = t["orders"]
    config = F.to_json(
        F.struct(
            F.to_date("o_orderdate").cast("string").alias("start_date"), F.date_add(F.to_date("o_orderdate"), 30).cast("string").alias("end_date"),
            F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("1Day"))).otherwise(F.array(F.lit("1Min"), F.lit("1Day"))).alias("timeframes"), F.lit("sip").alias("feed"),
            F.when(F.col("o_orderkey") % 2 == 0, "raw").otherwise("all").alias("adjustment"), F.struct(F.when(F.col("o_custkey") % 4 == 0, "symbols").otherwise("full").alias("mode")).alias("universe"),
        )
    )
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), config.alias("config"))


_D1 = "SELECT symbol, trade_date, count(*) AS bar_count, sum(close * volume) AS daily_dollar_volume, arg_max(close, row(bar_ts, l_orderkey, l_linenumber)) AS day_close FROM daily_source GROUP BY ALL"
_D3 = f"SELECT symbol, count(*) AS trading_days, avg(bar_count) AS average_bars_per_day, quantile_cont(daily_dollar_volume, 0.5) AS median_daily_dollar_volume, avg(daily_dollar_volume) AS average_daily_dollar_volume, quantile_cont(day_close, 0.5) AS median_close FROM ({_D1}) GROUP BY symbol"
_TIER = "CASE WHEN average_bars_per_day >= 1 AND median_daily_dollar_volume >= 65000 THEN 'A' WHEN average_bars_per_day >= 1 AND median_daily_dollar_volume >= 53000 THEN 'B' WHEN average_bars_per_day >= 1 AND median_daily_dollar_volume >= 41000 THEN 'C' ELSE 'D' END"
_WHY = (
    "CASE WHEN trading_days < 25 THEN 'insufficient trading days' WHEN average_bars_per_day < 1 THEN 'insufficient bars per day' WHEN median_daily_dollar_volume < 30000 THEN 'insufficient dollar volume' WHEN median_close < 900 THEN 'price below minimum' "
    "WHEN NOT regexp_matches(symbol, '^[0-9]+$') THEN 'does not match include regex' WHEN regexp_matches(symbol, '7$') THEN 'matches exclude regex' WHEN regexp_matches(coalesce(asset_name, ''), '(1|x3)$') THEN 'likely fund or exchange-traded product' END"
)
_C2 = f"SELECT s.*, a.exchange, a.name AS asset_name FROM ({_D3}) s LEFT JOIN assets a USING (symbol)"
_TIERED = f"SELECT *, {_TIER} AS liquidity_tier, {_WHY} AS why FROM ({_C2})"
_RANKED = f"SELECT *, CASE WHEN why IS NULL THEN row_number() OVER (PARTITION BY why IS NULL ORDER BY median_daily_dollar_volume DESC NULLS LAST, symbol) END AS eligible_rank FROM ({_TIERED})"
_UNI = f"SELECT *, coalesce(why IS NULL AND eligible_rank <= 400, false) AS included, CASE WHEN why IS NULL AND eligible_rank > 400 THEN 'outside maximum-symbol limit' ELSE why END AS exclusion_reason FROM ({_RANKED})"
_AVAIL = f"SELECT u.*, t.symbol IS NOT NULL AS available FROM ({_UNI}) u LEFT JOIN (SELECT DISTINCT symbol FROM daily_source WHERE trade_date = DATE '2024-01-15') t USING (symbol)"
_PLAN = f"""
WITH d AS ({DAYS}), r AS (SELECT *, count(*) OVER (ORDER BY trade_date RANGE BETWEEN INTERVAL 20 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS n FROM d),
  f AS (SELECT date_trunc('month', trade_date) AS month, min(trade_date) AS snapshot_date FROM r WHERE n >= 5 GROUP BY 1)
SELECT snapshot_date, snapshot_date - 20 AS lookback_start, snapshot_date - 1 AS lookback_end, snapshot_date AS effective_start, coalesce(lead(snapshot_date) OVER (ORDER BY snapshot_date) - 1, (SELECT max(trade_date) FROM d)) AS effective_end FROM f"""
_RANGES = "SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS range_start, CAST(o_orderdate AS DATE) + 30 AS range_end FROM orders"


def load() -> None:
    sel = scans.SourceSelection("5Min", "sip", "raw", "regular", "2024-01-05", "2024-01-20")
    register("a1_scan_bars", "symbol, bar_ts, session_label, close:d, volume:l", lambda t: scans.select_bars(t.bars, sel), "SELECT * FROM bars WHERE session_label = 'regular' AND trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
    sector = "coalesce(json_extract_string(attributes, '$.sector'), json_extract_string(raw, '$.sector')) AS sector"
    short = "coalesce(json_extract_string(attributes, '$.shortable'), json_extract_string(raw, '$.shortable'))"
    register("a2_scan_assets", "symbol, exchange, sector, shortable_known, shortable", lambda t: scans.with_attributes(t.assets), f"SELECT *, {sector}, {short} IS NOT NULL AS shortable_known, TRY_CAST({short} AS BOOLEAN) AS shortable FROM assets")
    register("a3_scan_load_log", "id:l, range_start, range_end", lambda t: scans.load_log_ranges(log(t), "full", "sip", "raw"), "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS range_start, CAST(o_orderdate AS DATE) + 30 AS range_end FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AND o_custkey % 4 <> 0")
    register("a4_source_inventory", "timeframe, feed, adjustment, bars:l, symbols:l, first_ts, last_ts", lambda t: scans.source_inventory(t.bars), "SELECT timeframe, feed, adjustment, count(*) AS bars, count(DISTINCT symbol) AS symbols, min(bar_ts) AS first_ts, max(bar_ts) AS last_ts FROM bars GROUP BY ALL")
    register("a5_estimate_features", "symbols:l, bars:l, estimated_bytes:l", lambda t: scans.estimate_features(t.daily_source, universe(t)), f"SELECT count(DISTINCT symbol) AS symbols, count(*) AS bars, count(*) * 420 AS estimated_bytes FROM daily_source WHERE symbol IN (SELECT symbol FROM ({_UNI}) WHERE included)")
    register("a12_feature_summary", "rows:l, symbols:l, first_date, last_date", lambda t: scans.feature_summary(t.features), "SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars")

    def sliced(t):
        path = scratch(t.spark, "slices")
        sinks.write_slice(t.bars.select("symbol", "bar_ts", "close", "trade_date"), path, ["trade_date"])
        sinks.write_slice(t.bars.where("day(trade_date) % 2 = 0").selectExpr("symbol", "bar_ts", "close + 1 AS close", "trade_date"), path, ["trade_date"])
        return t.spark.read.parquet(path)

    register("a6_write_slice", "symbol, bar_ts, close:d", sliced, "SELECT symbol, bar_ts, CASE WHEN day(trade_date) % 2 = 0 THEN close + 1 ELSE close END AS close FROM bars")

    def added(t):
        path = scratch(t.spark, "new-rows")
        sinks.write_new(t["orders"].where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("old").alias("batch")), path, ["o_orderkey"], ORDER_PART())
        sinks.write_new(t["orders"].where("o_orderkey % 2 = 1 OR o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("batch")), path, ["o_orderkey"], ORDER_PART())
        return t.spark.read.parquet(path)

    register("a7_write_new", "o_orderkey:l, batch", added, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS batch FROM orders")
    updates = lambda t: t["orders"].where("o_orderkey % 2 = 1 OR o_orderkey % 3 = 0").selectExpr("o_orderkey", "o_orderstatus", "o_totalprice * 2 AS o_totalprice")

    def upserted(t):
        path = scratch(t.spark, "upserts")
        sinks.write_new(t["orders"].where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, ["o_orderkey"], ORDER_PART())
        sinks.upsert_into(updates(t), path, ["o_orderkey"], ORDER_PART(), F.col("o_orderstatus") == "F")
        return t.spark.read.parquet(path)

    register("a8_upsert", "o_orderkey:l, o_orderstatus, o_totalprice:d", upserted,
             "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 AND (o_orderkey % 3 <> 0 OR o_orderstatus = 'F') THEN o_totalprice ELSE o_totalprice * 2 END AS o_totalprice FROM orders")

    def monthly(t):
        path = scratch(t.spark, "months")
        sinks.write_monthly(t["orders"].select("o_orderkey", F.to_date("o_orderdate").alias("trade_date")), path)
        return t.spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"))

    register("a9_write_monthly", "month, n:l", monthly, "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")

    def exported(t):
        found = sinks.scratch_table(screened(t).where("observations >= 10"), "candidates")  # ordering and both exports read it again
        rows = sinks.leaderboard_rows(found.withColumn("dims", F.split("group_key", r"\|")), [], [F.col("net_avg_pct").desc_nulls_last()])
        folder = scratch(t.spark, "export")
        sinks.export_candidates(rows, folder)
        return sinks.manifest(t.spark.read.json(f"{folder}/json"))

    register("a10_export_candidates", "rules:l, families:l, directions:l", exported, "SELECT count(*) AS rules, count(DISTINCT family) AS families, count(DISTINCT direction) AS directions FROM screened WHERE observations >= 10")
    register("a11_export_mix", "key, value, n:l", lambda t: sinks.export_mix(screened(t), ("family", "direction", "horizon")), " UNION ALL ".join(f"SELECT '{k}' AS key, CAST({k} AS VARCHAR) AS value, count(*) AS n FROM screened GROUP BY {k}" for k in ("family", "direction", "horizon")))
    register("b1_market_calendar", "event_id:l, trade_date, minute_of_day:l, weekday_iso:l", lambda t: cal.with_market_calendar(t["events"], ts="ts"), "SELECT event_id, CAST(l AS DATE) AS trade_date, hour(l) * 60 + minute(l) AS minute_of_day, isodow(l) AS weekday_iso FROM (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS l FROM events)")

    def bounded(t):
        a, b = cal.market_date_bounds("2024-01-10", "2024-01-12")
        return t["events"].where((F.col("ts") >= a) & (F.col("ts") < b))

    register("b2_market_date_bounds", "event_id:l", bounded, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-13 05:00:00'")
    tier = lambda t: uo.join_assets(uo.symbol_stats(daily(t)), t.assets).withColumns({"liquidity_tier": uo.liquidity_tier(CONFIG), "why": uo.exclusion_reason(CONFIG)})
    register("b7_liquidity_tier", "symbol, liquidity_tier", tier, _TIERED)
    register("b8_exclusion_reason", "symbol, why", tier, _TIERED)
    register("b9_safe_percent_change", "symbol, bar_ts, session_label, change:d, share:d", lambda t: t.features.withColumns({"change": so.F.try_divide("high", "low") * 100 - 100, "share": F.try_divide("ret_5m_pct", "rolling_range_30bar_pct")}), "SELECT *, (high / nullif(low, 0) - 1) * 100 AS change, ret_5m_pct / nullif(rolling_range_30bar_pct, 0) AS share FROM feat")
    register("b22_finite_guard", "o_orderkey:l, v:d", lambda t: t["orders"].withColumn("v", cal.finite(F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice")))), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN o_totalprice END AS v FROM orders")
    register("b24_weekday_calendar", "trade_date, bars:l", lambda t: cal.weekday_calendar(t.spark, "2024-01-01", "2024-01-31").join(t.bars.groupBy("trade_date").agg(F.count("*").alias("bars")), "trade_date", "left"), "SELECT d.trade_date, b.bars FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS trade_date) d LEFT JOIN (SELECT trade_date, count(*) AS bars FROM bars GROUP BY 1) b USING (trade_date) WHERE isodow(d.trade_date) <= 5")
    register("b25_month_ranges", "key:l, range_start, part_start, part_end", lambda t: cal.month_ranges(ranges(t)), f"SELECT key, range_start, greatest(range_start, m) AS part_start, least(range_end, last_day(m)) AS part_end FROM (SELECT *, CAST(unnest(generate_series(date_trunc('month', range_start), date_trunc('month', range_end), INTERVAL 1 MONTH)) AS DATE) AS m FROM ({_RANGES}))")
    register("b26_period_labels", "o_orderkey:l, week, month", lambda t: t["orders"].withColumns({"week": cal.week_label(F.to_date("o_orderdate")), "month": cal.month_label(F.to_date("o_orderdate"))}), "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
    register("c1_join_universe", "symbol, trade_date, close:d, liquidity_tier, l_orderkey:l, l_linenumber:l", lambda t: uo.join_universe(t.daily_source, universe(t)), f"SELECT d.*, u.liquidity_tier FROM daily_source d JOIN ({_UNI}) u USING (symbol) WHERE u.included AND u.liquidity_tier IN ('A', 'B', 'C')")
    register("c2_join_assets", f"symbol, exchange, asset_name, {_STATS}", lambda t: uo.join_assets(uo.symbol_stats(daily(t)), t.assets), _C2)
    register("d1_daily_liquidity", "symbol, trade_date, bar_count:l, daily_dollar_volume:d, day_close:d", daily, _D1)
    register("d3_symbol_stats", f"symbol, {_STATS}", lambda t: uo.symbol_stats(daily(t)), _D3)
    register("d4_universe_summary", "symbols:l, included:l, tier_a:l, tier_b:l, tier_c:l, tier_d:l", lambda t: uo.universe_summary(universe(t)), f"SELECT count(*) AS symbols, count_if(included) AS included, {', '.join(f'''count_if(included AND liquidity_tier = '{x}') AS tier_{x.lower()}''' for x in 'ABCD')} FROM ({_UNI})")
    register("e15_rank_universe", "symbol, eligible_rank:l, included, exclusion_reason, liquidity_tier", universe, _UNI)
    register("c15_available_on", "symbol, available", lambda t: uo.available_on(universe(t), t.daily_source, "2024-01-15"), _AVAIL)
    register("e16_refill_universe", "symbol, new_rank:l, included", lambda t: uo.refill_universe(uo.available_on(universe(t), t.daily_source, "2024-01-15"), 300), f"SELECT symbol, CASE WHEN available AND eligible_rank IS NOT NULL THEN r END AS new_rank, coalesce(available AND eligible_rank IS NOT NULL AND r <= 300, false) AS included FROM (SELECT *, row_number() OVER (PARTITION BY available ORDER BY eligible_rank NULLS LAST, symbol) AS r FROM ({_AVAIL}))")
    register("d5_quality_inventory", "session_label, bars:l, symbols:l, first_ts, last_ts", lambda t: qo.quality_inventory(t.bars), "SELECT session_label, count(*) AS bars, count(DISTINCT symbol) AS symbols, min(bar_ts) AS first_ts, max(bar_ts) AS last_ts FROM bars GROUP BY 1")
    register("d6_quality_coverage", "trade_date, bars:l, symbols:l", lambda t: qo.quality_coverage(t.bars), "SELECT trade_date, count(*) AS bars, count(DISTINCT symbol) AS symbols FROM bars GROUP BY 1")
    n = qo.expected_bars("regular", 5)
    spans = "CASE session_label WHEN 'regular' THEN 390 WHEN 'premarket' THEN 330 WHEN 'postmarket' THEN 240 WHEN 'overnight' THEN 480 ELSE 1440 END"
    register("b27_expected_bars", "symbol, trade_date, session_label, bars:l, expected:l, coverage_pct:d", lambda t: qo.session_coverage(t.bars, 5),
             f"SELECT *, greatest(1, {spans} // 5) AS expected, 100.0 * bars / greatest(1, {spans} // 5) AS coverage_pct FROM (SELECT symbol, trade_date, session_label, count(*) AS bars FROM bars GROUP BY ALL)")
    register("d6_quality_bands", "coverage_band, symbol_days:l", lambda t: qo.quality_bands(t.bars, n), f"SELECT CASE WHEN n >= 0.95 * {n} THEN 'complete' WHEN n >= 0.75 * {n} THEN '75-95%' WHEN n >= 0.25 * {n} THEN '25-75%' ELSE 'under 25%' END AS coverage_band, count(*) AS symbol_days FROM (SELECT symbol, trade_date, count(*) AS n FROM bars GROUP BY ALL) GROUP BY 1")
    register("d6_quality_minimum_days", "symbols_below_minimum_days:l, symbols:l", lambda t: qo.quality_min_days(t.daily_source, 28), "SELECT count_if(n < 28) AS symbols_below_minimum_days, count(*) AS symbols FROM (SELECT symbol, count(DISTINCT trade_date) AS n FROM daily_source GROUP BY 1)")
    register("d7_quality_anomalies", "nonpositive_prices:l, invalid_ohlc:l, negative_activity:l, zero_volume_bars:l, checked_bars:l", lambda t: qo.quality_anomalies(t.bars.withColumn("volume", F.col("volume") - 1000).withColumn("high", F.col("high") - 0.02)),
             "SELECT count_if(least(open, high - 0.02, low, close) <= 0) AS nonpositive_prices, count_if(high - 0.02 < low OR high - 0.02 < greatest(open, close) OR low > least(open, close)) AS invalid_ohlc, count_if(volume - 1000 < 0) AS negative_activity, count_if(volume - 1000 = 0) AS zero_volume_bars, count(*) AS checked_bars FROM bars")
    snap = "snapshot_date, lookback_start, lookback_end, effective_start, effective_end"
    register("f4_plan_snapshots", snap, snapshots, _PLAN)

    def pit(t):
        shots = t.daily_source.where("trade_date >= DATE '1970-01-01'").select(F.trunc("trade_date", "year").alias("snapshot_date")).distinct()
        shots = shots.select("snapshot_date", F.date_sub("snapshot_date", 365).alias("lookback_start"), F.date_sub("snapshot_date", 1).alias("lookback_end"))
        return uo.build_pit_universes(daily(t), shots, t.assets, uo.UniverseConfig(tiers=CONFIG.tiers, minimum_days=5, minimum_bars=1.0, minimum_dollar_volume=30_000, minimum_price=900, exclude_funds=False, maximum_symbols=200))

    pit_stats = f"SELECT s.snapshot_date, d.symbol, count(*) AS trading_days, avg(bar_count) AS average_bars_per_day, quantile_cont(daily_dollar_volume, 0.5) AS median_daily_dollar_volume, quantile_cont(day_close, 0.5) AS median_close FROM ({_D1}) d JOIN (SELECT DISTINCT CAST(date_trunc('year', trade_date) AS DATE) AS snapshot_date FROM daily_source) s ON d.trade_date BETWEEN s.snapshot_date - 365 AND s.snapshot_date - 1 GROUP BY ALL"
    pit_why = f"SELECT *, {_TIER} AS liquidity_tier, trading_days >= 5 AND average_bars_per_day >= 1 AND median_daily_dollar_volume >= 30000 AND median_close >= 900 AS fits FROM ({pit_stats})"
    pit_sql = f"SELECT *, CASE WHEN fits THEN r END AS eligible_rank, fits AND r <= 200 AS included FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, fits ORDER BY median_daily_dollar_volume DESC NULLS LAST, symbol) AS r FROM ({pit_why}))"
    register("f5_point_in_time_universes", "snapshot_date, symbol, eligible_rank:l, included, liquidity_tier", pit, pit_sql)
    register("f6_reference_session", "session", lambda t: uo.reference_session(t.bars, "click_0", "2024-01-15"), "SELECT max(trade_date) AS session FROM bars WHERE symbol = 'click_0' AND trade_date < DATE '2024-01-15'")
    members = lambda t: snapshots(t).select("*", F.explode(F.array(*[F.lit(s) for s in proxies.BENCHMARKS])).alias("symbol")).withColumns({"completed": F.lit(True), "median_daily_dollar_volume": F.datediff("snapshot_date", F.lit("2020-01-01")).cast("double")})
    members_sql = f"SELECT b.symbol, b.bar_ts, p.snapshot_date, CASE WHEN p.lookback_end < b.trade_date THEN CAST(p.snapshot_date - DATE '2020-01-01' AS DOUBLE) END AS pit_dollar_volume FROM bars b LEFT JOIN ({_PLAN}) p ON b.symbol IN ('click_0', 'view_0') AND b.trade_date BETWEEN p.effective_start AND p.effective_end"
    joined = lambda t: uo.pit_dollar_volume(uo.join_membership(t.bars, members(t)))
    register("c9_join_membership", "symbol, bar_ts, snapshot_date", joined, members_sql)
    register("c10_no_lookahead_volume", "symbol, bar_ts, pit_dollar_volume:d", joined, members_sql)
    periods = [("early", "1992-01-01", "1994-12-31"), ("middle", "1995-01-01", "2023-12-31"), ("late", "2024-01-01", "2030-12-31")]
    stages = lambda t: t.spark.createDataFrame(periods, "stage string, stage_start string, stage_end string").selectExpr("stage", "to_date(stage_start) AS stage_start", "to_date(stage_end) AS stage_end")
    values = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in periods)
    register("c11_stage_of", "key:l, range_start, stage", lambda t: uo.stage_of(ranges(t), stages(t)), f"SELECT r.*, p.stage FROM ({_RANGES}) r LEFT JOIN (VALUES {values}) p(stage, a, b) ON r.range_start >= p.a AND r.range_end <= p.b")
    window = ("1996-01-01", "1996-06-30")
    cover_sql = f"""WITH r AS ({_RANGES}), s AS (SELECT *, range_start > coalesce(max(range_end) OVER (PARTITION BY key ORDER BY range_start, range_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), DATE '{window[0]}' - 1) + 1 AS gap FROM r WHERE range_end >= DATE '{window[0]}' AND range_start <= DATE '{window[1]}')
SELECT k.key, coalesce(c.covered, false) AS covered FROM (SELECT DISTINCT key FROM r) k LEFT JOIN (SELECT key, NOT bool_or(gap) AND max(range_end) >= DATE '{window[1]}' AS covered FROM s GROUP BY key) c USING (key)"""
    register("d51_covers_range", "key:l, covered", lambda t: uo.covers_range(ranges(t), ("key",), *window), cover_sql)
    kinds = lambda t: ranges(t).withColumn("kind", F.concat(F.lit("load "), (F.col("key") % 3).cast("string")))
    near = ("2024-01-01", "2024-01-20")
    ready_sql = f"""WITH k AS (SELECT 'load ' || (key % 3) AS kind, range_start, range_end FROM ({_RANGES})),
s AS (SELECT *, range_start > coalesce(max(range_end) OVER (PARTITION BY kind ORDER BY range_start, range_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), DATE '{near[0]}' - 1) + 1 AS gap FROM k WHERE range_end >= DATE '{near[0]}' AND range_start <= DATE '{near[1]}'),
c AS (SELECT kind, NOT bool_or(gap) AND max(range_end) >= DATE '{near[1]}' AS covered FROM s GROUP BY kind),
o AS (SELECT d.kind || ' does not cover the lookback' AS why FROM (SELECT DISTINCT kind FROM k) d LEFT JOIN c USING (kind) WHERE NOT coalesce(covered, false)),
n AS (SELECT count(*) AS sessions FROM ({DAYS}) WHERE trade_date BETWEEN DATE '{near[0]}' AND DATE '{near[1]}')
SELECT sessions, concat_ws('; ', CASE WHEN sessions < 10 THEN 'too few benchmark sessions' END, (SELECT string_agg(why, '; ' ORDER BY why) FROM o)) AS blockers, sessions >= 10 AND (SELECT count(*) FROM o) = 0 AS ready FROM n"""
    register("d52_source_readiness", "sessions:l, blockers, ready", lambda t: uo.source_readiness(sessions(t), kinds(t), *near, 10).withColumn("blockers", F.array_join("blockers", "; ")), ready_sql)
    left_sql = f"""WITH r AS ({_RANGES}), d AS (SELECT DISTINCT key, CAST(unnest(generate_series(range_start - 10, range_end, INTERVAL 1 DAY)) AS DATE) AS day FROM r), c AS (SELECT DISTINCT key, CAST(unnest(generate_series(range_start, range_end, INTERVAL 1 DAY)) AS DATE) AS day FROM r),
  l AS (SELECT * FROM d EXCEPT SELECT * FROM c) SELECT key, min(day) AS range_start, max(day) AS range_end FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY key ORDER BY day) AS INTEGER) AS island FROM l) GROUP BY key, island"""
    register("g1_uncovered_ranges", "key:l, range_start, range_end", lambda t: uo.uncovered(ranges(t).withColumn("range_start", F.date_sub("range_start", 10)), ranges(t), "key"), left_sql)
    tags = {"discovery": ("2024-01-03", "2024-01-12"), "validation": ("2024-01-15", "2024-01-24")}
    register("g3_tag_periods", "symbol, bar_ts, period", lambda t: uo.tag_periods(t.bars, tags), "SELECT *, CASE WHEN trade_date <= DATE '2024-01-12' THEN 'discovery' ELSE 'validation' END AS period FROM bars WHERE trade_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-12' OR trade_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-24'")
    _market(register)


def _market(register) -> None:
    horizons = (5, 15, 30, 60)
    names = lambda h: [f"pct_positive_{h}m", *[f"{n}_{h}m_pct" for n in ("mean_return", "stddev_return", "p10_return", "p25_return", "median_return", "p75_return", "p90_return", "dispersion")]]
    q = lambda x, p: f"quantile_cont({x}, {p})"
    sql = ", ".join(
        f"100.0 * avg(CASE WHEN {x} > 0 THEN 1 WHEN {x} <= 0 THEN 0 END) AS pct_positive_{h}m, avg({x}) AS mean_return_{h}m_pct, stddev_samp({x}) AS stddev_return_{h}m_pct, {q(x, 0.1)} AS p10_return_{h}m_pct, {q(x, 0.25)} AS p25_return_{h}m_pct, {q(x, 0.5)} AS median_return_{h}m_pct, {q(x, 0.75)} AS p75_return_{h}m_pct, {q(x, 0.9)} AS p90_return_{h}m_pct, {q(x, 0.75)} - {q(x, 0.25)} AS dispersion_{h}m_pct"
        for h in horizons
        for x in [f"ret_{h}m_pct"]
    )
    register("d15_market_breadth", "bar_ts, eligible_universe_count:l, " + ", ".join(f"{c}:d" for h in horizons for c in names(h)), lambda t: mo.market_breadth(t.features), f"SELECT bar_ts, count(*) AS eligible_universe_count, {sql} FROM feat GROUP BY bar_ts")
    pct = lambda c, known="true": f"100.0 * avg(CASE WHEN {known} THEN CASE WHEN {c} THEN 1 WHEN NOT ({c}) THEN 0 END END)"
    extras = {
        "new_session_high_count:l": "count_if(high >= cumulative_high)", "new_session_high_pct:d": pct("high >= cumulative_high"), "new_session_low_count:l": "count_if(low <= cumulative_low)", "new_session_low_pct:d": pct("low <= cumulative_low"),
        "top_20pct_session_range_count:l": "count_if(cumulative_range_position >= 0.8)", "top_20pct_session_range_pct:d": pct("cumulative_range_position >= 0.8"), "bottom_20pct_session_range_count:l": "count_if(cumulative_range_position <= 0.2)", "bottom_20pct_session_range_pct:d": pct("cumulative_range_position <= 0.2"),
        "median_relative_volume:d": q("relative_volume_20bar", 0.5), "pct_relative_volume_gt_1:d": pct("relative_volume_20bar > 1"), "pct_relative_volume_gt_1_5:d": pct("relative_volume_20bar > 1.5"), "median_relative_trade_count:d": q("relative_trade_count_20bar", 0.5),
        "pct_abnormal_volatility:d": pct("rolling_realised_volatility_30bar > previous_day_realised_volatility * 1.5", "rolling_realised_volatility_30bar IS NOT NULL AND previous_day_realised_volatility > 0"),
        "pct_abnormal_activity_adjusted_price_impact:d": pct("activity_adjusted_return_5m > prior_activity_adjusted_return_5m * 2", "activity_adjusted_return_5m IS NOT NULL AND prior_activity_adjusted_return_5m > 0"),
    }
    register("d16_market_breadth_extras", "bar_ts, " + ", ".join(extras), lambda t: mo.market_breadth_extras(t.samples), f"SELECT bar_ts, {', '.join(f'{e} AS {n.split(':')[0]}' for n, e in extras.items())} FROM samples GROUP BY bar_ts")
    bench = lambda t: mo.benchmark_features(t.bars, proxies.BENCHMARKS, 5)
    columns = ", ".join(f"{c}:d" for c in mo.BENCHMARK)
    register("e19_benchmark_features", f"symbol, bar_ts, session_label, {columns}", bench, "SELECT * FROM feat WHERE symbol IN ('click_0', 'view_0')")
    pivot = lambda t: mo.benchmark_pivot(bench(t), {"click_0": "spy", "view_0": "qqq"})
    wide = ", ".join(f"{n}_{c}:d" for n in ("spy", "qqq") for c in mo.BENCHMARK)
    pivot_sql = "SELECT bar_ts, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN {c} END) AS {n}_{c}" for s, n in (("click_0", "spy"), ("view_0", "qqq")) for c in mo.BENCHMARK) + " FROM feat WHERE symbol IN ('click_0', 'view_0') GROUP BY bar_ts"
    register("d17_benchmark_pivot", f"bar_ts, {wide}", pivot, pivot_sql)
    register("c16_join_benchmark", "bar_ts, eligible_universe_count:l, spy_ret_5m_pct:d, qqq_ret_5m_pct:d", lambda t: mo.join_benchmark(mo.market_breadth(t.features, (5,)), pivot(t)), f"SELECT b.*, p.spy_ret_5m_pct, p.qqq_ret_5m_pct FROM (SELECT bar_ts, count(*) AS eligible_universe_count FROM feat GROUP BY 1) b LEFT JOIN ({pivot_sql}) p USING (bar_ts)")
    hit = f"coalesce({RULE_SQL}, false)"
    s = f"CASE WHEN {hit} THEN relative_volume_20bar END"
    wave = f"SELECT bar_ts, min(trade_date) AS trade_date, count(*) AS eligible_universe_count, count_if({hit}) AS qualifying_stock_count, {', '.join(f'''count_if({hit} AND liquidity_tier = '{x}') AS tier_{x.lower()}_count''' for x in 'ABC')}, avg({s}) AS average_signal_strength, {q(s, 0.5)} AS median_signal_strength, max({s}) AS maximum_signal_strength, stddev_samp({s}) AS signal_strength_dispersion, 100.0 * count_if({hit}) / count(*) AS qualifying_stock_pct FROM samples GROUP BY bar_ts"
    register("d18_rule_waves", "bar_ts, trade_date, eligible_universe_count:l, qualifying_stock_count:l, tier_a_count:l, tier_b_count:l, tier_c_count:l, average_signal_strength:d, median_signal_strength:d, maximum_signal_strength:d, signal_strength_dispersion:d, qualifying_stock_pct:d", waves, wave)
    taken = lambda t: t.samples.where(ro.rule_filter(RULE)).withColumn("exchange", F.split("symbol", "_")[0])
    conc = f"SELECT bar_ts, 100.0 * max(n) / sum(n) AS largest_exchange_share_pct, count(*) AS exchanges FROM (SELECT bar_ts, split_part(symbol, '_', 1) AS exchange, count(*) AS n FROM samples WHERE {RULE_SQL} GROUP BY ALL) GROUP BY bar_ts"
    register("d19_wave_concentration", "bar_ts, exchanges:l, largest_exchange_share_pct:d", lambda t: mo.wave_concentration(taken(t), "exchange").withColumn("exchanges", F.size("exchange_concentration")), conc)
    register("c17_assemble_waves", "bar_ts, qualifying_stock_count:l, largest_exchange_share_pct:d", lambda t: mo.assemble_waves(waves(t), mo.wave_concentration(taken(t), "exchange")), f"SELECT w.*, c.largest_exchange_share_pct FROM ({wave}) w LEFT JOIN ({conc}) c USING (bar_ts)")
    change = f"SELECT *, qualifying_stock_count - p AS wave_change, 100.0 * (qualifying_stock_count - p) / nullif(p, 0) AS wave_change_pct, p AS previous_wave_qualifying_count FROM (SELECT *, lag(qualifying_stock_count) OVER (PARTITION BY trade_date ORDER BY bar_ts) AS p FROM ({wave}))"
    register("e17_wave_change", "bar_ts, previous_wave_qualifying_count:l, wave_change:l, wave_change_pct:d", lambda t: mo.with_wave_change(waves(t)), change)
    streak = f"SELECT *, CASE WHEN elevated THEN count_if(elevated) OVER (PARTITION BY trade_date, g ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) ELSE 0 END AS consecutive_elevated FROM (SELECT *, count_if(NOT elevated) OVER (PARTITION BY trade_date ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, qualifying_stock_pct >= 20 AS elevated FROM ({wave})))"
    register("e18_elevated_streak", "bar_ts, elevated, consecutive_elevated:l", lambda t: mo.with_streak(waves(t), 20.0), streak)
