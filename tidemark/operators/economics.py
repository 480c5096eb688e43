"""Trade distributions, dependence, calendars, drawdowns, concurrency, capacity and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_label, week_label, weekday_calendar
from tidemark.operators.selection import joined, quantiles

YEAR_DAYS = 252


def trade_distribution(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Winners and losers, tails and shape (population moments) of net outcomes."""
    x = F.col("net")
    win, lose = F.when(x > 0, x), F.when(x < 0, x)
    known = obs.where("net IS NOT NULL")
    df = known.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.avg(win).alias("average_winner_pct"), F.avg(lose).alias("average_loser_pct"),
        F.count_if(x == 0).alias("breakeven_trades"), F.skewness("net").alias("_skew"), F.kurtosis("net").alias("_kurt"), F.stddev_pop("net").alias("_sd"),
    )
    shape = lambda c: F.when(F.col("observations") < 3, None).when(F.col("_sd") <= 1e-12, 0.0).otherwise(F.col(c))
    df = df.withColumns({"win_loss_magnitude_ratio": F.abs(F.try_divide("average_winner_pct", "average_loser_pct")), "skewness": shape("_skew"), "excess_kurtosis": shape("_kurt")})
    return joined(df.drop("_skew", "_kurt", "_sd"), quantiles(known, keys, {"median_winner_pct": (win, 0.5), "median_loser_pct": (lose, 0.5), "p01_pct": ("net", 0.01)}), keys)


def expected_shortfall(obs: DataFrame, keys: list[str], qs=(0.05, 0.01)) -> DataFrame:
    """Mean of the outcomes at or below each quantile."""
    known = obs.where("net IS NOT NULL")
    cuts = quantiles(known, keys, {f"_c{i}": ("net", q) for i, q in enumerate(qs)})
    return joined(known, cuts, keys).groupBy(*keys).agg(*[F.avg(F.when(F.col("net") <= F.col(f"_c{i}"), F.col("net"))).alias(f"expected_shortfall_{round(100 - 100 * q)}_pct") for i, q in enumerate(qs)])


def event_dependence(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Outcomes of one timestamp as one event."""
    e = obs.where("net IS NOT NULL").groupBy(*keys, "bar_ts").agg(F.avg("net").alias("m"), F.count("*").alias("n"))
    out = e.groupBy(*keys).agg(
        F.count("*").alias("independent_timestamp_events"), (F.count("*") / F.sum("n")).alias("event_ratio"), F.avg("n").alias("average_trades_per_event"), F.max("n").alias("max_trades_per_event"),
        F.avg("m").alias("event_level_net_expectancy_pct"), (100.0 * F.avg((F.col("m") > 0).cast("int"))).alias("event_level_win_rate_pct"),
        (F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("effective_events"),
    )
    return joined(out, quantiles(e, keys, {"p95_trades_per_event": ("n", 0.95), "event_level_median_pct": ("m", 0.5)}), keys)


def icc(obs: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """One-way analysis-of-variance intraclass correlation of net outcomes by group, from sums per group."""
    g = obs.where("net IS NOT NULL").groupBy(*keys, *group).agg(F.count("*").alias("n"), F.sum("net").alias("s"), F.sum(F.col("net") * F.col("net")).alias("q"))
    t = g.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("q").alias("Q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    between = F.try_divide(F.col("B") - F.col("S") * F.col("S") / F.col("N"), (F.col("k") - 1).cast("double"))
    within = F.try_divide(F.col("Q") - F.col("B"), (F.col("N") - F.col("k")).cast("double"))
    n0 = F.try_divide(F.col("N") - F.col("n2") / F.col("N"), (F.col("k") - 1).cast("double"))
    return t.withColumn("icc", F.try_divide(between - within, between + (n0 - 1) * within)).select(*keys, "icc")


def mae_corr(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of adverse excursion and outcome; null under three pairs."""
    p = obs.where("net IS NOT NULL AND mae_pct IS NOT NULL")
    return p.groupBy(*keys).agg(F.when(F.count("*") >= 3, F.corr("mae_pct", "net")).alias("mae_final_outcome_correlation"), F.count("*").alias("pairs"))


def calendar_returns(obs: DataFrame, first: str, last: str) -> DataFrame:
    """Mean outcome of each weekday of a period; days without trades earn nothing."""
    days = weekday_calendar(obs.sparkSession, first, last)
    daily = obs.where("net IS NOT NULL").groupBy("trade_date").agg(F.avg("net").alias("r"), F.count("*").alias("trades"))
    return days.join(daily, "trade_date", "left").select("trade_date", F.coalesce("r", F.lit(0.0)).alias("return_pct"), F.coalesce("trades", F.lit(0)).alias("trades"))


def calendar_summary(daily: DataFrame) -> DataFrame:
    r, active = F.col("return_pct"), F.when(F.col("trades") > 0, F.col("return_pct"))
    share = lambda c: 100.0 * F.avg((c > 0).cast("int"))
    half = F.lit(0.5)
    return daily.agg(
        F.count(active).alias("active_days"), F.count("*").alias("market_days"), F.avg(active).alias("average_return_per_active_day_pct"), F.percentile(active, half).alias("median_return_per_active_day_pct"), share(active).alias("profitable_active_day_pct"),
        F.avg(r).alias("average_return_per_market_day_pct"), F.percentile(r, half).alias("median_return_per_market_day_pct"), share(r).alias("profitable_market_day_pct"),
    )


def _compound(r: Column) -> Column:
    """Compounded percent of a group's returns, never below -100."""
    wealth = F.greatest(F.lit(0.0), 1 + r / 100)
    return F.when(F.min(wealth) <= 0, -100.0).otherwise((F.exp(F.sum(F.ln(F.when(wealth > 0, wealth)))) - 1) * 100)


def period_compound(daily: DataFrame, unit: str) -> DataFrame:
    """Compounded return of each week or month."""
    label = week_label(F.col("trade_date")) if unit == "week" else month_label(F.col("trade_date"))
    return daily.groupBy(label.alias("period")).agg(_compound(F.col("return_pct")).alias("return_pct"))


def risk_ratios(daily: DataFrame) -> DataFrame:
    """Annualised return, Sharpe and Sortino ratios of daily returns."""
    r = F.col("return_pct")
    down = F.sqrt(F.avg(F.least(r, F.lit(0.0)) * F.least(r, F.lit(0.0))))
    d = daily.agg(F.count("*").alias("n"), _compound(r).alias("compounded_pct"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"), down.alias("down"))
    year = F.when((F.col("n") >= 20) & (F.col("compounded_pct") > -100), F.pow(1 + F.col("compounded_pct") / 100, YEAR_DAYS / F.col("n")) * 100 - 100)
    scaled = lambda x: F.when(F.col(x) > 1e-12, F.col("m") / F.col(x) * F.sqrt(F.lit(float(YEAR_DAYS))))
    return d.select("compounded_pct", year.alias("annualised_return_pct"), scaled("sd").alias("sharpe"), scaled("down").alias("sortino"))


def turnover(obs: DataFrame, cost_bps: float) -> DataFrame:
    """Trades per day and the share of gross expectancy that costs take."""
    o = obs.where("gross_return_pct IS NOT NULL").agg(F.count("*").alias("trades"), F.countDistinct("trade_date").alias("days"), F.avg("gross_return_pct").alias("gross"))
    return o.select("trades", (F.col("trades") / F.col("days")).alias("trades_per_active_day"), F.when(F.col("gross") > 0, 100.0 * (cost_bps / 100.0) / F.col("gross")).alias("cost_drag_pct"))


def boundary_events(obs: DataFrame, minutes: int) -> DataFrame:
    """+1 at each entry and -1 at each exit."""
    start = obs.select("trade_date", F.col("bar_ts").alias("ts"), F.lit(1).alias("delta"))
    end = obs.select("trade_date", F.expr(f"bar_ts + INTERVAL '{minutes}' MINUTE").alias("ts"), F.lit(-1).alias("delta"))
    return start.unionByName(end)


def concurrency(obs: DataFrame, minutes: int) -> DataFrame:
    """Greatest number of open positions and position-minutes of each day."""
    e = boundary_events(obs, minutes).groupBy("trade_date", "ts").agg(F.sum("delta").alias("d"))
    w = Window.partitionBy("trade_date").orderBy("ts")
    run = e.withColumns({"open": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("ts").over(w)})
    span = F.expr("(extract(day from next - ts) * 1440 + extract(hour from next - ts) * 60 + extract(minute from next - ts))")
    return run.groupBy("trade_date").agg(F.max("open").alias("maximum_concurrent_positions"), F.sum(F.col("open") * F.coalesce(span, F.lit(0))).alias("position_minutes"))


def occupancy(obs: DataFrame, minutes: int) -> DataFrame:
    """Minutes of each day with any position: merged intervals."""
    i = obs.select("trade_date", "bar_ts", F.expr(f"bar_ts + INTERVAL '{minutes}' MINUTE").alias("end_ts"))
    w = Window.partitionBy("trade_date").orderBy("bar_ts", "end_ts")
    reach = F.max("end_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    i = i.withColumn("new", F.coalesce((F.col("bar_ts") >= reach).cast("int"), F.lit(1)))
    i = i.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = i.groupBy("trade_date", "island").agg((F.max("end_ts") - F.min("bar_ts")).alias("x"))
    return spans.groupBy("trade_date").agg(F.sum(F.expr("extract(day from x) * 1440 + extract(hour from x) * 60 + extract(minute from x)")).alias("occupied_minutes"))


def capacity_metrics(obs: DataFrame, rates=(0.01, 0.02, 0.05), column: str = "bar_dollar_volume") -> DataFrame:
    """Dollar volume of signals and what a share of it allows."""
    d = obs.agg(F.min(column).alias("least"), (100.0 * F.avg(F.col(column).isNull().cast("int"))).alias("missing_pct"))
    d = joined(d, quantiles(obs, [], {"p05": (column, 0.05), "median": (column, 0.5), "p95": (column, 0.95)}), [])
    d = d.withColumn("rate", F.explode(F.array(*[F.lit(r) for r in rates])))
    return d.withColumns({"capacity_least": F.col("least") * F.col("rate"), "capacity_median": F.col("median") * F.col("rate")})


def _days() -> WindowSpec:
    return Window.partitionBy(F.lit(1)).orderBy("trade_date")


def with_drawdown(daily: DataFrame) -> DataFrame:
    """Equity from daily returns, its peak (one at the start) and the percent below it.

    A daily series has one row a day; it is ordered in one task.
    """
    so_far = _days().rowsBetween(Window.unboundedPreceding, 0)
    wealth = F.greatest(F.lit(0.0), 1 + F.col("return_pct") / 100)
    d = daily.withColumn("equity", F.when(F.min(wealth).over(so_far) <= 0, 0.0).otherwise(F.exp(F.sum(F.ln(F.when(wealth > 0, wealth))).over(so_far))))
    d = d.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(so_far)))
    return d.withColumn("drawdown_pct", (F.col("equity") / F.col("peak") - 1) * 100)


def drawdown_stats(daily: DataFrame) -> DataFrame:
    d = with_drawdown(daily).withColumn("under", F.col("drawdown_pct") < -1e-9)
    d = d.withColumn("run", F.count_if(~F.col("under")).over(_days().rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.where("under").groupBy("run").agg(F.count("*").alias("n")).agg(F.max("n").alias("maximum_underwater_duration_market_days"), F.avg("n").alias("average_drawdown_duration_market_days"))
    one = d.agg(F.min("drawdown_pct").alias("maximum_drawdown_pct"), F.avg(F.when(F.col("under"), F.col("drawdown_pct"))).alias("average_drawdown_pct"), F.count_if("under").alias("underwater_market_days"), F.max_by("equity", "trade_date").alias("ending_equity_multiple"))
    return one.withColumn("k", F.lit(1)).join(runs.withColumn("k", F.lit(1)), "k").drop("k")


def rolling_stats(daily: DataFrame, n: int = 20) -> DataFrame:
    """Mean, profit factor, compounded return, Sharpe and drawdown of each full window of ``n`` days."""
    w = _days().rowsBetween(1 - n, 0)
    r = F.col("return_pct")
    wealth = F.greatest(F.lit(1e-300), 1 + r / 100)
    loss = F.sum(F.when(r < 0, -r)).over(w)
    d = daily.withColumns({"size": F.count("*").over(w), "rolling_mean_pct": F.avg(r).over(w), "rolling_profit_factor": F.when(loss > 0, F.coalesce(F.sum(F.when(r > 0, r)).over(w), F.lit(0.0)) / loss), "rolling_return_pct": (F.exp(F.sum(F.ln(wealth)).over(w)) - 1) * 100, "_sd": F.stddev_samp(r).over(w), "_all": F.collect_list(r).over(w)})
    start = F.struct(F.lit(1.0).alias("e"), F.lit(1.0).alias("p"), F.lit(0.0).alias("d"))

    def step(s: Column, x: Column) -> Column:
        e = s["e"] * F.greatest(F.lit(0.0), 1 + x / 100)
        p = F.greatest(s["p"], e)
        return F.struct(e.alias("e"), p.alias("p"), F.least(s["d"], (e / p - 1) * 100).alias("d"))

    local = F.aggregate("_all", start, step, lambda s: s["d"])
    sharpe = F.when(F.col("_sd") > 1e-12, F.col("rolling_mean_pct") / F.col("_sd") * F.sqrt(F.lit(float(YEAR_DAYS))))
    return d.withColumns({"rolling_sharpe": sharpe, "rolling_drawdown_pct": local}).where(F.col("size") == n).drop("size", "_sd", "_all")


def rolling_summary(rolled: DataFrame) -> DataFrame:
    names = ("rolling_mean_pct", "rolling_profit_factor", "rolling_return_pct", "rolling_sharpe", "rolling_drawdown_pct")
    return rolled.agg(*[F.min(c).alias(f"minimum_{c}") for c in names], *[F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in names])


def losing_streak(daily: DataFrame) -> DataFrame:
    """The longest run of losing days among days with trades."""
    a = daily.where("trades > 0").withColumn("lost", F.col("return_pct") < 0)
    a = a.withColumn("run", F.count_if(~F.col("lost")).over(_days().rowsBetween(Window.unboundedPreceding, 0)))
    runs = a.where("lost").groupBy("run").agg(F.count("*").alias("n"))
    return runs.agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest_losing_streak"))


def best_share(daily: DataFrame) -> DataFrame:
    """Shares of the summed return that the best day, week and month make."""
    parts = [daily.groupBy(g.alias("g")).agg(F.sum("return_pct").alias("r")).agg(F.when(F.abs(F.sum("r")) > 1e-12, 100.0 * F.max("r") / F.sum("r")).alias(f"best_{n}_share_pct")) for n, g in (("day", F.col("trade_date").cast("string")), ("week", week_label(F.col("trade_date"))), ("month", month_label(F.col("trade_date"))))]
    out = parts[0].withColumn("k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("k", F.lit(1)), "k")
    return out.drop("k")


CHECKS = {
    "positive_net_expectancy": "net_avg_pct > 0", "positive_event_expectancy": "event_level_net_expectancy_pct > 0", "profit_factor_above_one": "profit_factor > 1", "positive_after_30bps": "cost30_net_avg_pct > 0",
    "positive_after_2m_delay": "delay2_net_avg_pct > 0", "positive_relaxed_neighbour": "relaxed_net_avg_pct > 0", "positive_tightened_neighbour": "tightened_net_avg_pct > 0", "not_dependent_on_top_1pct": "net_expectancy_excluding_top_1pct_pct > 0",
    "minimum_observations": "observations >= {observations}", "minimum_dates": "dates >= {dates}",
}


def promotion(df: DataFrame, mode: str = "development", observations: int = 250, dates: int = 10) -> DataFrame:
    """Ten checks, and the decision and classification that follow from them; a missing value fails its check."""
    df = df.withColumns({k: F.coalesce(F.expr(e.format(observations=observations, dates=dates)), F.lit(False)) for k, e in CHECKS.items()})
    every = lambda *names: F.expr(" AND ".join(names))
    core = every("positive_net_expectancy", "positive_event_expectancy", "profit_factor_above_one", "positive_after_30bps", "not_dependent_on_top_1pct")
    robust = every("positive_after_2m_delay", "positive_relaxed_neighbour", "positive_tightened_neighbour")
    credible = every("minimum_observations", "minimum_dates") & F.coalesce(F.col("date_clustered_t_stat") > 0, F.lit(False))
    return df.withColumns(
        {
            "decision": F.when(~core, "reject").when(~robust, "retain_for_research").otherwise("promote_for_further_validation"),
            "classification": F.when(~core | ~robust, "exploratory").when(credible, "statistically_credible").otherwise("promising"),
            "compatible_verdict": F.when(~core, "REJECT").when(~robust, "WEAK").when(credible & F.lit(mode == "historical_holdout"), "HISTORICAL_HOLDOUT").otherwise("PROMISING"),
        }
    )


#: What stands in the way of deployment before and after portfolio and regime evidence.
BLOCKERS = ("frozen position sizing", "portfolio gross/net exposure limits", "actual capital utilisation", "instrument-level liquidity/capacity", "sector-level dependence", "realistic partial-fill/borrow model where relevant")
LIFTED = ("actual capital utilisation", "instrument-level liquidity/capacity")
ADDED = ("freeze one production position-sizing/capital-allocation policy before sealed holdout", "calibrate market impact beyond minute-volume participation proxies")
NO_REGIMES = "objective pre-sealed market-state regime diagnostics"


def evidence_caps(df: DataFrame) -> DataFrame:
    """Caps on a classification: needs classification, adjusted_p, portfolio_available, regimes_available, negative_regimes."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    credible = F.coalesce(F.col("adjusted_p") <= 0.05, F.lit(False))
    blocked = F.when(F.col("portfolio_available"), F.array_union(F.array_except(lits(BLOCKERS), lits(LIFTED)), lits(ADDED))).otherwise(lits(BLOCKERS))
    blocked = F.when(F.col("regimes_available"), blocked).otherwise(F.array_union(blocked, lits([NO_REGIMES])))
    stable = F.when(~F.col("regimes_available"), "not_measured").when(F.col("negative_regimes") > 0, "mixed").otherwise("no_negative_supported_regime_detected")
    capped = F.when((F.col("classification") == "statistically_credible") & ~credible, "promising").otherwise(F.col("classification"))
    return df.withColumns({"multiple_testing_credible_at_5pct": credible, "deployment_blockers": blocked, "regime_stability": stable, "classification": capped})
