"""Replay of rules: entries, excursions, variants, observation metrics, breakdowns and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rules import rule_filter
from tidemark.operators.selection import at_top, joined, quantiles, selected, top_count


def with_excursion(df: DataFrame, minutes: int) -> DataFrame:
    """Highest high and lowest low over (t, t + minutes] of the same symbol; minutes: a day at most."""
    return _ahead(df, minutes, "INTERVAL '1' MINUTE FOLLOWING")


def with_path(df: DataFrame, minutes: int) -> DataFrame:
    """The same over [t, t + minutes]."""
    return _ahead(df, minutes, "CURRENT ROW")


def _ahead(df: DataFrame, minutes: int, first: str) -> DataFrame:
    """Each task has one day of a symbol, and the first minutes of the next day carried back to it."""
    day = F.to_date("bar_ts")
    early = F.hour("bar_ts") * 60 + F.minute("bar_ts") <= minutes
    days = df.withColumn("_day", F.explode(F.when(early, F.array(day, F.date_sub(day, 1))).otherwise(F.array(day))))
    w = f"(PARTITION BY symbol, _day ORDER BY bar_ts RANGE BETWEEN {first} AND INTERVAL '{minutes}' MINUTE FOLLOWING)"
    out = days.withColumns({"path_high": F.expr(f"max(high) OVER {w}"), "path_low": F.expr(f"min(low) OVER {w}")})
    return out.where(F.col("_day") == day).drop("_day")


def join_entry(signals: DataFrame, features: DataFrame, delays=(0, 1, 2, 5), columns=("close", "fwd_return_5m_pct"), step_minutes: int = 1) -> DataFrame:
    """Each signal at each delay, in bars of ``step_minutes``, with the bar exactly so much later; null where there is none."""
    s = signals.select("symbol", "bar_ts", "trade_date", F.explode(F.array(*[F.lit(d) for d in delays])).alias("delay"))
    s = s.withColumn("entry_ts", F.expr(f"bar_ts + make_dt_interval(0, 0, delay * {step_minutes}, 0)"))
    bars = features.select("symbol", F.col("bar_ts").alias("entry_ts"), *[F.col(c).alias(f"entry_{c}") for c in columns])
    return s.join(bars, ["symbol", "entry_ts"], "left")


def join_exit(entries: DataFrame, features: DataFrame, minutes: int) -> DataFrame:
    """Entries (symbol, entry_ts, trade_date) with the close so many minutes later on the same day."""
    e = entries.withColumn("exit_ts", F.expr(f"entry_ts + INTERVAL '{minutes}' MINUTE"))
    bars = features.select("symbol", F.col("bar_ts").alias("exit_ts"), "trade_date", F.col("close").alias("exit_price"))
    return e.join(bars, ["symbol", "exit_ts", "trade_date"], "left")


def match_rules(samples: DataFrame, rules: dict[str, list[dict]]) -> DataFrame:
    """(rule, row) for every rule that takes a row: one scan for all rules."""
    hits = F.array(*[F.when(rule_filter(c), F.lit(name)) for name, c in rules.items()])
    return samples.withColumn("rule", F.explode(F.array_compact(hits)))


def observations(matched: DataFrame, horizon: int, direction: str) -> DataFrame:
    """Signals of rules with signed outcome and excursions."""
    sign = 1.0 if direction == "long" else -1.0
    out = {"gross_return_pct": sign * F.col(f"fwd_return_{horizon}m_pct"), "mfe_pct": sign * F.col("fwd_mfe_30m_pct" if sign > 0 else "fwd_mae_30m_pct"), "mae_pct": sign * F.col("fwd_mae_30m_pct" if sign > 0 else "fwd_mfe_30m_pct")}
    return matched.withColumns(out)


def with_net(obs: DataFrame, cost_bps: float) -> DataFrame:
    return obs.withColumn("net", F.col("gross_return_pct") - cost_bps / 100.0)


def cost_grid(obs: DataFrame, costs=(20, 25, 30, 40)) -> DataFrame:
    """Observations at each cost: net and cost_bps."""
    return obs.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs]))).withColumn("net", F.col("gross_return_pct") - F.col("cost_bps") / 100.0)


def _profit_factor(x: Column) -> Column:
    loss = F.sum(F.when(x < 0, -x))
    return F.when(loss > 0, F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)) / loss)


def t_stat(mean: Column, sd: Column, n: Column) -> Column:
    return F.when(sd > 1e-9, mean / sd * F.sqrt(n))


PERCENTILES = {"p05_pct": 0.05, "p25_pct": 0.25, "median_pct": 0.5, "p75_pct": 0.75, "p95_pct": 0.95}


def obs_metrics(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Signals, missing outcomes and the distribution of net outcomes (column net) by ``keys``.

    Quantiles are exact, by selection: ``obs`` is read several times, so give a stored table.
    """
    net = F.col("net")
    n = F.count("net")
    df = obs.groupBy(*keys).agg(
        F.count("*").alias("candidate_signals"), n.alias("observations"), F.avg("gross_return_pct").alias("gross_avg_pct"), F.avg("net").alias("net_avg_pct"), F.stddev_samp("net").alias("stdev_pct"), F.min("net").alias("worst_pct"), F.max("net").alias("best_pct"),
        (100.0 * F.avg((net > 0).cast("int"))).alias("win_rate_pct"), _profit_factor(net).alias("profit_factor"),
        F.avg("mfe_pct").alias("mfe_avg_pct"), F.avg("mae_pct").alias("mae_avg_pct"),
    )
    wanted = {name: ("net", q) for name, q in PERCENTILES.items()} | {"mfe_median_pct": ("mfe_pct", 0.5), "mae_median_pct": ("mae_pct", 0.5)}
    df = joined(df, quantiles(obs, keys, wanted), keys)
    missing = F.col("candidate_signals") - F.col("observations")
    return df.withColumns({"missing_outcomes": missing, "missing_data_rate_pct": 100.0 * missing / F.col("candidate_signals"), "t_stat": t_stat(F.col("net_avg_pct"), F.col("stdev_pct"), F.col("observations"))})


def by_date(obs: DataFrame, keys: list[str]) -> DataFrame:
    return obs.where("net IS NOT NULL").groupBy(*keys, "trade_date").agg(F.avg("net").alias("m"), F.sum("net").alias("s"), F.count("*").alias("n"))


def clustered_t(obs: DataFrame, keys: list[str]) -> DataFrame:
    """t of the daily means."""
    d = by_date(obs, keys).groupBy(*keys).agg(F.avg("m").alias("_m"), F.stddev_samp("m").alias("_s"), F.count("*").alias("dates"))
    return d.withColumn("date_clustered_t_stat", t_stat(F.col("_m"), F.col("_s"), F.col("dates"))).drop("_m", "_s")


def loo_min(obs: DataFrame, keys: list[str]) -> DataFrame:
    """The least mean with one date left out."""
    w = Window.partitionBy(*keys)
    d = by_date(obs, keys).withColumns({"all_s": F.sum("s").over(w), "all_n": F.sum("n").over(w)})
    return d.groupBy(*keys).agg(F.min(F.try_divide(F.col("all_s") - F.col("s"), (F.col("all_n") - F.col("n")).cast("double"))).alias("leave_one_date_out_min_net_avg_pct"))


def top_share(obs: DataFrame, keys: list[str], percents=(1, 5, 10)) -> DataFrame:
    """Share of the total that the best outcomes make, and the mean without them.

    The least outcome among the best is found by selection; what lies above and below it is summed, and
    those equal to it are counted: nothing is sorted, however many outcomes are equal.
    """
    net, n = F.col("net"), F.col("n")
    known = obs.where("net IS NOT NULL")
    edges = selected(known, keys, {f"_t{p}": ("net", 1 - p / 100, at_top(p)) for p in percents})
    sums = [F.count("*").alias("n"), F.sum("net").alias("total")]
    for p in percents:
        above, below = net > F.col(f"_t{p}"), net < F.col(f"_t{p}")
        sums += [F.sum(F.when(above, net)).alias(f"_above{p}"), F.count_if(above).alias(f"_n_above{p}"), F.sum(F.when(below, net)).alias(f"_below{p}"), F.count_if(below).alias(f"_n_below{p}"), F.max(f"_t{p}").alias(f"_edge{p}")]
    df = joined(known, edges, keys).groupBy(*keys).agg(*sums)
    out = {}
    for p in percents:
        k = top_count(n, p)
        top = F.coalesce(f"_above{p}", F.lit(0.0)) + (k - F.col(f"_n_above{p}")) * F.col(f"_edge{p}")
        rest = F.coalesce(f"_below{p}", F.lit(0.0)) + (n - k - F.col(f"_n_below{p}")) * F.col(f"_edge{p}")
        out[f"top_{p}pct_return_share_pct"] = F.when(F.abs("total") > 1e-12, 100.0 * top / F.col("total"))
        out[f"net_expectancy_excluding_top_{p}pct_pct"] = F.when(n > k, rest / (n - k))
    return df.select(*keys, *[v.alias(name) for name, v in out.items()])


def breakdown(obs: DataFrame, dims=("liquidity_tier", "price_group", "symbol", "trade_date", "month", "year")) -> DataFrame:
    """Metrics by each dimension on its own: sums by grouping sets in one pass, medians by one selection over all
    values of all dimensions. ``obs`` is read several times, so give a stored table."""
    d = obs.withColumns({"month": F.date_format("trade_date", "yyyy-MM"), "year": F.date_format("trade_date", "yyyy"), "trade_date": F.col("trade_date").cast("string")})
    d = d.select("net", *[F.col(c).cast("string").alias(c) for c in dims])
    aggs = (F.count("net").alias("observations"), F.avg("net").alias("net_avg_pct"), F.grouping_id().alias("_g"))
    out = d.groupingSets([[F.col(c)] for c in dims], *[F.col(c) for c in dims]).agg(*aggs)
    n = len(dims)
    masks = {(1 << n) - 1 - (1 << (n - 1 - i)): c for i, c in enumerate(dims)}
    name = reduce(lambda a, kv: F.when(F.col("_g") == kv[0], kv[1]).otherwise(a), masks.items(), F.lit(None).cast("string"))
    out = out.select(name.alias("dimension"), F.coalesce(F.coalesce(*dims), F.lit("missing")).alias("value"), "observations", "net_avg_pct")
    each = d.select("net", F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(c, F.lit("missing")).alias("value")) for c in dims])).alias("x")).select("net", "x.*")
    keys = ["dimension", "value"]
    return joined(out, quantiles(each, keys, {"median_pct": ("net", 0.5)}), keys)


def verdict(df: DataFrame, mode: str = "development") -> DataFrame:
    """REJECT, WEAK, PROMISING or HISTORICAL_HOLDOUT from the base, cost and neighbourhood columns."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    reject = (z("net_avg_pct") <= 0) | (F.coalesce("date_clustered_t_stat", F.lit(-99.0)) <= 0)
    robust = (z("cost30_net_avg_pct") > 0) & (z("profit_factor") > 1.05) & (z("date_clustered_t_stat") >= 1.0) & (z("relaxed_net_avg_pct") > 0) & (z("tightened_net_avg_pct") > 0)
    top = F.when((z("date_clustered_t_stat") >= 1.5) & F.lit(mode == "historical_holdout"), "HISTORICAL_HOLDOUT").otherwise("PROMISING")
    return df.withColumn("verdict", F.when(reject, "REJECT").when(~robust, "WEAK").otherwise(top))


def join_context(obs: DataFrame, features: DataFrame, market: DataFrame, columns=("median_return_5m_pct", "pct_positive_30m")) -> DataFrame:
    """Observations with their bar's dollar volume, the market's state then and five minutes before."""
    bar = features.select("symbol", "bar_ts", "bar_dollar_volume")
    prior = market.select((F.col("bar_ts") + F.expr("INTERVAL '5' MINUTE")).alias("bar_ts"), *[F.col(c).alias(f"prior_{c}") for c in columns])
    return obs.join(bar, ["symbol", "bar_ts"], "left").join(market.select("bar_ts", *columns), "bar_ts", "left").join(prior, "bar_ts", "left")


def regime_thresholds(market: DataFrame, columns=("stddev_return_30m_pct", "dispersion_30m_pct", "median_relative_volume")) -> DataFrame:
    """One row: lower and upper quartile and number of each column."""
    counts = market.agg(*[F.count(c).alias(f"{c}_n") for c in columns])
    return joined(counts, quantiles(market, [], {f"{c}_p{round(100 * q)}": (c, q) for c in columns for q in (0.25, 0.75)}), [])


def _band(x: Column, low, high, names: tuple[str, str, str]) -> Column:
    return F.when(x < low, names[0]).when(x > high, names[2]).when(x.isNotNull(), names[1])


def regime_labels(thresholds: dict[str, Column]) -> dict[str, Column]:
    """Labels of seven regimes from market-state columns; ``thresholds`` as of ``regime_thresholds``, values or columns."""
    t, c = thresholds, F.col
    return {
        "market_direction": _band(c("median_return_30m_pct"), -0.1, 0.1, ("falling", "sideways", "rising")),
        "breadth": _band(c("pct_positive_30m"), 40, 60, ("weak", "neutral", "strong")),
        "session": F.when(c("minute_of_day") < 660, "opening").when(c("minute_of_day") >= 900, "closing").otherwise("midday"),
        "volatility_level": _band(c("stddev_return_30m_pct"), t["stddev_return_30m_pct_p25"], t["stddev_return_30m_pct_p75"], ("low", "normal", "high")),
        "volatility_change": _band(c("stddev_return_30m_pct") - c("prior_stddev_return_30m_pct"), -0.02, 0.02, ("falling", "steady", "rising")),
        "dispersion": _band(c("dispersion_30m_pct"), t["dispersion_30m_pct_p25"], t["dispersion_30m_pct_p75"], ("low", "normal", "high")),
        "activity": _band(c("median_relative_volume"), t["median_relative_volume_p25"], t["median_relative_volume_p75"], ("low", "normal", "high")),
    }


def regime_stats(obs: DataFrame, labels: dict[str, Column], least: int = 30, least_events: int = 5) -> DataFrame:
    """Outcomes by regime and label, whether enough support them, and whether they are negative."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("regime"), v.alias("label")) for k, v in labels.items()]))
    r = obs.where("net IS NOT NULL").select("bar_ts", "trade_date", "net", pairs.alias("r")).select("bar_ts", "trade_date", "net", "r.regime", "r.label").where("label IS NOT NULL")
    events = r.groupBy("regime", "label", "bar_ts").agg(F.avg("net").alias("m")).groupBy("regime", "label").agg(F.avg("m").alias("event_mean_net_return_pct"), F.count("*").alias("events"))
    out = r.groupBy("regime", "label").agg(F.count("*").alias("observations"), F.avg("net").alias("net_avg_pct"), _profit_factor(F.col("net")).alias("profit_factor")).join(events, ["regime", "label"])
    out = out.join(quantiles(r, ["regime", "label"], {"median_pct": ("net", 0.5)}), ["regime", "label"])
    supported = (F.col("observations") >= least) & (F.col("events") >= least_events)
    return out.withColumns({"supported": supported, "negative": supported & ((F.col("net_avg_pct") <= 0) | (F.col("event_mean_net_return_pct") <= 0))})


def strategy_regimes(trades: DataFrame) -> DataFrame:
    """Accepted trades with market state by fixed thresholds; coverage is the share of trades that have a state."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    b, s, d, v, m = F.col("pct_positive_30m"), z("spy_return_30m_pct"), z("stddev_return_30m_pct"), z("median_relative_volume"), F.col("minute_of_day")
    labels = {
        "breadth": F.when(b < 40, "weak").when(b > 60, "strong").otherwise("neutral"),
        "spy_30m": F.when(s < -0.25, "falling").when(s > 0.25, "rising").otherwise("sideways"),
        "dispersion": F.when(d < 1, "low").when(d >= 2, "high").otherwise("medium"),
        "market_activity": F.when(v < 0.8, "low").when(v >= 1.5, "high").otherwise("normal"),
        "session": F.when(m < 660, "opening").when(m >= 900, "closing").otherwise("midday"),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("regime_type"), x.alias("regime_value")) for k, x in labels.items()]))
    share = trades.agg((100.0 * F.avg(b.isNotNull().cast("int"))).alias("coverage_pct"), F.lit(1).alias("_one"))
    r = trades.where(b.isNotNull()).withColumn("_one", F.lit(1)).join(F.broadcast(share), "_one").withColumn("r", pairs)
    net = F.col("net_return_pct")
    r = r.select("*", "r.*")
    keys = ["regime_type", "regime_value"]
    out = r.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.countDistinct("signal_ts").alias("independent_events"), F.avg(net).alias("net_avg_pct"), _profit_factor(net).alias("profit_factor"),
        (100.0 * F.avg((net > 0).cast("int"))).alias("win_rate_pct"), F.sum(F.col("filled_notional") * net / 100).alias("total_pnl"), F.first("coverage_pct").alias("coverage_pct"),
    )
    return joined(out, quantiles(r, keys, {"median_pct": ("net_return_pct", 0.5)}), keys)
