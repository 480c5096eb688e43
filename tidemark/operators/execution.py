"""Executable trades: sizing, day-local allocation, money metrics, equity and scorecards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.selection import joined, quantiles


@dataclass(frozen=True)
class ExecutionConfig:
    capitals: tuple[float, ...] = (10_000.0, 100_000.0)
    position_pct: float = 5.0
    max_symbol_pct: float = 10.0
    max_gross_pct: float = 100.0
    max_net_pct: float = 100.0
    max_positions: int = 20
    one_per_symbol: bool = True
    bar_participation_pct: float = 1.0
    daily_participation_pct: float = 0.1
    min_fill: float = 0.25
    allow_partial: bool = True
    costs_bps: tuple[float, ...] = (20.0, 25.0, 30.0, 40.0)
    #: "liquidity_desc", "signal_strength_desc" or "symbol": who comes first among signals of one instant.
    priority: str = "liquidity_desc"
    large_loss_pct: float = -2.0
    breakeven_bps: float = 1.0


def size_fills(signals: DataFrame, capital: Column, c: ExecutionConfig) -> DataFrame:
    """Fill of each signal on its own: target, symbol and participation caps, and the first reason to reject it.

    Caps that are not positive say nothing; a signal without any positive cap has no capacity.
    """
    positive = lambda name, pct: F.when(F.coalesce(F.col(name), F.lit(0.0)) * pct / 100 > 0, F.col(name) * pct / 100)
    bar, day = positive("entry_bar_dollar_volume", c.bar_participation_pct), positive("daily_dollar_volume", c.daily_participation_pct)
    df = signals.withColumns({"desired_notional": capital * c.position_pct / 100, "capacity_notional": F.coalesce(F.least(bar, day), F.lit(0.0))})
    df = df.withColumn("filled_notional", F.greatest(F.lit(0.0), F.least("desired_notional", capital * c.max_symbol_pct / 100, "capacity_notional")))
    df = df.withColumn("fill_fraction", F.coalesce(F.try_divide("filled_notional", "desired_notional"), F.lit(0.0)))
    reason = F.when(F.col("entry_price").isNull(), "unavailable_entry_fill").when(F.col("exit_price").isNull(), "unavailable_exit_fill").when(F.col("capacity_notional") <= 0, "liquidity_capacity_unavailable")
    reason = reason.when(F.lit(not c.allow_partial) & (F.col("filled_notional") + 1e-9 < F.col("desired_notional")), "partial_fill_not_allowed").when(F.col("fill_fraction") < c.min_fill, "minimum_fill_fraction")
    return df.withColumn("rejection_reason", reason)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


_HELD = "array<struct<exit:timestamp_ntz,symbol:string,sign:double,notional:double>>"
_STRETCH = 64
_FILLS = "array<struct<filled_notional:double,fill_fraction:double,rejection_reason:string>>"


def allocate_day(signals: DataFrame, c: ExecutionConfig) -> DataFrame:
    """Accept signals in order of time and priority within each (capital, delay, day); positions never cross days.

    A signal is tested for its fills, a position in its symbol, the number of positions, capacity, a
    partial fill and the least fill, in this order. It is a fold over one day of one scenario, whose
    state is the open positions: a group has as many rows as a day has signals, whatever the history.
    Needs capital, delay, trade_date, symbol, signal_ts, entry_ts, exit_ts, direction, entry_price,
    exit_price, gross_return_pct, capacity_notional, desired_notional and daily_dollar_volume, and
    signal_strength if it decides. What a signal could fill is null where it did not come to that.
    """
    keys, order = ["capital", "delay", "trade_date"], [F.col("signal_ts")]
    if c.priority == "signal_strength_desc":
        order.append((-F.abs(F.coalesce("signal_strength", F.lit(0.0)))).alias("by_strength"))
    if c.priority != "symbol":
        order.append((-F.coalesce("daily_dollar_volume", F.lit(0.0))).alias("by_volume"))
    kept = ("symbol", "entry_ts", "exit_ts", "direction", "entry_price", "exit_price", "gross_return_pct", "capacity_notional", "desired_notional")
    # a stretch of signals at a time, so that adding a result never copies all those before it; stretches are gathered
    # as such: slices of the day's array would each copy it whole
    rows = signals.select(*keys, *order, *kept)
    names = rows.columns[len(keys) :]
    rows = rows.withColumn("stretch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*names)) - 1) / _STRETCH))
    parts = rows.groupBy(*keys, "stretch").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("part"))
    days = parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("stretch", "part"))), lambda p: p["part"]).alias("stretches")).withColumn("day", F.flatten("stretches"))
    limit = lambda name: F.col("capital") * (getattr(c, f"max_{name}_pct") / 100)
    missing = lambda x: x.isNull() | F.isnan(x)
    zero, none = F.lit(0.0), F.lit(None).cast("double")

    def step(s: Column, r: Column) -> Column:
        sign = F.when(r["direction"] == "long", 1.0).otherwise(-1.0)
        unfilled = F.when(missing(r["entry_price"]), "unavailable_entry_fill").when(missing(r["exit_price"]), "unavailable_exit_fill")

        def among(live: Column) -> Column:
            gross = F.aggregate(live, zero, lambda a, h: a + h["notional"])
            net = F.aggregate(live, zero, lambda a, h: a + h["sign"] * h["notional"])
            room = F.least(F.greatest(zero, limit("gross") - gross), F.greatest(zero, limit("net") - sign * net), limit("symbol"))
            return _let(F.greatest(zero, F.least(r["desired_notional"], room, r["capacity_notional"])), lambda fill: judged(live, fill))

        def judged(live: Column, fill: Column) -> Column:
            fraction = F.when(r["desired_notional"] > 0, fill / r["desired_notional"]).otherwise(0.0)
            crowd = F.when(F.lit(c.one_per_symbol) & F.exists(live, lambda h: h["symbol"] == r["symbol"]), "existing_symbol_position").when(F.size(live) >= c.max_positions, "max_positions")
            short = F.when(r["capacity_notional"] <= 0, "liquidity_capacity_unavailable").when(F.lit(not c.allow_partial) & (fill + 1e-9 < r["desired_notional"]), "partial_fill_not_allowed").when((fill <= 0) | (fraction < c.min_fill), "minimum_fill_fraction")
            tested = F.struct(F.when(crowd.isNull(), fill).alias("filled_notional"), F.when(crowd.isNull(), fraction).alias("fill_fraction"), F.coalesce(crowd, short).alias("rejection_reason"))
            return _let(tested, lambda out: F.struct(F.when(out["rejection_reason"].isNull(), F.concat(live, F.array(F.struct(r["exit_ts"].alias("exit"), r["symbol"].alias("symbol"), sign.alias("sign"), fill.alias("notional"))))).otherwise(live).alias("held"), F.concat(s["out"], F.array(out)).alias("out")))

        gone = F.struct(none.alias("filled_notional"), none.alias("fill_fraction"), unfilled.alias("rejection_reason"))
        kept_on = F.struct(s["held"].alias("held"), F.concat(s["out"], F.array(gone)).alias("out"))
        return F.when(unfilled.isNotNull(), kept_on).otherwise(_let(F.filter(s["held"], lambda h: h["exit"] > r["entry_ts"]), among))

    one = lambda s, part: _let(F.aggregate(part, F.struct(s["held"].alias("held"), F.array().cast(_FILLS).alias("out")), step), lambda x: F.struct(x["held"].alias("held"), F.concat(s["outs"], F.array(x["out"])).alias("outs")))
    start = F.struct(F.array().cast(_HELD).alias("held"), F.array().cast(f"array<{_FILLS}>").alias("outs"))
    fills = F.aggregate("stretches", start, one, lambda s: F.flatten(s["outs"]))
    folded = days.select(*keys, F.explode(F.arrays_zip("day", fills.alias("fill"))).alias("x"))
    rows = folded.select(*keys, "x.day.*", "x.fill.*")
    return rows.select(*keys, "symbol", "signal_ts", "entry_ts", "exit_ts", "direction", "entry_price", "exit_price", "gross_return_pct", "capacity_notional", "filled_notional", "fill_fraction", F.col("rejection_reason").isNull().alias("accepted"), "rejection_reason")


def dedupe_overlaps(signals: DataFrame, minutes: int) -> DataFrame:
    """Signals of a symbol's day that start when the one kept before has ended: a fold over the day's sorted times."""
    days = signals.groupBy("symbol", "trade_date").agg(F.array_sort(F.collect_set("bar_ts")).alias("times"))
    start = F.struct(F.array().cast("array<timestamp_ntz>").alias("kept"), F.lit(None).cast("timestamp_ntz").alias("until"))

    def step(s: Column, t: Column) -> Column:
        free = s["until"].isNull() | (t >= s["until"])
        return F.struct(F.when(free, F.concat(s["kept"], F.array(t))).otherwise(s["kept"]).alias("kept"), F.when(free, t + F.expr(f"INTERVAL '{minutes}' MINUTE")).otherwise(s["until"]).alias("until"))

    return days.select("symbol", "trade_date", F.explode(F.aggregate("times", start, step, lambda s: s["kept"])).alias("bar_ts"))


def rejections(trades: DataFrame, keys=("capital", "delay")) -> DataFrame:
    """Signals by reason of rejection, and the share of their scenario."""
    n = trades.groupBy(*keys, F.coalesce("rejection_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("share_pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def with_costs(trades: DataFrame, costs) -> DataFrame:
    """Accepted trades at each cost; costs change no acceptance, so they come after allocation."""
    t = trades.where("accepted").withColumn("cost_bps", F.explode(F.array(*[F.lit(float(x)) for x in costs])))
    return t.withColumns({"net_return_pct": F.col("gross_return_pct") - F.col("cost_bps") / 100, "estimated_cost": F.col("filled_notional") * F.col("cost_bps") / 10_000})


def trade_money_metrics(costed: DataFrame, c: ExecutionConfig, keys=("capital", "delay", "cost_bps")) -> DataFrame:
    net, edge = F.col("net_return_pct"), c.breakeven_bps / 100
    rate = lambda x: 100.0 * F.avg(x.cast("int"))
    pnl, gross = F.sum(F.col("filled_notional") * net / 100), F.sum(F.col("filled_notional") * F.col("gross_return_pct") / 100)
    out = costed.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.avg(net).alias("net_expected_value_pct"), rate(net > edge).alias("trade_win_rate_pct"), rate(net < -edge).alias("loss_rate_pct"),
        rate(net <= c.large_loss_pct).alias("large_loss_frequency_pct"), gross.alias("gross_pnl"), pnl.alias("net_pnl"), F.sum("estimated_cost").alias("estimated_costs"), F.when(gross > 0, 100.0 * F.sum("estimated_cost") / gross).alias("fraction_gross_alpha_consumed_by_costs_pct"),
        F.min("capacity_notional").alias("minimum_trade_capacity"), F.countDistinct("signal_ts").alias("independent_event_count"),
        F.when(F.sum(F.when(net < 0, -net)) > 0, F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0.0)) / F.sum(F.when(net < 0, -net))).alias("profit_factor"),
    )
    medians = {"median_net_trade_return_pct": (net, 0.5), "median_trade_capacity": ("capacity_notional", 0.5), "median_filled_notional": ("filled_notional", 0.5)}
    return joined(out, quantiles(costed, list(keys), medians), list(keys))


def stress_matrix(trades: DataFrame, c: ExecutionConfig) -> DataFrame:
    """Trades, expectancy and result of every capital, delay and cost."""
    return trade_money_metrics(with_costs(trades, c.costs_bps), c).select("capital", "delay", "cost_bps", "trades", "net_expected_value_pct", "net_pnl")


SCENARIO = ("capital", "delay")


def holdings(trades: DataFrame, bars: DataFrame, step_minutes: int = 1, keys=SCENARIO) -> DataFrame:
    """What each scenario holds of each symbol at each bar's instant while anything is open, and the bar's close.

    Entries and exits are deltas of units and cost; their running sums within a symbol's day hold until
    the next delta. So trades of one symbol at one instant are one row, whatever they are and cost;
    mark * units - cost is their open profit. ``trades`` are the accepted ones; entries and exits stand on bars.
    """
    notional = F.col("filled_notional") * F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    delta = lambda ts, f: F.struct(F.col(ts).alias("ts"), (f * notional / F.col("entry_price")).alias("units"), (f * notional).alias("cost"), (f * F.col("filled_notional")).alias("gross"), F.lit(int(f)).alias("open"))
    part = [*keys, "trade_date", "symbol"]
    deltas = trades.select(*part, F.explode(F.array(delta("entry_ts", 1.0), delta("exit_ts", -1.0))).alias("d")).select(*part, "d.*")
    at = deltas.groupBy(*part, "ts").agg(*[F.sum(x).alias(x) for x in ("units", "cost", "gross", "open")])
    w = Window.partitionBy(*part).orderBy("ts")
    spans = at.select(*part, "ts", F.lead("ts").over(w).alias("until"), *[F.sum(x).over(w).alias(x) for x in ("units", "cost", "gross", "open")]).where("open > 0")
    instants = F.explode(F.expr(f"sequence(ts, until - INTERVAL '{step_minutes}' MINUTE, INTERVAL '{step_minutes}' MINUTE)")).alias("ts")
    held = spans.select(*part, instants, "units", "cost", "gross", "open")
    return held.join(bars.select("symbol", F.col("bar_ts").alias("ts"), F.col("close").alias("mark")), ["symbol", "ts"], "left")


def equity_curve(trades: DataFrame, bars: DataFrame, costs, step_minutes: int = 1, keys=SCENARIO) -> DataFrame:
    """Realised and open profit, exposure and number of positions at each instant of each scenario and cost.

    Realised profit is linear in the cost, open profit and exposure do not depend on it: everything is
    worked out once for all costs. Realised profit is summed within days, then over days, so no task
    sorts a whole history. ``trades`` are read twice.
    """
    done = trades.where("accepted")
    day = [*keys, "trade_date"]
    held = holdings(done, bars, step_minutes, keys)
    nothing = lambda *names: [F.lit(0.0).alias(n) for n in names]
    now = held.select(*day, "ts", F.coalesce(F.col("mark") * F.col("units") - F.col("cost"), F.lit(0.0)).alias("open_pnl"), F.col("gross").alias("gross_exposure"), F.col("cost").alias("net_exposure"), F.col("open").alias("open_positions"), *nothing("gain", "spent"))
    out = done.select(*day, F.col("exit_ts").alias("ts"), *nothing("open_pnl", "gross_exposure", "net_exposure"), F.lit(0).cast("long").alias("open_positions"), (F.col("filled_notional") * F.col("gross_return_pct") / 100).alias("gain"), (F.col("filled_notional") / 10_000).alias("spent"))
    sums = ("open_pnl", "gross_exposure", "net_exposure", "open_positions", "gain", "spent")
    both = now.unionByName(out).groupBy(*day, "ts").agg(*[F.sum(c).alias(c) for c in sums])
    inside = Window.partitionBy(*day).orderBy("ts")
    both = both.withColumns({c: F.sum(c).over(inside) for c in ("gain", "spent")})
    ends = both.groupBy(*day).agg(F.max_by("gain", "ts").alias("day_gain"), F.max_by("spent", "ts").alias("day_spent"))
    before = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    ends = ends.select(*day, *[F.coalesce(F.sum(f"day_{c}").over(before), F.lit(0.0)).alias(f"day_{c}") for c in ("gain", "spent")])
    whole = both.join(ends, day).withColumn("cost_bps", F.explode(F.array(*[F.lit(float(x)) for x in costs])))
    realised = F.col("day_gain") + F.col("gain") - F.col("cost_bps") * (F.col("day_spent") + F.col("spent"))
    return whole.select(*day, "ts", "cost_bps", "open_pnl", "gross_exposure", "net_exposure", "open_positions", realised.alias("realised_pnl")).withColumn("equity", F.col("capital") + F.col("realised_pnl") + F.col("open_pnl"))


def with_drawdown(equity: DataFrame, keys=("capital", "delay", "cost_bps")) -> DataFrame:
    """Running peak and percent below it, within days and over the peaks of earlier days."""
    day = equity.groupBy(*keys, "trade_date").agg(F.max("equity").alias("top"))
    w = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    day = day.select(*keys, "trade_date", F.max("top").over(w).alias("earlier"))
    inside = Window.partitionBy(*keys, "trade_date").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = equity.join(day, [*keys, "trade_date"]).withColumn("peak", F.greatest(F.max("equity").over(inside), F.col("earlier"), F.col("capital")))
    return out.withColumn("drawdown_pct", (F.col("equity") / F.col("peak") - 1) * 100).drop("earlier")


def daily_portfolio(equity: DataFrame, costed: DataFrame, keys=("capital", "delay", "cost_bps")) -> DataFrame:
    """End equity, return on the end before, turnover, costs, peak exposure and worst drawdown of each day."""
    e = with_drawdown(equity, keys).groupBy(*keys, "trade_date").agg(F.max_by("equity", "ts").alias("end_equity"), F.max("gross_exposure").alias("peak_gross_exposure"), F.max("open_positions").alias("peak_positions"), F.min("drawdown_pct").alias("worst_drawdown_pct"))
    t = costed.groupBy(*keys, "trade_date").agg(F.count("*").alias("trades"), (2 * F.sum("filled_notional")).alias("turnover"), F.sum("estimated_cost").alias("costs"))
    before = F.coalesce(F.lag("end_equity").over(Window.partitionBy(*keys).orderBy("trade_date")), F.col("capital"))
    return e.withColumn("return_pct", (F.col("end_equity") / before - 1) * 100).join(t, [*keys, "trade_date"], "left")


def scorecard(df: DataFrame, stage: str = "research", mode: str = "development", max_drawdown_pct: float = 20.0) -> DataFrame:
    """Pass or fail on economics, execution, risk, concentration and credibility, and the class that follows.

    Needs net_expected_value_pct, profit_factor, average_return_per_market_day_pct, stress_30_0, stress_base_1,
    stress_base_2, stress_base_5, maximum_drawdown_pct, top_10pct_return_share_pct, independent_event_count, trades, chronology_pass.
    """
    z = lambda c, d=0.0: F.coalesce(F.col(c), F.lit(d))
    up = lambda c: z(c, -1.0) > 0
    df = df.withColumns(
        {
            "economic_quality_pass": (z("net_expected_value_pct") > 0) & (z("profit_factor") > 1) & (z("average_return_per_market_day_pct") > 0),
            "execution_quality_pass": up("stress_30_0") & up("stress_base_1") & up("stress_base_2"),
            "five_minute_delay_positive": up("stress_base_5"),
            "risk_quality_pass": F.coalesce(F.col("maximum_drawdown_pct") >= -abs(max_drawdown_pct), F.lit(False)),
            "return_concentration_pass": F.coalesce(F.col("top_10pct_return_share_pct") <= 150, F.lit(True)),
            "statistical_credibility_pass": (z("independent_event_count") >= 30) & (z("trades") >= 100),
        }
    )
    all_four = F.expr("execution_quality_pass AND risk_quality_pass AND statistical_credibility_pass AND chronology_pass")
    best = "deployment_candidate" if mode == "sealed" else "out_of_sample_validated" if stage in ("validation", "research_confirmation") else "statistically_credible"
    return df.withColumn("classification", F.when(~F.col("economic_quality_pass"), "exploratory").when(~all_four, "promising").otherwise(best))


def chronology(runs: DataFrame, config_hash: str, required: tuple[str, ...]) -> DataFrame:
    """Required stages without a completed, positive run of the same configuration: none means the gate is open."""
    stages = runs.sparkSession.createDataFrame([(s,) for s in required], "stage string")
    passed = runs.where((F.col("status") == "completed") & (F.col("config_hash") == config_hash) & (F.col("net_expected_value_pct") > 0)).select("stage").distinct()
    return stages.join(passed, "stage", "left_anti")
