"""Screening of rule groups: sampled outcomes, mergeable statistics, gates, scores and significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rules import ALL_FAMILIES, group_key
from tidemark.operators.selection import joined

BUCKETS = 1024
HIST_LEAST, HIST_MOST = -200, 200
#: Abramowitz and Stegun's rational approximation 7.1.26 of the error function.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def symbol_bucket(symbol: Column, buckets: int = BUCKETS) -> Column:
    return (F.conv(F.substring(F.md5(symbol), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def bucket_ranges(n: int, buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """Contiguous half-open ranges that cover all buckets."""
    edges = [i * buckets // n for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


def on_entry_grid(minute: Column, stride: int, anchor: int = 570) -> Column:
    """Whether a minute is on the grid of entries; stride 1 takes all."""
    return F.lit(True) if stride == 1 else (minute - anchor) % stride == 0


def has_outcome(horizons) -> Column:
    return F.coalesce(*[F.col(f"fwd_return_{h}m_pct") for h in horizons]).isNotNull()


def signed_outcome(direction: Column, forward: Column, cost_bps: float) -> tuple[Column, Column]:
    """Gross and net percent of a position; the cost of the round trip is taken off once."""
    gross = F.when(direction == "long", forward).otherwise(-forward)
    return gross, gross - cost_bps / 100.0


def hist_bin(net: Column) -> Column:
    """Outcome bin of a tenth of a percent; the ends take all beyond them."""
    return F.greatest(F.lit(HIST_LEAST), F.least(F.lit(HIST_MOST), F.floor(net * 10))).cast("int")


def group_outcomes(states: DataFrame, families=tuple(ALL_FAMILIES), directions=("long", "short"), horizons=(5,), cost_bps: float = 20.0, anchor: int = 570, overlapping: bool = False) -> DataFrame:
    """One row for each family, direction, horizon and eligible state with an outcome.

    One scan serves all families: a state turns into the array of its groups, exploded once. A group
    needs all its dimensions; entries stand on the grid of the horizon unless they may overlap.
    """
    groups = []
    for f in families:
        dims, condition = ALL_FAMILIES[f]
        whole = F.expr(f"({condition})")
        for d in dims:
            whole = whole & F.col(d).isNotNull()
        groups.append(F.when(whole, F.struct(F.lit(f).alias("family"), group_key(dims).alias("group_key"))))
    base = states.withColumn("g", F.explode(F.array_compact(F.array(*groups))))
    outcomes = F.array(
        *[
            F.when(on_entry_grid(F.col("minute_of_day"), 1 if overlapping else h, anchor) & F.col(f"fwd_return_{h}m_pct").isNotNull(), F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_return_{h}m_pct").alias("forward")))
            for h in horizons
        ]
    )
    rows = base.select("symbol", "trade_date", "bar_ts", "g.family", "g.group_key", F.explode(F.array_compact(outcomes)).alias("o"))
    rows = rows.withColumn("direction", F.explode(F.array(*[F.lit(d) for d in directions])))
    gross, net = signed_outcome(F.col("direction"), F.col("o.forward"), cost_bps)
    return rows.select("family", "direction", F.col("o.horizon").alias("horizon"), "group_key", "symbol", "trade_date", "bar_ts", gross.alias("gross"), net.alias("net"))


GROUP = ("family", "direction", "horizon", "group_key")


def group_stats(outcomes: DataFrame, keys=GROUP) -> DataFrame:
    """Mergeable sums of each group."""
    net = F.col("net")
    return outcomes.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.sum("gross").alias("gross_sum"), F.sum("net").alias("net_sum"), F.sum(net * net).alias("net_sum_squares"), F.count_if(net > 0).alias("wins"),
        F.sum(F.when(net > 0, net).otherwise(0.0)).alias("positive_sum"), F.sum(F.when(net < 0, -net).otherwise(0.0)).alias("negative_sum_abs"), F.min("net").alias("worst_pct"), F.max("net").alias("best_pct"),
    )


def merge_stats(parts: DataFrame, keys=GROUP) -> DataFrame:
    """The sums of groups over all their parts."""
    added = ("observations", "gross_sum", "net_sum", "net_sum_squares", "wins", "positive_sum", "negative_sum_abs")
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in added], F.min("worst_pct").alias("worst_pct"), F.max("best_pct").alias("best_pct"))


def group_hist(outcomes: DataFrame, keys=GROUP) -> DataFrame:
    """How many outcomes of each group fall in each bin."""
    return outcomes.groupBy(*keys, hist_bin(F.col("net")).alias("bin")).agg(F.count("*").alias("n"))


def group_concentration(outcomes: DataFrame, keys=GROUP) -> DataFrame:
    """Distinct symbols and dates and the largest share of each, by two-level counts."""
    out = None
    for column, many, share in (("symbol", "symbols", "max_symbol_share_pct"), ("trade_date", "dates", "max_date_share_pct")):
        part = outcomes.groupBy(*keys, column).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.count("*").alias(many), (100.0 * F.max("n") / F.sum("n")).alias(share))
        out = part if out is None else out.join(part, list(keys))
    return out


def hist_quantiles(hist: DataFrame, qs: dict[str, float], keys=GROUP) -> DataFrame:
    """Quantiles from bins: the middle of the first bin that reaches ceil(q n) outcomes; the end bins give their edge."""
    w = Window.partitionBy(*keys)
    seen = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    h = hist.withColumns({"seen": seen, "total": F.sum("n").over(w)})
    value = F.when(F.col("b") <= HIST_LEAST, HIST_LEAST / 10.0).when(F.col("b") >= HIST_MOST, HIST_MOST / 10.0).otherwise((F.col("b") + 0.5) / 10.0)
    out = h.groupBy(*keys).agg(*[F.min(F.when(F.col("seen") >= F.greatest(F.lit(1), F.ceil(q * F.col("total"))), F.col("bin"))).alias(n) for n, q in qs.items()])
    for n in qs:
        out = out.withColumn("b", F.col(n)).withColumn(n, value)
    return out.drop("b")


QUANTILES = {"p05_pct": 0.05, "p25_pct": 0.25, "median_pct": 0.5, "p75_pct": 0.75, "p95_pct": 0.95}


def finalise_stats(stats: DataFrame) -> DataFrame:
    """Means, sample deviation, t, win rate and profit factor from the sums; null where undefined."""
    n = F.col("observations")
    variance = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("net_sum_squares") - F.col("net_sum") * F.col("net_sum") / n) / (n - 1)))
    out = stats.withColumns(
        {"gross_avg_pct": F.col("gross_sum") / n, "net_avg_pct": F.col("net_sum") / n, "win_rate_pct": 100.0 * F.col("wins") / n, "stdev_pct": F.sqrt(variance), "profit_factor": F.when(F.col("negative_sum_abs") > 0, F.col("positive_sum") / F.col("negative_sum_abs"))}
    )
    return out.withColumn("t_stat", F.when(F.col("stdev_pct") > 1e-9, F.col("net_avg_pct") / F.col("stdev_pct") * F.sqrt(n)))


def _quantile(hist: str, total: str, q: float) -> Column:
    """The middle of the first of the sorted bins (bin, n) that reaches ceil(q n) outcomes; the end bins give their edge."""
    value = f"CASE WHEN s.at <= {HIST_LEAST} THEN {HIST_LEAST / 10.0}D WHEN s.at >= {HIST_MOST} THEN {HIST_MOST / 10.0}D ELSE (s.at + 0.5D) / 10.0D END"
    step = f"named_struct('seen', s.seen + x.n, 'at', coalesce(s.at, CASE WHEN s.seen + x.n >= greatest(1, ceil({q}D * {total})) THEN x.bin END))"
    return F.expr(f"aggregate({hist}, named_struct('seen', 0L, 'at', CAST(NULL AS INT)), (s, x) -> {step}, s -> {value})")


def screen(outcomes: DataFrame, keys=GROUP) -> DataFrame:
    """All statistics of each group, from one pass over the outcomes.

    Sums are taken by symbol, by date and by bin at once (grouping sets); a group's own row follows from
    those: a histogram has a bounded number of bins.
    """
    rows = outcomes.select(*keys, "symbol", "trade_date", hist_bin(F.col("net")).alias("bin"), "gross", "net")
    parts = ("symbol", "trade_date", "bin")
    net = F.col("net")
    sums = (
        F.count("*").alias("n"), F.sum("gross").alias("gross_sum"), F.sum("net").alias("net_sum"), F.sum(net * net).alias("net_sum_squares"), F.count_if(net > 0).alias("wins"), F.sum(F.when(net > 0, net).otherwise(0.0)).alias("positive_sum"),
        F.sum(F.when(net < 0, -net).otherwise(0.0)).alias("negative_sum_abs"), F.min("net").alias("worst_pct"), F.max("net").alias("best_pct"), F.grouping_id().alias("_g"),
    )
    columns = [F.col(c) for c in (*keys, *parts)]
    cut = rows.groupingSets([[*columns[: len(keys)], F.col(p)] for p in parts], *columns).agg(*sums)
    of = {p: F.col("_g") == 7 - (4 >> i) for i, p in enumerate(parts)}
    only = lambda p, c: F.when(of[p], F.col(c))
    added = ("gross_sum", "net_sum", "net_sum_squares", "wins", "positive_sum", "negative_sum_abs")
    shares = [x for p, many, share in (("symbol", "symbols", "max_symbol_share_pct"), ("trade_date", "dates", "max_date_share_pct")) for x in (F.count_if(of[p]).alias(many), (100.0 * F.max(only(p, "n")) / F.sum(only(p, "n"))).alias(share))]
    hist = F.sort_array(F.collect_list(F.when(of["bin"], F.struct("bin", "n")))).alias("_hist")
    out = cut.groupBy(*keys).agg(F.sum(only("bin", "n")).alias("observations"), *[F.sum(only("bin", c)).alias(c) for c in added], F.min(only("bin", "worst_pct")).alias("worst_pct"), F.max(only("bin", "best_pct")).alias("best_pct"), *shares, hist)
    return finalise_stats(out).withColumns({n: _quantile("_hist", "observations", q) for n, q in QUANTILES.items()}).drop("_hist")


#: A cell is a whole number: the family above, four bits for each of its dimensions (no dimension has more bins).
_BITS, _DIMS = 4, 6


def cells(families=tuple(ALL_FAMILIES)) -> Column:
    """The array of a state's groups, one for each family whose filter it passes and whose dimensions it has."""
    out = []
    for i, f in enumerate(families):
        dims, condition = ALL_FAMILIES[f]
        code = str(i)
        for k in range(_DIMS):
            code = f"({code} * {1 << _BITS} + {dims[k] if k < len(dims) else 0})"
        out.append(f"CASE WHEN {condition} THEN {code} END")  # null without all dimensions
    return F.expr(f"array_compact(array({', '.join(out)}))")


def cell_names(cell: str, families=tuple(ALL_FAMILIES)) -> tuple[Column, Column]:
    """Family and group key of a cell."""
    place = f"shiftright({cell}, {_BITS * _DIMS}) + 1"
    pick = lambda values: f"element_at(array({', '.join(values)}), {place})"
    family = pick([f"'{f}'" for f in families])
    many = pick([str(len(ALL_FAMILIES[f][0])) for f in families])
    bins = ", ".join(f"CAST(shiftright({cell}, {_BITS * (_DIMS - 1 - k)}) & {(1 << _BITS) - 1} AS STRING)" for k in range(_DIMS))
    return F.expr(family), F.expr(f"array_join(slice(array({bins}), 1, {many}), '|')")


def screen_states(states: DataFrame, families=tuple(ALL_FAMILIES), directions=("long", "short"), horizons=(5,), cost_bps: float = 20.0, anchor: int = 570, overlapping: bool = False) -> DataFrame:
    """What ``screen`` says of ``group_outcomes``, without a row for each direction and without text keys.

    A state turns into the whole numbers of its groups. Long and short outcomes are mirror images, so both
    are summed side by side, and counted by the pair of their bins (both are steps of the same return: no
    more than twice as many pairs as bins). Names, directions and quantiles are worked out for groups only.
    """
    c = repr(cost_bps / 100.0) + "D"
    due = lambda h: ("" if overlapping else f"(minute_of_day - {anchor}) % {h} = 0 AND ") + f"fwd_return_{h}m_pct IS NOT NULL"
    returns = ", ".join(f"CASE WHEN {due(h)} THEN named_struct('horizon', {h}, 'forward', fwd_return_{h}m_pct) END" for h in horizons)
    some = states.select("symbol", "trade_date", cells(families).alias("cells"), F.expr(f"array_compact(array({returns}))").alias("returns")).where("size(cells) > 0 AND size(returns) > 0")
    width = HIST_MOST - HIST_LEAST + 1
    bin_of = lambda x: f"CAST(greatest({HIST_LEAST}, least({HIST_MOST}, floor(({x}) * 10))) AS INT)"
    net = {"long": f"forward - {c}", "short": f"-forward - {c}"}
    pair = f"({bin_of(net['long'])} - {HIST_LEAST}) * {width} + {bin_of(net['short'])} - {HIST_LEAST} AS pair"
    rows = some.selectExpr("symbol", "trade_date", "cells", "inline(returns)").selectExpr("symbol", "trade_date", "horizon", "forward", pair, "cells").selectExpr("explode(cells) AS cell", "horizon", "symbol", "trade_date", "pair", "forward")

    sums = ["count(*) AS n", "sum(forward) AS forward_sum", "min(forward) AS least", "max(forward) AS most"]
    for d in directions:
        x = net[d]
        sums += [f"sum({x}) AS {d}_net_sum", f"sum(({x}) * ({x})) AS {d}_net_sum_squares", f"count_if({x} > 0) AS {d}_wins", f"sum(CASE WHEN {x} > 0 THEN {x} ELSE 0D END) AS {d}_positive_sum", f"sum(CASE WHEN {x} < 0 THEN -({x}) ELSE 0D END) AS {d}_negative_sum_abs"]
    parts, keys = ("symbol", "trade_date", "pair"), ("cell", "horizon")
    cut = rows.groupingSets([[*map(F.col, keys), F.col(p)] for p in parts], *map(F.col, (*keys, *parts))).agg(*map(F.expr, sums), F.grouping_id().alias("_g"))
    only = lambda p, name: f"CASE WHEN _g = {7 - (4 >> parts.index(p))} THEN {name} END"
    shares = [x for p, many, share in (("symbol", "symbols", "max_symbol_share_pct"), ("trade_date", "dates", "max_date_share_pct")) for x in (f"count({only(p, '1')}) AS {many}", f"100.0D * max({only(p, 'n')}) / sum({only(p, 'n')}) AS {share}")]
    added = ("net_sum", "net_sum_squares", "wins", "positive_sum", "negative_sum_abs")
    bins = {"long": f"CAST(floor(pair / {width}) + {HIST_LEAST} AS INT)", "short": f"CAST(pair % {width} + {HIST_LEAST} AS INT)"}
    hist = lambda d: "sort_array(collect_list(" + only("pair", f"named_struct('bin', {bins[d]}, 'n', n)") + f")) AS {d}_hist"
    own = [f"sum({only('pair', f'{d}_{x}')}) AS {d}_{x}" for d in directions for x in added]
    whole = cut.groupBy(*keys).agg(*map(F.expr, [f"sum({only('pair', 'n')}) AS observations", f"sum({only('pair', 'forward_sum')}) AS forward_sum", f"min({only('pair', 'least')}) AS least", f"max({only('pair', 'most')}) AS most", *shares, *own, *map(hist, directions)]))

    def side(d: str) -> Column:
        low, high, sign = ("least", "most", "") if d == "long" else ("most", "least", "-")
        ends = [f"'{d}' AS direction", f"{sign}forward_sum AS gross_sum", *[f"{d}_{x} AS {x}" for x in added], f"{sign}{low} - {c} AS worst_pct", f"{sign}{high} - {c} AS best_pct"]
        return F.struct(*map(F.expr, ends), *[_quantile(f"{d}_hist", "observations", q).alias(n) for n, q in QUANTILES.items()])

    family, key = cell_names("cell", families)
    out = whole.select(family.alias("family"), "horizon", key.alias("group_key"), "observations", "symbols", "max_symbol_share_pct", "dates", "max_date_share_pct", F.explode(F.array(*[side(d) for d in directions])).alias("side"))
    return finalise_stats(out.select("*", "side.*").drop("side"))


def join_validation(found: DataFrame, valid: DataFrame, keys=GROUP) -> DataFrame:
    """Groups with the same group's statistics in the validation period; none there counts as nothing observed."""
    columns = ("observations", "net_avg_pct", "profit_factor", "median_pct", "t_stat")
    v = valid.select(*keys, *[F.col(c).alias(f"v_{c}") for c in columns])
    out = found.join(v, list(keys), "left")
    return out.withColumns({"v_observations": F.coalesce("v_observations", F.lit(0)), "v_net_avg_pct": F.coalesce("v_net_avg_pct", F.lit(0.0))})


def select_rules(stats: DataFrame, per_family: int = 20, observations: int = 100, symbols: int = 10, dates: int = 10, symbol_share: float = 20.0, date_share: float = 25.0, score: str = "score") -> DataFrame:
    """Gates on size, concentration and sign, then the best of each family."""
    gate = (F.col("observations") >= observations) & (F.col("symbols") >= symbols) & (F.col("dates") >= dates) & (F.col("max_symbol_share_pct") <= symbol_share) & (F.col("max_date_share_pct") <= date_share) & (F.col("net_avg_pct") > 0)
    w = Window.partitionBy("family").orderBy(F.col(score).desc(), "direction", "horizon", "group_key")
    return stats.where(gate).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_family)


def _z(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _concentration() -> Column:
    spread = lambda c: F.greatest(F.lit(0.05), 1 - _z(c, 100.0) / 100)
    return spread("max_symbol_share_pct") * spread("max_date_share_pct")


def _stability() -> Column:
    d, v = F.col("net_avg_pct"), _z("v_net_avg_pct")
    return 1 - F.least(F.abs(d - v) / F.greatest(F.abs(d), F.abs(v), F.lit(0.01)), F.lit(1.0))


def rank_score_legacy(df: DataFrame, validated: bool = True) -> DataFrame:
    """Mean return times t, weighed by size and concentration. Needs the validation columns if ``validated``."""
    s = F.col("net_avg_pct") * F.log1p(F.col("observations")) * F.greatest(F.lit(0.25), F.greatest(_z("t_stat"), F.lit(0.0))) * _concentration()
    if validated:
        kept = (0.5 + 0.5 * _stability()) * F.least(F.lit(1.5), F.greatest(F.lit(0.25), _z("v_t_stat")))
        s = s * F.when(_z("v_net_avg_pct") <= 0, 0.1).otherwise(kept)
    return df.withColumn("legacy_score", s)


def rank_score(df: DataFrame, validated: bool = True) -> DataFrame:
    """Economic score: expectancy weighed by payoff, median, left tail, credibility and concentration, not by win rate."""
    net, pf = F.greatest(_z("net_avg_pct"), F.lit(0.0)), _z("profit_factor", 1.0)
    pf = F.when(pf == 0, 1.0).otherwise(pf)
    fall = lambda c, weight: 1 / (1 + weight * F.greatest(F.lit(0.0), -_z(c)) / F.greatest(net, F.lit(0.05)))
    s = net * F.log1p(_z("observations")) * F.sqrt(F.least(F.lit(4.0), F.greatest(F.lit(0.25), pf)))
    s = s * (1 + 0.20 * F.tanh(_z("median_pct") / F.greatest(net, F.lit(0.10)))) * fall("p05_pct", 0.08) * fall("worst_pct", 0.015)
    s = s * (0.80 + 0.20 * F.tanh(F.greatest(_z("t_stat"), F.lit(0.0)) / 2)) * _concentration()
    if validated:
        v_pf = F.when(_z("v_profit_factor") == 0, 1.0).otherwise(_z("v_profit_factor", 1.0))
        payoff = F.sqrt(F.least(F.lit(3.0), F.greatest(F.lit(0.50), v_pf))) / F.sqrt(F.lit(1.5))
        middle = 1 + 0.15 * F.tanh(_z("v_median_pct") / F.greatest(F.abs(_z("v_net_avg_pct")), F.lit(0.10)))
        s = s * F.when(_z("v_net_avg_pct") <= 0, 0.20).otherwise((0.55 + 0.45 * _stability()) * payoff * middle)
    return df.withColumn("score", F.when(net <= 0, 0.0).otherwise(s))


def erfc(x: Column) -> Column:
    """The complementary error function of a non-negative column, within 1.5e-7."""
    t = 1 / (1 + ERF_P * x)
    a1, a2, a3, a4, a5 = ERF_A
    return t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5)))) * F.exp(-x * x)


def with_tests(df: DataFrame) -> DataFrame:
    """``df`` (read twice) with its number of rows, ``tests``: one number that goes to every task."""
    return joined(df, F.broadcast(df.agg(F.count("*").alias("tests"))), [])


def adjusted_p(df: DataFrame, tests: int | Column) -> DataFrame:
    """Bonferroni-adjusted two-sided p of the t statistic; 1 without one."""
    tests = F.lit(tests) if isinstance(tests, int) else tests
    raw = F.when(F.col("t_stat").isNull(), 1.0).otherwise(erfc(F.abs("t_stat") / F.sqrt(F.lit(2.0))))
    return df.withColumn("adjusted_p", F.least(F.lit(1.0), raw * F.greatest(tests, F.lit(1))))


def discovery_status(df: DataFrame, validated: bool = True) -> DataFrame:
    good = (_z("v_net_avg_pct") > 0) & (_z("v_profit_factor") > 1) & (F.col("adjusted_p") <= 0.10) if validated else F.lit(False)
    return df.withColumn("status", F.when(good, "PROGRESS_TO_FORMAL_VALIDATION").when(F.col("adjusted_p") <= 0.10, "PROMISING").otherwise("WEAK"))


def holdout_stats(samples: DataFrame, conditions: Column, direction: str, horizon: int, start, end, cost_bps: float = 20.0) -> DataFrame:
    """One row: a frozen rule's statistics over a period; zeros and nulls when nothing matches."""
    rows = samples.where(conditions & F.col("trade_date").between(start, end) & on_entry_grid(F.col("minute_of_day"), horizon) & F.col(f"fwd_return_{horizon}m_pct").isNotNull())
    gross, net = signed_outcome(F.lit(direction), F.col(f"fwd_return_{horizon}m_pct"), cost_bps)
    rows = rows.select("symbol", "trade_date", gross.alias("gross"), net.alias("net"), F.lit(1).alias("rule"))
    one = samples.sparkSession.range(1).select(F.lit(1).alias("rule"))
    return one.join(screen(rows, ("rule",)), "rule", "left").withColumn("observations", F.coalesce("observations", F.lit(0).cast("long")))
