"""Invariants and hand-made cases of the bar engine."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import discovery as do
from tidemark.operators import economics as eo
from tidemark.operators import execution as xo
from tidemark.operators import features as fo
from tidemark.operators import robustness as bo
from tidemark.operators import rules as ro
from tidemark.operators import states as so
from tidemark.operators import universe as uo
from tidemark.plans import registry
from tidemark.sources import sinks

MINUTE = dt.timedelta(minutes=1)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bars(spark):
    """Two symbols on four weekdays, 90 one-minute bars, one left out."""
    rows = []
    for d, day in enumerate((1, 2, 3, 4)):
        for symbol, base in (("AAA", 100.0), ("BBB", 60.0)):
            for m in range(90):
                if symbol == "AAA" and day == 2 and m == 40:
                    continue
                px = base + 0.1 * d + 0.01 * m
                ts = dt.datetime(2026, 6, day, 9, 30) + m * MINUTE
                rows.append((symbol, ts, ts.date(), 570 + m, day, "regular", px - 0.005, px + 0.015, px - 0.015, px, px, 10_000 + 10 * m, 100 + m))
    names = "symbol string, bar_ts timestamp_ntz, trade_date date, minute_of_day int, weekday_iso int, session_label string, open double, high double, low double, close double, vwap double, volume long, trade_count long"
    return spark.createDataFrame(rows, names).withColumn("liquidity_tier", F.lit("A")).cache()


@pytest.fixture(scope="module")
def features(bars):
    return fo.build_features(bars, fo.FeatureConfig(baseline_days=2)).cache()


def test_a_gap_inside_the_span_makes_returns_null(features):
    rows = {r.minute_of_day: r for r in features.where("symbol = 'AAA' AND trade_date = DATE '2026-06-02'").collect()}
    assert rows[609].ret_5m_pct is not None and rows[611].ret_5m_pct is None and rows[615].ret_5m_pct is None and rows[616].ret_5m_pct is not None
    assert rows[608].fwd_return_5m_pct is None and rows[604].fwd_return_5m_pct is not None


def test_no_feature_looks_ahead(bars):
    """Features of a prefix are those of the whole; only labels may differ."""
    cut = bars.where("minute_of_day < 620 OR trade_date < DATE '2026-06-04'")
    labels = [c for c in fo.build_features(bars.limit(1)).columns if c.startswith(("fwd_", "future_"))]
    config = fo.FeatureConfig(baseline_days=2)
    whole = fo.build_features(bars, config).where("trade_date = DATE '2026-06-04' AND minute_of_day < 620").drop(*labels)
    part = fo.build_features(cut, config).where("trade_date = DATE '2026-06-04'").drop(*labels)
    assert whole.count() == 100 and whole.exceptAll(part).count() == 0 and part.exceptAll(whole).count() == 0


def test_bins_meet_and_null_has_none(spark):
    for name, (column, edges) in so.EDGES.items():
        values = [None, *sorted({float(e) + d for e in edges for d in (-1e-6, 0.0)})]
        got = [r[0] for r in spark.createDataFrame([(v,) for v in values], f"{column} double").select(so.bin_column(name)).collect()]
        assert got[0] is None and got[1:] == sorted(got[1:]) and got[1] == 0 and got[-1] == len(edges), name


def test_merged_statistics_equal_those_of_all(spark, features):
    rows = do.group_outcomes(so.bin_state(so.enrich(features)), ("time_of_day",), horizons=(5, 15))
    assert rows.count() > 0
    merged = do.merge_stats(do.group_stats(rows, ("trade_date", *do.GROUP)))
    a = {tuple(r[:4]): r for r in merged.collect()}
    for r in do.group_stats(rows).collect():
        assert a[tuple(r[:4])].observations == r.observations and abs(a[tuple(r[:4])].net_sum - r.net_sum) < 1e-9


def test_histogram_quantile(spark):
    h = spark.createDataFrame([("g", -2, 1), ("g", 0, 2), ("g", 5, 1)], "g string, bin int, n long")
    assert do.hist_quantiles(h, {"q": 0.5}, ("g",)).first()["q"] == 0.05


def test_perturbed_thresholds():
    p = lambda c, mode: ro.perturb([{"column": "ret_5m_pct", **c}], 10, mode)[0]
    assert p({"operator": "abs_gte", "value": 1.0}, "relaxed")["value"] == pytest.approx(0.9)
    assert p({"operator": "gte", "value": 3.0}, "relaxed")["value"] == pytest.approx(2.7)
    assert p({"operator": "gte", "value": 3.0}, "tightened")["value"] == pytest.approx(3.3)
    assert p({"operator": "lte", "value": -3.0}, "relaxed")["value"] == pytest.approx(-2.7)
    with pytest.raises(ValueError):
        ro.condition({"column": "ret_5m_pct", "operator": "range"})
    with pytest.raises(ValueError):
        ro.condition({"column": "secret", "operator": "gt", "value": 1})


def test_market_calendar_knows_daylight_saving(spark):
    for day, utc in (("2026-02-02", "2026-02-02 05:00:00"), ("2026-06-02", "2026-06-02 04:00:00")):
        low, _ = cal.market_date_bounds(day, day)
        assert str(spark.range(1).select(low).first()[0]) == utc


def test_interval_coverage(spark):
    rows = [("whole", "2024-01-01", "2024-01-10"), ("whole", "2024-01-11", "2024-01-31"), ("gap", "2024-01-01", "2024-01-10"), ("gap", "2024-01-12", "2024-01-31"), ("over", "2024-01-01", "2024-01-20"), ("over", "2024-01-05", "2024-02-20")]
    r = spark.createDataFrame(rows, "k string, a string, b string").selectExpr("k", "to_date(a) AS range_start", "to_date(b) AS range_end")
    assert {x.k: x.covered for x in uo.covers_range(r, ("k",), "2024-01-01", "2024-01-31").collect()} == {"whole": True, "gap": False, "over": True}


def test_uncovered_ranges_are_those_of_days(spark):
    """Overlapping, touching, nested, repeated and very long ranges, keys of one side only and no key at all."""
    rng, first = random.Random(5), dt.date(2024, 1, 1)
    some = lambda n, keys: [(rng.choice(keys), first + dt.timedelta(a), first + dt.timedelta(a + rng.randrange(0, 12))) for a in (rng.randrange(0, 90) for _ in range(n))]
    planned, covered = some(120, [1, 2, 3, None]) * 2, some(60, [1, 2, None, 4])
    planned += [(5, first, first), (7, first, dt.date(2024, 3, 1))]
    covered += [(7, dt.date(2024, 2, 1), dt.date(2024, 2, 1)), (8, first, first)]
    days = lambda rows: {(k, a + dt.timedelta(i)) for k, a, b in rows for i in range((b - a).days + 1)}
    left = days(planned) - days(covered)
    starts = {(k, d) for k, d in left if (k, d - dt.timedelta(1)) not in left}
    want = set()
    for k, d in starts:
        e = d
        while (k, e + dt.timedelta(1)) in left:
            e += dt.timedelta(1)
        want.add((k, d, e))
    schema = "key long, range_start date, range_end date"
    ages = [(9, dt.date(1, 1, 1), dt.date(9000, 1, 1))] * 3  # spread into days, these would be ten million rows
    got = uo.uncovered(spark.createDataFrame(planned + ages, schema), spark.createDataFrame(covered, schema), "key")
    rows = [tuple(r) for r in got.select("key", "range_start", "range_end").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want | {ages[0]}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan


def test_shortfall_and_compounding(spark):
    obs = spark.createDataFrame([("r", float(x)) for x in (-4, -2, -1, 1, 2, 10)], "rule string, net double")
    assert eo.expected_shortfall(obs, ["rule"]).first()["expected_shortfall_95_pct"] == -4
    daily = spark.createDataFrame([(dt.date(2024, 1, 1), 10.0, 1), (dt.date(2024, 1, 2), -10.0, 1)], "trade_date date, return_pct double, trades int")
    assert eo.risk_ratios(daily).first()["compounded_pct"] == pytest.approx(-1.0)
    ruined = spark.createDataFrame([(dt.date(2024, 1, 1), -100.0, 1), (dt.date(2024, 1, 2), 50.0, 1)], "trade_date date, return_pct double, trades int")
    assert eo.risk_ratios(ruined).first()["compounded_pct"] == -100.0


def test_missing_outcomes_are_counted(spark):
    obs = spark.createDataFrame([("r", 1.0, 0.8), ("r", 2.0, 1.8), ("r", -1.0, -1.2), ("r", None, None)], "rule string, gross_return_pct double, net double").withColumns({"mfe_pct": F.lit(1.0), "mae_pct": F.lit(-1.0)})
    m = bo.obs_metrics(obs, ["rule"]).first()
    assert (m.candidate_signals, m.observations, m.missing_data_rate_pct) == (4, 3, 25.0)


def _plain_allocation(rows, c):
    """What a day accepts, one signal after the other: {(symbol, minute): (reason, fill)}."""
    order = {"symbol": lambda r: (r["at"], r["symbol"]), "liquidity_desc": lambda r: (r["at"], -(r["day"] or 0), r["symbol"]), "signal_strength_desc": lambda r: (r["at"], -abs(r["strength"] or 0), -(r["day"] or 0), r["symbol"])}[c.priority]
    open_now, out = [], {}
    for r in sorted(rows, key=order):
        key, sign = (r["symbol"], r["at"]), 1 if r["direction"] == "long" else -1
        if r["price"] is None or r["end_price"] is None:
            out[key] = ("unavailable_entry_fill" if r["price"] is None else "unavailable_exit_fill", None)
            continue
        open_now = [p for p in open_now if p["until"] > r["at"]]
        if c.one_per_symbol and r["symbol"] in [p["symbol"] for p in open_now]:
            out[key] = ("existing_symbol_position", None)
            continue
        if len(open_now) >= c.max_positions:
            out[key] = ("max_positions", None)
            continue
        capital, desired = r["capital"], r["capital"] * c.position_pct / 100
        caps = [x for x in ((r["bar"] or 0) * c.bar_participation_pct / 100, (r["day"] or 0) * c.daily_participation_pct / 100) if x > 0]
        capacity = min(caps, default=0.0)
        gross, net = sum(p["size"] for p in open_now), sum(p["sign"] * p["size"] for p in open_now)
        size = max(0.0, min(desired, capacity, capital * c.max_symbol_pct / 100, max(0.0, capital * c.max_gross_pct / 100 - gross), max(0.0, capital * c.max_net_pct / 100 - sign * net)))
        reason = None
        if capacity <= 0:
            reason = "liquidity_capacity_unavailable"
        elif not c.allow_partial and size + 1e-9 < desired:
            reason = "partial_fill_not_allowed"
        elif size <= 0 or size / desired < c.min_fill:
            reason = "minimum_fill_fraction"
        else:
            open_now.append({"symbol": r["symbol"], "until": r["at"] + r["minutes"], "sign": sign, "size": size})
        out[key] = (reason, size)
    return out


@pytest.mark.parametrize("partial, priority", [(True, "liquidity_desc"), (False, "symbol"), (True, "signal_strength_desc")])
def test_allocation_follows_a_plain_loop(spark, partial, priority):
    """Long and short signals with ties, missing fills, no capacity and every limit in reach."""
    rng = random.Random(11)
    c = xo.ExecutionConfig(max_positions=4, position_pct=30.0 if partial else 20.0, max_symbol_pct=28.0, max_gross_pct=95.0, max_net_pct=50.0, allow_partial=partial, priority=priority, min_fill=0.3, bar_participation_pct=10.0, daily_participation_pct=1.0)
    scenes, rows = {}, []
    for capital in (1000.0, 50_000.0):
        for delay in (0, 1, 2, 5):
            for day in (2, 3):
                some = {(rng.choice("ABCDEFG"), rng.randrange(0, 60, 3)) for _ in range(60)}
                made = [
                    {"symbol": s, "at": m, "minutes": rng.choice((5, 12, 30)), "direction": rng.choice(("long", "long", "short")), "price": rng.choice((None, 10.0, 10.0, 10.0, 10.0)), "end_price": rng.choice((None, 11.0, 11.0, 11.0, 9.0)),
                     "bar": rng.choice((None, 0.0, 900.0, 5000.0, 1e6, 1e6)), "day": rng.choice((None, 20_000.0, 50_000.0, 1e7, 1e7)), "strength": rng.choice((None, 1.0, -3.0, 2.0)), "capital": capital}
                    for s, m in sorted(some)
                ]
                scenes[capital, delay, day] = made
                at = lambda m, day=day: dt.datetime(2024, 1, day, 10, 0) + m * MINUTE
                rows += [(capital, delay, dt.date(2024, 1, day), r["symbol"], at(r["at"]), at(r["at"]), at(r["at"] + r["minutes"]), r["direction"], r["price"], r["end_price"], 1.0, r["bar"], r["day"], r["strength"]) for r in made]
    s = spark.createDataFrame(rows, "capital double, delay int, trade_date date, symbol string, signal_ts timestamp_ntz, entry_ts timestamp_ntz, exit_ts timestamp_ntz, direction string, entry_price double, exit_price double, gross_return_pct double, entry_bar_dollar_volume double, daily_dollar_volume double, signal_strength double")
    got = {}
    for r in xo.allocate_day(xo.size_fills(s, F.col("capital"), c), c).collect():
        got.setdefault((r.capital, r.delay, r.trade_date.day), {})[r.symbol, r.signal_ts.hour * 60 + r.signal_ts.minute - 600] = r
    reasons = set()
    for scene, made in scenes.items():
        want = _plain_allocation(made, c)
        assert {k: r.rejection_reason for k, r in got[scene].items()} == {k: w for k, (w, _) in want.items()}, scene
        for k, (why, size) in want.items():
            reasons.add(why)
            assert got[scene][k].accepted == (why is None)
            assert got[scene][k].filled_notional == (pytest.approx(size) if size is not None else None)
    assert {None, "unavailable_entry_fill", "unavailable_exit_fill", "existing_symbol_position", "max_positions", "liquidity_capacity_unavailable"} < reasons
    assert xo.allocate_day(xo.size_fills(s.limit(0), F.col("capital"), c), c).count() == 0


@pytest.mark.parametrize("one_per_symbol", [True, False])
def test_a_crowded_day_is_folded_without_slices(spark, one_per_symbol):
    """Many signals at each instant, judged as by a plain loop; no slice is cut from a whole day, which would copy it for each."""
    rng, day = random.Random(7), dt.date(2024, 1, 2)
    c = xo.ExecutionConfig(max_positions=3, one_per_symbol=one_per_symbol)
    at = lambda m: dt.datetime(2024, 1, 2, 10, 0) + m * MINUTE
    made = [
        {"symbol": f"S{s:03}", "at": m, "minutes": rng.choice((5, 15, 15, 0)), "direction": rng.choice(("long", "short")), "price": rng.choice((None, 10.0, 10.0)), "end_price": rng.choice((None, 11.0, 11.0)), "bar": rng.choice((None, 9_000.0, 1e7)), "day": rng.choice((0.0, 1e9, 2e9)), "capital": 10_000.0}
        for m in range(0, 60, 5) for s in range(150)
    ]
    schema = "capital double, delay int, trade_date date, symbol string, signal_ts timestamp_ntz, entry_ts timestamp_ntz, exit_ts timestamp_ntz, direction string, entry_price double, exit_price double, gross_return_pct double, entry_bar_dollar_volume double, daily_dollar_volume double"
    rows = [(r["capital"], 0, day, r["symbol"], at(r["at"]), at(r["at"]), at(r["at"] + r["minutes"]), r["direction"], r["price"], r["end_price"], 1.0, r["bar"], r["day"]) for r in made]
    s = xo.size_fills(spark.createDataFrame(rows, schema), F.col("capital"), c)
    got = {(r.symbol, r.signal_ts.hour * 60 + r.signal_ts.minute - 600): r for r in xo.allocate_day(s, c).collect()}
    want = _plain_allocation(made, c)
    assert {k: r.rejection_reason for k, r in got.items()} == {k: w for k, (w, _) in want.items()}
    assert {k: r.filled_notional for k, r in got.items()} == {k: None if f is None else pytest.approx(f) for k, (_, f) in want.items()}
    assert {None, "existing_symbol_position", "max_positions", "minimum_fill_fraction"} - {w for w, _ in want.values()} <= ({"existing_symbol_position"} if not one_per_symbol else set())
    assert "slice(" not in xo.allocate_day(s, c)._jdf.queryExecution().optimizedPlan().toString()


def test_entries_out_of_order_close_positions_for_good(spark):
    """A signal that enters late closes what ends before it also for signals after it that enter earlier."""
    day, at = dt.date(2024, 1, 2), lambda m: dt.datetime(2024, 1, 2, 10, 0) + m * MINUTE
    c = xo.ExecutionConfig(max_positions=1)
    rows = [("A", 0, 0, 10), ("B", 1, 20, 30), ("C", 2, 2, 9), ("D", 2, 25, 60), ("E", 2, 40, 50)]
    schema = "capital double, delay int, trade_date date, symbol string, signal_ts timestamp_ntz, entry_ts timestamp_ntz, exit_ts timestamp_ntz, direction string, entry_price double, exit_price double, gross_return_pct double, entry_bar_dollar_volume double, daily_dollar_volume double"
    s = spark.createDataFrame([(1000.0, 0, day, n, at(a), at(b), at(e), "long", 1.0, 1.0, 0.0, 1e9, 1e9) for n, a, b, e in rows], schema)
    got = {r.symbol: r.rejection_reason for r in xo.allocate_day(xo.size_fills(s, F.col("capital"), c), c).collect()}
    assert got == {"A": None, "B": None, "C": "max_positions", "D": "max_positions", "E": None}


def test_equity_follows_the_trades(spark):
    """One long and one short trade of a day, minute by minute."""
    at = lambda m: dt.datetime(2024, 1, 2, 10, 0) + m * MINUTE
    day = dt.date(2024, 1, 2)
    trades = spark.createDataFrame([(1000.0, 0, day, "A", at(0), at(0), at(2), "long", 10.0, 11.0, 10.0, 1e9, 100.0, 1.0, True), (1000.0, 0, day, "B", at(1), at(1), at(3), "short", 20.0, 19.0, 5.0, 1e9, 200.0, 1.0, True)],
        "capital double, delay int, trade_date date, symbol string, signal_ts timestamp_ntz, entry_ts timestamp_ntz, exit_ts timestamp_ntz, direction string, entry_price double, exit_price double, gross_return_pct double, capacity_notional double, filled_notional double, fill_fraction double, accepted boolean")
    marks = spark.createDataFrame([("A", at(0), 10.0), ("A", at(1), 10.5), ("B", at(1), 20.0), ("B", at(2), 22.0)], "symbol string, bar_ts timestamp_ntz, close double")
    e = {r.ts.minute: r for r in xo.equity_curve(trades, marks, (20.0,), 1).collect()}
    a, b = 100 * (10.0 - 0.2) / 100, 200 * (5.0 - 0.2) / 100
    assert [e[m].equity for m in range(4)] == pytest.approx([1000, 1005, 1000 + a - 20, 1000 + a + b])
    assert [(e[m].gross_exposure, e[m].net_exposure, e[m].open_positions) for m in range(4)] == [(100, 100, 1), (300, -100, 2), (200, -200, 1), (0, 0, 0)]
    d = xo.daily_portfolio(xo.equity_curve(trades, marks, (20.0,), 1), xo.with_costs(trades, (20.0,))).first()
    assert (d.end_equity, d.turnover, d.peak_gross_exposure) == (pytest.approx(1000 + a + b), 600, 300) and d.worst_drawdown_pct == pytest.approx(((980 + a) / 1005 - 1) * 100)


def test_equity_of_overlapping_trades_is_that_of_a_plain_loop(spark):
    """Long and short trades that overlap in one symbol, missing marks, two days and costs: rows are symbols and instants."""
    rng, rows = random.Random(3), []
    at = lambda d, m: dt.datetime(2024, 1, d, 10, 0) + m * MINUTE
    for day in (2, 3):
        for _ in range(25):
            a = rng.randrange(0, 20)
            rows.append((1000.0, 0, dt.date(2024, 1, day), rng.choice("AB"), at(day, a), at(day, a + rng.randrange(1, 9)), rng.choice(("long", "short")), 10.0 + rng.random(), rng.random(), 100.0 * rng.random(), rng.random() < 0.9))
    trades = spark.createDataFrame(rows, "capital double, delay int, trade_date date, symbol string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, direction string, entry_price double, gross_return_pct double, filled_notional double, accepted boolean")
    marks = {(s, at(d, m)): 10 + rng.random() for s in "AB" for d in (2, 3) for m in range(30) if rng.random() < 0.8}
    bars = spark.createDataFrame([(s, t, p) for (s, t), p in marks.items()], "symbol string, bar_ts timestamp_ntz, close double")
    done = [r for r in rows if r[-1]]
    got = xo.equity_curve(trades, bars, (0.0, 30.0), 1).collect()
    instants = {t for r in done for t in [r[4] + i * MINUTE for i in range(int((r[5] - r[4]) / MINUTE) + 1)]}
    assert {(r.ts, r.cost_bps) for r in got} == {(t, c) for t in instants for c in (0.0, 30.0)} and len(got) == 2 * len(instants)
    for r in got:
        live = [x for x in done if x[4] <= r.ts < x[5]]
        sign = lambda x: 1 if x[6] == "long" else -1
        open_pnl = sum(sign(x) * x[9] * (marks[x[3], r.ts] / x[7] - 1) for x in live if (x[3], r.ts) in marks)
        realised = sum(x[9] * (x[8] - r.cost_bps / 100) / 100 for x in done if x[5] <= r.ts)
        assert (r.open_pnl, r.realised_pnl, r.gross_exposure, r.net_exposure, r.open_positions) == pytest.approx((open_pnl, realised, sum(x[9] for x in live), sum(sign(x) * x[9] for x in live), len(live)), abs=1e-9)
    held = xo.holdings(trades.where("accepted"), bars).collect()
    assert len(held) == len({(x[3], t) for x in done for t in [x[4] + i * MINUTE for i in range(int((x[5] - x[4]) / MINUTE))]})


def test_allocation_needs_no_python_worker(spark):
    columns = "capital double, delay int, trade_date date, symbol string, signal_ts timestamp_ntz, entry_ts timestamp_ntz, exit_ts timestamp_ntz, direction string, entry_price double, exit_price double, gross_return_pct double, entry_bar_dollar_volume double, daily_dollar_volume double"
    c = xo.ExecutionConfig()
    plan = xo.allocate_day(xo.size_fills(spark.createDataFrame([], columns), F.col("capital"), c), c)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_slices_and_upserts_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string")
    for _ in range(2):
        sinks.write_slice(df, str(tmp_path / "s"), ["k"])
        sinks.write_new(df, str(tmp_path / "n"), ["k"], sinks.key_hash(["k"], 3))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2 and spark.read.parquet(str(tmp_path / "n")).count() == 2
    once = sinks.upsert(df, df.withColumn("v", F.col("v") + 1), ["k"], F.col("k") == "a")
    assert {r.k: r.v for r in once.collect()} == {"a": 1, "b": 3}


def test_appends_and_upserts_touch_the_parts_of_their_keys_only(spark, tmp_path):
    path, part = str(tmp_path / "t"), sinks.key_range("k", 100)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").glob("key_part=*/*.parquet")}
    folder = lambda names: {f.split("key_part=")[1].split("/")[0] for f in names}
    sinks.write_new(spark.range(1000).select(F.col("id").alias("k"), F.lit(0).alias("v")), path, ["k"], part)
    first = files()
    sinks.upsert_into(spark.createDataFrame([(5, 7), (5, 6), (250, 8), (1150, 9)], "k long, v int"), path, ["k"], part, F.col("k") == 250)
    second = files()
    assert folder(set(first) - set(second)) == {"0", "2"} and folder(set(second) - set(first)) == {"0", "2", "11"}
    got = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert len(got) == 1001 and (got[5], got[250], got[1150]) == (6, 0, 9)
    sinks.upsert_into(spark.createDataFrame([(5, 6)], "k long, v int"), path, ["k"], part)
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == got
    before = files()
    new = spark.createDataFrame([(999, 3), (1000, 4), (1000, 2), (None, 1)], "k long, v int")
    sinks.write_new(new, path, ["k"], part)
    assert set(before) <= set(files()) and folder(set(files()) - set(before)) == {"10", "__HIVE_DEFAULT_PARTITION__"}
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == got | {1000: 2, None: 1}
    looked = sinks._touched(spark, path, spark.createDataFrame([(3,)], "key_part long"))
    assert {r[0].split("key_part=")[1].split("/")[0] for r in looked.select(F.input_file_name()).collect()} == {"3"}


def test_overlapping_signals_of_a_symbol_are_dropped(spark):
    at = lambda m: dt.datetime(2024, 1, 2, 10, 0) + m * MINUTE
    s = spark.createDataFrame([("A", dt.date(2024, 1, 2), at(m)) for m in (0, 3, 5, 9, 10)], "symbol string, trade_date date, bar_ts timestamp_ntz")
    assert sorted(r.bar_ts.minute for r in xo.dedupe_overlaps(s, 5).collect()) == [0, 5, 10]


@pytest.mark.parametrize("options", [{"horizons": (5, 15), "cost_bps": 12.0}, {"directions": ("short",), "horizons": (15,), "overlapping": True, "families": ("volume_shock", "blank_canvas_price_activity")}])
def test_screen_of_cells_is_that_of_outcomes(spark, options):
    states = so.bin_state(registry.Tables(spark, SF).samples)
    columns = ("observations", "symbols", "dates", "wins", "gross_sum", "net_avg_pct", "stdev_pct", "t_stat", "profit_factor", "worst_pct", "best_pct", "max_symbol_share_pct", "max_date_share_pct", *do.QUANTILES)
    rows = lambda df: {tuple(r[k] for k in do.GROUP): tuple(None if r[c] is None else round(float(r[c]), 7) for c in columns) for r in df.collect()}
    got = rows(do.screen_states(states, **options))
    assert got and got == rows(do.screen(do.group_outcomes(states, **options)))


def test_the_screen_sends_no_row_for_a_direction(spark):
    """Rows and keys that the exchange takes in: whole numbers, one for each family of a state."""
    states = so.bin_state(registry.Tables(spark, SF).samples)
    plan = do.screen_states(states)._jdf.queryExecution().executedPlan().toString()
    groups = do.group_outcomes(states).select("family", "group_key", "symbol", "bar_ts").distinct().count()
    cells = states.where("fwd_return_5m_pct IS NOT NULL").select(F.explode(do.cells())).count()
    assert cells == groups and "concat_ws" not in plan
