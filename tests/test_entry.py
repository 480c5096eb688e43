"""The entry module, with and without the corpus operators; the stream of arriving bars."""

import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.operators import features as fo
from tidemark.sources import proxies
from tidemark.streaming import refresh

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    n, any_op = said.stdout.split()[-2:]
    assert int(n) > 150 and any_op == "False"


def test_arriving_bars_refresh_what_they_touch(spark, tmp_path):
    bars = proxies.bars_from_events(spark.read.parquet(f"{SF}/events.parquet")).cache()
    late = bars.where("trade_date >= DATE '2024-01-20'")
    store, arrivals, out = (str(tmp_path / x) for x in ("bars", "arrivals", "features"))
    bars.exceptAll(late).write.partitionBy("trade_date").parquet(store)
    late.write.parquet(arrivals)
    early = spark.read.parquet(store)
    state = str(tmp_path / "state")
    refresh.refresh(early, early, out, state, proxies.FEATURES)
    refresh.refresh_stream(spark, arrivals, store, out, state, late.schema, str(tmp_path / "checkpoint"), proxies.FEATURES).awaitTermination(300)
    columns = ["symbol", "bar_ts", "session_label", "ret_5m_pct", "fwd_return_15m_pct", "same_minute_avg_volume_prior_days", "previous_regular_close"]
    got, want = spark.read.parquet(out).select(columns), fo.build_features(bars, proxies.FEATURES).select(columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    bars = proxies.bars_from_events(spark.read.parquet(f"{SF}/events.parquet")).cache()
    store = str(tmp_path / "bars")
    for part in (bars.where("trade_date < DATE '2024-01-10'"), bars, bars):
        refresh.append_new(part, store)
    assert spark.read.parquet(store).count() == bars.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_a_refresh_reads_new_dates_and_the_state_only(spark, tmp_path):
    """A symbol with one bar a month and a change of the past: right rows, and only files after the version are read."""
    bars = proxies.bars_from_events(spark.read.parquet(f"{SF}/events.parquet")).cache()
    days = sorted(r[0] for r in bars.select("trade_date").distinct().collect())
    rare = bars.where(F.col("trade_date") == F.lit(days[0])).groupBy("session_label").agg(*[F.min(c).alias(c) for c in bars.columns if c != "session_label"]).select(*bars.columns)
    rare = rare.withColumn("symbol", F.lit("rare")).where("session_label = 'regular'")
    late = rare.withColumns({"trade_date": F.lit(days[-1]), "bar_ts": F.col("bar_ts") + F.expr(f"make_dt_interval({(days[-1] - days[0]).days})"), "close": F.lit(123.0)})
    whole = bars.unionByName(rare).unionByName(late)
    store, out, state = (str(tmp_path / x) for x in ("bars", "features", "state"))
    config = fo.FeatureConfig(base_minutes=5, predictors=(5, 15, 30, 60), outcomes=(5, 15, 30, 60), baseline_days=2)
    columns = ["symbol", "bar_ts", "session_label", "ret_5m_pct", "fwd_return_15m_pct", "same_minute_avg_volume_prior_days", "same_minute_avg_abs_return_prior_days", "previous_regular_close", "previous_day_return_pct"]

    def same(known):
        got, want = spark.read.parquet(out).select(columns), fo.build_features(known, config).select(columns)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0

    def add(part):
        part.write.mode("append").partitionBy("trade_date").parquet(store)
        known = spark.read.schema(whole.schema).parquet(store)
        refresh.refresh(known, part, out, state, config)
        return known

    cut, hole = days[-2], "symbol LIKE 'click%' AND trade_date = DATE '2024-01-09'"
    add(whole.where(F.col("trade_date") < F.lit(cut)).where(f"NOT ({hole})"))
    for day in days[-2:]:  # each new day needs its own files only, though the rare symbol looks back a month
        part = whole.where(F.col("trade_date") == F.lit(day))
        known = add(part)
        base = max(v for v in refresh.versions(spark, state) if v < day)
        files = {r[0] for r in refresh.between(known, base, day).select(F.input_file_name()).distinct().collect()}
        assert files and all(f"trade_date={day}" in f for f in files)
    same(whole.where(f"NOT ({hole})"))
    assert spark.read.parquet(out).where("symbol = 'rare'").orderBy(F.col("bar_ts").desc()).first().previous_regular_close is not None
    add(whole.where(hole))  # a change of the past: later rows that look at it, and the state
    same(whole)
    kept = refresh.version(spark, state, days[-1], refresh.state_rows(whole, config))
    want = refresh.newest(refresh.state_rows(whole, config), config)
    assert kept.count() == want.count() and kept.select(want.columns).exceptAll(want).count() == 0
    again = whole.where(F.col("trade_date") == F.lit(days[-1]))
    refresh.refresh(spark.read.schema(whole.schema).parquet(store), again, out, state, config)
    same(whole)
