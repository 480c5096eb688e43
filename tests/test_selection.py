"""Distributed selection against exact percentiles: ties, nulls, NaN, null keys, a hot key, several levels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import robustness, selection

WANTED = {"low": ("x", 0.05), "median": ("x", 0.5), "high": ("x", 0.95), "least": ("x", 0.0), "most": ("x", 1.0), "other": ("y", 0.25)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def check(df, keys, levels=1):
    got = {tuple(r[k] for k in keys): r for r in selection.quantiles(df, keys, WANTED, levels).collect()}
    exact = df.groupBy(*keys).agg(*[F.percentile(F.col(c).cast("double"), F.lit(q)).alias(n) for n, (c, q) in WANTED.items()])
    for want in exact.collect():
        row = got.get(tuple(want[k] for k in keys))
        if row is None:
            assert all(want[n] is None for n in WANTED)
            continue
        for n in WANTED:
            a, b = row[n], want[n]
            assert (a is None) == (b is None) and (a is None or a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)), (n, a, b)


@pytest.mark.parametrize("levels", [1, 2])
def test_quantiles_of_odd_keys(spark, levels):
    rows = [("one", 1.5, 2)] + [("tied", 7.0, i % 3) for i in range(500)] + [("none", None, None)] * 3 + [(None, float(i), -i) for i in range(101)]
    rows += [("two", 1.0, 1), ("two", 4.0, 9), ("inf", float("inf"), 1), ("inf", 1.0, 2), ("part", None, 1), ("part", 2.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, y int").withColumns({"g": F.lit("clash"), "v": F.lit("clash"), "n": F.lit(1)}).repartition(3)
    check(df, ["k"], levels)
    assert selection.quantiles(df.limit(0), ["k"], WANTED).count() == 0


def test_nan_is_above_all(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "x double")
    row = selection.quantiles(df, [], {"a": ("x", 0.5), "b": ("x", 1.0)}).first()
    assert row.a == 2.0 and math.isnan(row.b)


@pytest.mark.parametrize("levels", [1, 3])
def test_quantiles_of_skewed_values(spark, levels):
    """Values over hundreds of orders of magnitude, most of them in one bin of any even grid."""
    df = spark.range(60_000).select((F.col("id") % 3 == 0).alias("k"), F.exp(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 2000 - 250).alias("x"), F.pmod(F.xxhash64("id"), F.lit(5)).alias("y"))
    check(df, ["k"], levels)


def test_millions_of_distinct_values_in_one_key(spark):
    """No task holds a key's values: the values looked at again are a small share, and the plan has no percentile."""
    n = 2_500_000
    df = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 1000 == 0, "small").otherwise("hot").alias("k"), ((F.col("id") * 1_000_003) % n).cast("double").alias("x"))
    wanted = {"p05": ("x", 0.05), "p50": ("x", 0.5), "p99": ("x", 0.99)}
    out = selection.quantiles(df, ["k"], wanted)
    assert " percentile(" not in plan_of(out)
    got = {r.k: r for r in out.collect()}
    hot = np.sort(np.array([i * 1_000_003 % n for i in range(n) if i % 1000], float))
    for name, (_, q) in wanted.items():
        assert math.isclose(got["hot"][name], np.quantile(hot, q), rel_tol=1e-12)
    rows = df.select(F.struct("k").alias("g"), F.col("x").alias("v"))
    around = [0.05, 0.5, 0.99]
    near = F.array(*[F.lit(q + side * selection.REACH / selection.ACCURACY) for side in (-1, 1) for q in around])
    sketch = rows.groupBy("g").agg(F.percentile_approx("v", near, selection.ACCURACY).alias("cuts"), F.count("*").alias("n"))
    again = selection._bracketed(rows, sketch, 3).where("g.k = 'hot'").count()
    assert 0 < again <= 3 * selection.BRACKET * n + 4


def test_top_share_of_equal_outcomes(spark):
    """All outcomes fall into one bin; what the best make is counted, not sorted."""
    rows = [("a", 2.0)] * 1000 + [("b", float(i)) for i in range(1, 201)] + [("c", -1.0), ("c", None), ("d", 0.0)]
    df = spark.createDataFrame(rows, "k string, net double")
    out = robustness.top_share(df, ["k"])
    assert "Window" not in plan_of(out) or "row_number" not in plan_of(out)
    got = {r.k: r for r in out.collect()}
    assert got["a"].top_5pct_return_share_pct == pytest.approx(5.0) and got["a"].net_expectancy_excluding_top_1pct_pct == pytest.approx(2.0)
    assert got["b"].top_10pct_return_share_pct == pytest.approx(100 * sum(range(181, 201)) / sum(range(1, 201)))
    assert got["b"].net_expectancy_excluding_top_10pct_pct == pytest.approx(sum(range(1, 181)) / 180)
    assert got["c"].net_expectancy_excluding_top_1pct_pct is None and got["d"].top_1pct_return_share_pct is None
