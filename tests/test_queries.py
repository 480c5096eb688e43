"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(_norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    result = con.execute(sql)
    place = [[d[0] for d in result.description].index(c) for c in columns]
    assert rows == sorted((tuple(_norm(r[i]) for i in place) for r in result.fetchall()), key=repr)
