"""Registration of the bar engine's queries: name -> Spark query and, where there is one, its SQL.

A query names its result columns once, with ``:d`` for doubles and ``:l`` for longs; both sides cast
and round them alike. SQL bodies may use the common table expressions of ``ctes``; those they mention
are put before them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features as feature_ops
from tidemark.operators import states as state_ops
from tidemark.plans.ctes import CTES
from tidemark.sources import proxies

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6


class Tables:
    """The tables of one folder and what most queries derive from them, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def bars(self) -> DataFrame:
        return proxies.bars_from_events(self["events"])

    @cached_property
    def daily_source(self) -> DataFrame:
        return proxies.daily_from_lineitem(self["lineitem"])

    @cached_property
    def assets(self) -> DataFrame:
        return proxies.assets_from_part(self["part"])

    @cached_property
    def features(self) -> DataFrame:
        return feature_ops.build_features(self.bars, proxies.FEATURES)

    @cached_property
    def samples(self) -> DataFrame:
        return state_ops.enrich(self.features)


_ALL: dict[str, tuple[Query, str | None]] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [(n, k) for n, _, k in (c.strip().partition(":") for c in spec.split(","))]


def with_ctes(body: str) -> str:
    """``body`` after the expressions that it uses, in their order of definition."""
    used: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in CTES:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                pending.append(CTES[name])
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in used)
    return f"WITH {head}\n{body}" if head else body


def register(name: str, columns: str, query: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    spec = _columns(columns)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(Tables(spark, sf_dir))
        out = {"d": lambda c: F.round(F.col(c).cast("double"), DIGITS) + F.lit(0.0), "l": lambda c: F.col(c).cast("long"), "": F.col}
        return df.select(*[out[k](n).alias(n) for n, k in spec])

    text = None
    if sql is not None:
        out = {"d": f"round(CAST({{0}} AS DOUBLE), {DIGITS}) + 0.0 AS {{0}}", "l": "CAST({0} AS BIGINT) AS {0}", "": "{0}"}
        text = with_ctes(f"SELECT {', '.join(out[k].format(n) for n, k in spec)} FROM ({sql})")
    if name in _ALL:
        raise ValueError(f"{name} is registered twice")
    _ALL[name] = (run, text)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _ALL["d8_group_stats"][0](spark, sf_dir)


def _load() -> None:
    from tidemark.plans import catalogue

    catalogue.load()


def queries() -> dict[str, Query]:
    _load()
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
