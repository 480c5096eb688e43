"""Refresh of the slices that changed bars touch, in batches or as a stream of arrivals.

Features look back over rows, not dates: the last rows of the same symbol, session and minute, and the
symbol's day before. A state table keeps just those, in versions by date (``as_of``); a refresh reads the
newest version before the first changed date, the bars since then of the symbols that changed, and the
feature partitions that it replaces. How long ago a rare symbol last traded makes no difference.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.features import DAY_COLUMNS, FeatureConfig, build_features, daily_bars, session_features
from tidemark.sources.sinks import scratch_table, there, write_slice

MINUTE = ("symbol", "session_label", "minute_of_day")
MINUTE_COLUMNS = (*MINUTE, "trade_date", "volume", "bar_return_pct")
#: Versions of the state that stay usable for changes of the past; older ones are read no more.
VERSIONS = 5


def state_rows(bars: DataFrame, config: FeatureConfig) -> DataFrame:
    """What the state may hold of these bars: a row of each bar, and one of each symbol's regular day."""
    minutes = session_features(bars, config).select(F.lit("minute").alias("kind"), *MINUTE_COLUMNS)
    days = daily_bars(bars).select(F.lit("day").alias("kind"), "symbol", "trade_date", *DAY_COLUMNS)
    return minutes.unionByName(days, allowMissingColumns=True)


def newest(rows: DataFrame, config: FeatureConfig) -> DataFrame:
    """The last ``baseline_days`` rows of each symbol, session and minute, and the last day of each symbol."""
    w = Window.partitionBy("kind", *MINUTE).orderBy(F.col("trade_date").desc())
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.when(F.col("kind") == "day", 1).otherwise(config.baseline_days)).drop("_n")


def versions(spark: SparkSession, state: str) -> list[dt.date]:
    """Dates of the usable versions, in order: one row each is brought together."""
    table = there(spark, state)
    found = [] if table is None else [r[0] for r in table.select("as_of").distinct().collect()]
    return sorted(found)[-VERSIONS:]


def version(spark: SparkSession, state: str, as_of: dt.date | None, like: DataFrame) -> DataFrame:
    """The rows of one version, only its partition being read; none if there is no version."""
    if as_of is None:
        return like.limit(0)
    return spark.read.schema(like.schema.add("as_of", "date")).parquet(state).where(F.col("as_of") == F.lit(as_of)).drop("as_of")


def reached(bars: DataFrame, touched: DataFrame, first: dt.date, config: FeatureConfig) -> DataFrame:
    """(symbol, trade_date) of the days whose features look at a touched day, itself included.

    Reads keys from the first touched date on, of touched symbols.
    """
    later = bars.where(F.col("trade_date") >= F.lit(first)).select(*MINUTE, "trade_date").join(touched.select("symbol").distinct(), "symbol", "left_semi")
    later = later.join(touched.withColumn("hit", F.lit(True)), ["symbol", "trade_date"], "left")
    back = lambda keys, n: Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(-n, 0)
    minutes = later.withColumn("near", F.max("hit").over(back(MINUTE, config.baseline_days))).where("near").select("symbol", "trade_date")
    days = later.where("session_label = 'regular'").groupBy("symbol", "trade_date").agg(F.max("hit").alias("hit"))
    # the day after a touched one in time, whether that was regular or not
    both = days.unionByName(later.where("hit").select("symbol", "trade_date", "hit").distinct()).groupBy("symbol", "trade_date").agg(F.max("hit").alias("hit"))
    after = both.withColumn("near", F.max("hit").over(back(["symbol"], 1))).where("near").select("symbol", "trade_date")
    return minutes.unionByName(after).unionByName(touched.select("symbol", "trade_date")).distinct()


def between(bars: DataFrame, after: dt.date | None, last: dt.date) -> DataFrame:
    """Bars after the version and up to the last date that changes: literal bounds, so that the scan lists and reads no others."""
    since = bars if after is None else bars.where(F.col("trade_date") > F.lit(after))
    return since.where(F.col("trade_date") <= F.lit(last))


def refresh(bars: DataFrame, changed: DataFrame, path: str, state: str, config: FeatureConfig = FeatureConfig()) -> None:
    """Recompute the features of the days that ``changed`` touches or that look at those, and bring the state up to date.

    Partitions of ``path`` (by trade_date) are replaced with what other symbols had there and the new rows; running it
    again changes nothing. ``bars`` hold the changed bars already. Without any version of the state all is built. Bars
    that were taken out need a new state: what they had pushed out of it is no longer known.
    """
    spark = bars.sparkSession
    known = versions(spark, state)
    touched = scratch_table((changed if known else bars).select("symbol", "trade_date").distinct(), "touched")
    first = touched.agg(F.min("trade_date")).first()[0]
    if first is None:
        return
    base = max((v for v in known if v < first), default=None)
    pairs = scratch_table(reached(bars, touched, first, config), "reached")
    dates = [r[0] for r in pairs.select("trade_date").distinct().collect()]  # the dates of one refresh
    last = max(dates)
    own = between(bars, base, last).join(touched.select("symbol").distinct(), "symbol", "left_semi")
    rows = state_rows(own.join(touched, ["symbol", "trade_date"], "left_semi"), config)

    before = version(spark, state, base, rows).join(touched.select("symbol").distinct(), "symbol", "left_semi")
    minutes, days = (before.where(F.col("kind") == k) for k in ("minute", "day"))
    new = build_features(own, config, minutes.select(*MINUTE_COLUMNS), days.select("symbol", "trade_date", *DAY_COLUMNS)).join(pairs, ["symbol", "trade_date"], "left_semi")
    old = there(spark, path)
    if old is not None:
        stays = old.where(F.col("trade_date").isin(dates)).join(pairs, ["symbol", "trade_date"], "left_anti")
        new = new.unionByName(stays.select(*new.columns))
    write_slice(scratch_table(new, "slices"), path, ["trade_date"])

    # versions from the first change on, and one of the last date: their rows of other days, and the touched days anew
    made = []
    for as_of in dict.fromkeys([*[v for v in known if v >= first], max([last, *known])]):
        source = version(spark, state, max((v for v in known if v <= as_of), default=None), rows)
        stays = source.join(touched, ["symbol", "trade_date"], "left_anti")
        made.append(newest(stays.unionByName(rows.where(F.col("trade_date") <= F.lit(as_of))), config).withColumn("as_of", F.lit(as_of)))
    write_slice(scratch_table(reduce(DataFrame.unionByName, made), "state"), state, ["as_of"])


def append_new(rows: DataFrame, bars_path: str, key: tuple[str, ...] = ("symbol", "timeframe", "feed", "adjustment", "bar_ts")) -> None:
    """Append the rows whose key is not there yet, so that a batch that comes again adds nothing.

    Only the partitions of the rows' own dates are read for it.
    """
    spark = rows.sparkSession
    new = rows.dropDuplicates(list(key))
    try:
        known = spark.read.parquet(bars_path)
    except AnalysisException:  # the first batch
        known = None
    if known is not None:
        dates = [r[0] for r in rows.select("trade_date").distinct().collect()]  # the dates of one batch
        new = new.join(known.where(F.col("trade_date").isin(dates)).select(*key), list(key), "left_anti").select(*rows.columns)
    new.write.mode("append").partitionBy("trade_date").parquet(bars_path)


def refresh_stream(spark: SparkSession, arrivals: str, bars_path: str, path: str, state: str, schema, checkpoint: str, config: FeatureConfig = FeatureConfig()):
    """Take new bar files as they arrive, add them to the bars, refresh what they touch; ends when all are taken.

    A batch that is run again after a crash adds no bar twice and replaces the same slices.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows.persist()
        append_new(rows, bars_path)
        refresh(spark.read.parquet(bars_path), rows, path, state, config)
        rows.unpersist()

    stream = spark.readStream.schema(schema).parquet(arrivals)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
