"""Idempotent writes, upserts and exports."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NESTED = ("array", "map", "struct")


def there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def scratch(spark: SparkSession, label: str) -> str:
    """A folder for a query's own files, in the cluster's shared folder; a temporary one only within one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a scratch folder and read back: what is read several times is worked out once."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_slice(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace exactly the partitions that ``df`` has rows of; writing it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


#: Partition column of keyed tables: the part of the key space in which a row's key lies.
PART = "key_part"


def key_range(column: str, width: int) -> Column:
    """Parts of ``width`` neighbouring numbers: keys that come together stay together."""
    return F.floor(F.col(column) / width)


def key_hash(columns: list[str], parts: int) -> Column:
    """Parts of keys without an order; null keys are keys."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts))


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """The least row of each key by its other columns: the same one at every run."""
    values = [c for c in df.columns if c not in keys]
    if not values:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*values)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def _touched(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame | None:
    """The table's rows in the parts in which ``rows`` lie: the scan lists and reads those partitions only."""
    old = there(spark, path)
    if old is None:
        return None
    parts = [r[0] for r in rows.select(PART).distinct().collect()]  # the parts of one batch
    known = F.col(PART).isin([p for p in parts if p is not None])
    return old.where(known | F.col(PART).isNull() if None in parts else known)


def write_new(df: DataFrame, path: str, keys: list[str], part: Column) -> None:
    """Append the rows whose keys are not there yet, one of each key.

    ``part``, a function of the keys, says in which partition a key lies; keys are looked up in the parts
    of the new rows only.
    """
    new = scratch_table(one_of_each(df, keys).withColumn(PART, part), "new-rows")
    old = _touched(df.sparkSession, path, new)
    if old is not None:
        there_already = reduce(lambda a, b: a & b, [new[k].eqNullSafe(old[k]) for k in keys])
        new = new.join(old.select(*keys), there_already, "left_anti")
    new.write.mode("append").partitionBy(PART).parquet(path)


def upsert_into(updates: DataFrame, path: str, keys: list[str], part: Column, keep_if: Column | None = None) -> None:
    """Put ``updates`` (one of each key) into a table of ``write_new`` by key; rows where ``keep_if`` holds stay.

    Only partitions that hold a key of the updates are read and replaced; running it again changes nothing.
    """
    new = scratch_table(one_of_each(updates, keys).withColumn(PART, part), "updates")
    old = _touched(updates.sparkSession, path, new)
    merged = new if old is None else upsert(old.select(*new.columns), new, keys, keep_if)
    write_slice(scratch_table(merged, "merged"), path, [PART])


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], keep_if: Column | None = None) -> DataFrame:
    """``target`` with ``updates`` put in by key; rows where ``keep_if`` holds (in target's columns) stay."""
    values = [c for c in target.columns if c not in keys]
    old = target.select(*keys, F.struct(*values).alias("_old"), (keep_if if keep_if is not None else F.lit(False)).alias("_keep"))
    new = updates.select(*keys, F.struct(*values).alias("_new"))
    both = old.join(new, keys, "full_outer")
    row = F.when(F.col("_new").isNull() | F.coalesce("_keep", F.lit(False)), F.col("_old")).otherwise(F.col("_new"))
    return both.withColumn("_row", row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])


def write_monthly(df: DataFrame, path: str, day: str = "trade_date") -> None:
    """One folder a month; months that come again are replaced."""
    write_slice(df.withColumn("month", F.date_format(day, "yyyy-MM")), path, ["month"])


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in NESTED else F.col(f.name) for f in df.schema])


def leaderboard_rows(rules: DataFrame, provenance: list[tuple[DataFrame, str]], order: list[Column]) -> DataFrame:
    """Rules with the runs, feature sets and universes that they come from, flat and in order."""
    return flat(reduce(lambda d, p: d.join(p[0], p[1], "left"), provenance, rules)).orderBy(*order)


def export_candidates(rows: DataFrame, folder: str) -> DataFrame:
    """Write CSV and JSON lines; the manifest: a row with the number of rules and runs."""
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    rows.write.mode("overwrite").json(f"{folder}/json")
    return manifest(rows)


def manifest(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rules"), F.countDistinct("family").alias("families"), F.countDistinct("direction").alias("directions"))


def export_mix(rules: DataFrame, keys=("status", "family", "direction", "horizon")) -> DataFrame:
    """Counts by each of the keys on its own, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))
    return rules.select(pairs.alias("p")).groupBy("p.key", "p.value").agg(F.count("*").alias("n"))
