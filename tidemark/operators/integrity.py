"""Provenance and integrity reports, as tables of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.sinks import upsert


def fingerprint(fields: list[str]) -> Column:
    """SHA-256 of the fields as JSON in sorted order; leave dates out to compare across periods."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def changed_after_freeze(rules: DataFrame, ledger: DataFrame, key: str = "rule_id") -> DataFrame:
    """Frozen rules whose present fingerprint differs from the frozen one."""
    frozen = ledger.where("frozen").select(key, F.col("fingerprint").alias("frozen_fingerprint"))
    return rules.select(key, "fingerprint").join(frozen, key).where("fingerprint <> frozen_fingerprint")


def period_violations(runs: DataFrame, holdout_start: str, ledger: DataFrame) -> DataFrame:
    """Research runs that touch the holdout, holdout runs that begin before it, and holdout runs of rules not frozen.

    runs: run_id, rule_id, purpose (research or holdout), start_date, end_date.
    """
    h = F.lit(holdout_start).cast("date")
    research = runs.where((F.col("purpose") == "research") & (F.col("end_date") >= h)).withColumn("violation", F.lit("research touches the holdout"))
    early = runs.where((F.col("purpose") == "holdout") & (F.col("start_date") < h)).withColumn("violation", F.lit("holdout begins early"))
    open_ = runs.where("purpose = 'holdout'").join(ledger.where("frozen").select("rule_id"), "rule_id", "left_anti").withColumn("violation", F.lit("holdout without a freeze"))
    return research.unionByName(early).unionByName(open_).select("run_id", "violation")


def lookahead_violations(snapshots: DataFrame) -> DataFrame:
    return snapshots.where("lookback_end >= snapshot_date OR effective_start < snapshot_date")


COMPATIBLE = ("universe", "timeframe", "feed", "adjustment", "session", "tiers", "baseline_days", "predictors")


def compatibility(pairs: DataFrame, fields=COMPATIBLE) -> DataFrame:
    """The fields in which two feature sets (structs source and target) differ, and a horizon that the target lacks."""
    names = [F.when(~F.col(f"source.{f}").eqNullSafe(F.col(f"target.{f}")), F.lit(f)) for f in fields]
    lacks = F.when(~F.array_contains("target.outcomes", F.col("horizon")), F.lit("horizon"))
    return pairs.withColumn("mismatches", F.array_compact(F.array(*names, lacks)))


def missing_fields(configs: DataFrame, required: list[str], column: str = "config") -> DataFrame:
    """Required fields that a configuration (a map) does not have."""
    need = F.array(*[F.lit(x) for x in required])
    return configs.withColumn("missing", F.array_except(need, F.map_keys(column)))


def sync_ledger(ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """The ledger with new and changed rules; frozen rows stay as they are. Both: rule_id, fingerprint, frozen."""
    return upsert(ledger, rules, ["rule_id"], F.col("frozen"))
