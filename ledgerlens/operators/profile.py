"""Staging profile queries: run on the raw staging rows before any modelling.

Per-account profiles use two plain aggregations (account, then summary), each
with map-side partial aggregation; the 'ALL' fraud row is summed from the five
per-type rows instead of re-scanning staging.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import ratio_half_up
from ledgerlens.operators.common import money, pct, sum_cents


def profile_row_count(stg: DataFrame) -> DataFrame:
    return stg.agg(F.count(F.lit(1)).alias("total_rows"))


def profile_type_distribution(stg: DataFrame) -> DataFrame:
    g = stg.groupBy("type").agg(F.count(F.lit(1)).alias("txn_count"), sum_cents("amount").alias("value_cents"))
    return g.select(
        "type",
        "txn_count",
        pct("txn_count", "sum(txn_count) OVER ()", 2).alias("pct_of_rows"),
        money(F.col("value_cents")).alias("total_value"),
    ).orderBy(F.col("txn_count").desc())


def profile_fraud_rate(stg: DataFrame) -> DataFrame:
    per_type = stg.groupBy("type").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.sum(F.col("is_fraud").cast("long")).alias("fraud_count"),
        F.sum(F.col("is_flagged_fraud").cast("long")).alias("flagged_count"),
    )
    overall = per_type.agg(
        F.lit("ALL").alias("type"),
        F.sum("txn_count").alias("txn_count"),
        F.sum("fraud_count").alias("fraud_count"),
        F.sum("flagged_count").alias("flagged_count"),
    )
    both = overall.unionByName(per_type)
    return both.select(
        "type",
        "txn_count",
        "fraud_count",
        pct("fraud_count", "txn_count", 4).alias("fraud_pct"),
        "flagged_count",
    ).orderBy(F.col("fraud_count").desc())


def profile_step_range(stg: DataFrame) -> DataFrame:
    s = stg.agg(
        F.min("step").alias("min_step"),
        F.max("step").alias("max_step"),
        F.count_distinct("step").alias("distinct_steps"),
    )
    return s.select(
        "min_step",
        "max_step",
        "distinct_steps",
        ((F.col("max_step") - F.col("min_step") + 1).cast("double") / F.lit(24.0)).alias("approx_days"),
    )


def _per_account(stg: DataFrame, col: str) -> DataFrame:
    return stg.groupBy(col).agg(F.count(F.lit(1)).alias("txn_count"))


def _recurrence_summary(acts: DataFrame, label: str) -> DataFrame:
    one = F.count_if(F.col("txn_count") == 1)
    s = acts.agg(
        F.count(F.lit(1)).alias(label),
        one.alias("one_txn_only"),
        F.max("txn_count").alias("max_txns_per_account"),
        F.sum("txn_count").alias("_txns"),
    )
    return s.select(
        label,
        "one_txn_only",
        pct("one_txn_only", label, 2).alias("pct_one_txn_only"),
        "max_txns_per_account",
        ratio_half_up("_txns", label, 3).alias("avg_txns_per_account"),
    )


def profile_orig_recurrence(stg: DataFrame) -> DataFrame:
    return _recurrence_summary(_per_account(stg, "name_orig"), "distinct_originators")


def profile_orig_distribution(stg: DataFrame) -> DataFrame:
    return (
        _per_account(stg, "name_orig")
        .groupBy(F.col("txn_count").alias("txns_per_account"))
        .agg(F.count(F.lit(1)).alias("n_accounts"))
        .orderBy("txns_per_account")
    )


def profile_orig_multi_day(stg: DataFrame) -> DataFrame:
    """Originators active on more than one day, with the profile's own day
    definition ``step div 24`` (no -1 offset, unlike the model's day)."""
    per_day = stg.select("name_orig", F.floor(F.col("step") / 24).alias("d")).distinct()
    days = per_day.groupBy("name_orig").agg(F.count(F.lit(1)).alias("active_days"))
    s = days.agg(
        F.count(F.lit(1)).alias("distinct_originators"),
        F.count_if(F.col("active_days") > 1).alias("active_on_multiple_days"),
    )
    return s.select(
        "distinct_originators",
        "active_on_multiple_days",
        pct("active_on_multiple_days", "distinct_originators", 2).alias("pct_multi_day"),
    )


def profile_dest_recurrence(stg: DataFrame) -> DataFrame:
    return _recurrence_summary(_per_account(stg, "name_dest"), "distinct_destinations")


def profile_dest_prefix(stg: DataFrame) -> DataFrame:
    return (
        stg.groupBy(F.left(F.col("name_dest"), F.lit(1)).alias("dest_prefix"))
        .agg(F.count(F.lit(1)).alias("txn_count"))
        .orderBy(F.col("txn_count").desc())
    )
