"""Growth marts: daily activity, daily mix by type, the hour-of-day profile,
top destinations and account recurrence.

Distinct accounts by day come from one scan of both roles: account ids are made
distinct, account keys are gathered as bits of words (``keysets``); never by
several COUNT(DISTINCT) in one aggregate, which would multiply every row. Hours seen are the bits of one
OR. Each level is a hash aggregate with map-side combining, so a hot account or
a hot day is collapsed before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.numeric import ratio_half_up
from ledgerlens.operators import keysets
from ledgerlens.operators.common import cell_sums, hours_seen, millions, money, pct, sum_cents, with_type_names
from ledgerlens.operators.star import party_type

TOP_DESTINATIONS = 500


ROLES = {"name_orig": "active_originators", "name_dest": "active_destinations"}


def accounts_by_day(ledger, roles: dict[str, str] = ROLES) -> DataFrame:
    """Distinct accounts of the given roles by day, from one scan of both
    columns: bits of account keys from a written fact, ids from staging."""
    facts = ledger.facts
    pairs = ", ".join(f"struct({i} AS role, {column} AS account)" for i, column in enumerate(roles))
    rows = facts.selectExpr("day_number", f"inline(array({pairs}))")
    if isinstance(facts.schema["name_orig"].dataType, T.StringType):
        counts = rows.distinct().groupBy("day_number", "role").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = keysets.distinct_keys(rows, "account", ["day_number", "role"], "n")
    each = [F.coalesce(F.sum(F.when(F.col("role") == i, F.col("n"))), F.lit(0)).alias(name) for i, name in enumerate(roles.values())]
    return counts.groupBy("day_number").agg(*each)


def with_accounts(daily: DataFrame, ledger) -> DataFrame:
    """Daily rows with the accounts active in each role."""
    return daily.join(accounts_by_day(ledger), "day_number")


def daily_activity_units(ledger) -> DataFrame:
    daily = ledger.cells.groupBy("day_number").agg(*cell_sums(loss=False)).withColumn("hours_observed", hours_seen())
    return with_accounts(daily, ledger)


def growth_daily_activity(ledger) -> DataFrame:
    d = daily_activity_units(ledger)
    by_day = Window.orderBy("day_number")  # at most one row per simulated day
    return d.select(
        F.col("day_number").cast("long").alias("day_number"),
        "txn_count",
        money(F.col("value_cents")).alias("total_value"),
        millions("value_cents").alias("total_value_millions"),
        "active_originators",
        "active_destinations",
        ratio_half_up("value_cents", "txn_count * 100", 2).alias("avg_txn_value"),
        "hours_observed",
        (F.col("hours_observed") == 24).alias("is_complete_day"),
        money(F.col("value_cents") - F.lag("value_cents").over(by_day)).alias("value_change_vs_prior_day"),
    ).orderBy("day_number")


def growth_daily_by_type(ledger) -> DataFrame:
    agg = ledger.cells.groupBy("day_number", "transaction_type_key").agg(*cell_sums(loss=False))
    named = with_type_names(agg, ledger.dim_type)
    return named.select(
        F.col("day_number").cast("long").alias("day_number"),
        "type_name",
        "txn_count",
        millions("value_cents").alias("total_value_millions"),
        pct("txn_count", "sum(txn_count) OVER (PARTITION BY day_number)", 2).alias("pct_of_day_txns"),
        pct("value_cents", "sum(value_cents) OVER (PARTITION BY day_number)", 2).alias("pct_of_day_value"),
    ).orderBy("day_number", F.col("txn_count").desc())


def growth_hourly_profile(ledger) -> DataFrame:
    cells = ledger.facts.groupBy("day_number", "hour_of_day").agg(
        F.count(F.lit(1)).alias("txn_count"), sum_cents("amount").alias("value_cents")
    )
    hours = cells.groupBy("hour_of_day").agg(
        F.count(F.lit(1)).alias("days_observed"),
        F.sum("txn_count").alias("total_txns"),
        F.sum("value_cents").alias("value_cents"),
    )
    busiest = Window.orderBy(F.col("total_txns").desc())
    return hours.select(
        F.col("hour_of_day").cast("long").alias("hour_of_day"),
        "days_observed",
        ratio_half_up("total_txns", "days_observed", 1).alias("avg_txns_per_hour"),
        ratio_half_up("value_cents", f"days_observed * {10**8}", 2).alias(
            "avg_value_millions_per_hour"
        ),
        "total_txns",
        pct("total_txns", "sum(total_txns) OVER ()", 2).alias("pct_of_all_txns"),  # 24 rows
        F.rank().over(busiest).cast("long").alias("busiest_hour_rank"),
    ).orderBy("hour_of_day")


def account_activity(facts: DataFrame, account_col: str, with_values: bool = False) -> DataFrame:
    """Per account: txn_count and active_days via (account, day) -> account."""
    per_day_aggs = [F.count(F.lit(1)).alias("n")]
    if with_values:
        per_day_aggs += [sum_cents("amount").alias("v"), F.count_if(F.col("is_fraud")).alias("fr")]
    per_day = facts.groupBy(account_col, "day_number").agg(*per_day_aggs)
    aggs = [F.sum("n").alias("txn_count"), F.count(F.lit(1)).alias("active_days")]
    if with_values:
        aggs += [F.sum("v").alias("value_cents"), F.sum("fr").alias("fraud_txns")]
    return per_day.groupBy(account_col).agg(*aggs)


def growth_top_destinations(ledger, top: int = TOP_DESTINATIONS) -> DataFrame:
    """Top destinations by value received. Ordered by the exact sum, ties by
    account id (a total order); ``limit`` after ``orderBy`` plans a
    TakeOrderedAndProject: each partition keeps its own top-k."""
    acts = account_activity(ledger.facts, "name_dest", with_values=True)
    top_rows = ledger.named_accounts(acts.orderBy(F.col("value_cents").desc(), F.col("name_dest").asc()).limit(top), "name_dest")
    return top_rows.select(
        F.col("name_dest").alias("account_id"),
        party_type(F.col("name_dest")).alias("party_type"),
        F.col("txn_count").alias("txns_received"),
        millions("value_cents").alias("value_received_millions"),
        "active_days",
        F.col("fraud_txns").alias("fraud_txns_received"),
        ratio_half_up("value_cents", "txn_count * 100", 2).alias("avg_value_per_txn"),
    )


def _recurrence(acts: DataFrame, role: str) -> DataFrame:
    single = F.count_if(F.col("txn_count") == 1)
    multi = F.count_if(F.col("active_days") > 1)
    s = acts.agg(
        F.count(F.lit(1)).alias("distinct_accounts"),
        single.alias("single_txn_accounts"),
        multi.alias("multi_day_accounts"),
        F.max("txn_count").alias("max_txns"),
        F.sum("txn_count").alias("_txns"),
    )
    n = F.col("distinct_accounts")
    return s.select(
        F.lit(role).alias("account_role"),
        "distinct_accounts",
        "single_txn_accounts",
        pct("single_txn_accounts", "distinct_accounts", 2).alias("pct_single_txn"),
        "multi_day_accounts",
        pct("multi_day_accounts", "distinct_accounts", 2).alias("pct_multi_day"),
        "max_txns",
        ratio_half_up("_txns", "distinct_accounts", 3).alias("avg_txns"),
    )


def growth_account_recurrence(ledger) -> DataFrame:
    return _recurrence(account_activity(ledger.facts, "name_orig"), "ORIGINATOR").unionByName(
        _recurrence(account_activity(ledger.facts, "name_dest"), "DESTINATION")
    )
