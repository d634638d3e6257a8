"""Risk marts: fraud attribution, fraud by type / amount band, the incumbent
rule's confusion matrix and the ledger balance signature.

Fraud-only work adds up ``ledger.fraud_cells`` (one filtered scan); marts by
type or band add up ``ledger.cells``. Both are hash aggregates over small keys
with map-side partial sums, so a hot key never reaches one reducer whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.bands import band_label_by_id
from ledgerlens.functions.numeric import ratio_half_up
from ledgerlens.operators.common import cell_sums, millions, money, pct, sum_cents, with_type_names
from ledgerlens.schemas import ATTRIBUTION_BUCKETS, FIRST_LEG_TYPE, NOT_COUNTED, RESIDUAL_TOLERANCE, SECOND_LEG_TYPE


def _tol():
    return F.lit(RESIDUAL_TOLERANCE)


def attribution_totals(ledger) -> DataFrame:
    """(attributed_to, basis, bucket_order, fraud_txns, loss_cents) for the
    three buckets. One global aggregate over the fraud rows (partial sums per
    partition) exploded into the three rows, so every bucket is present even
    when empty (count 0, loss NULL) without a join."""
    bucket = (
        F.when(F.col("is_duplicate_leg"), F.lit(2))
        .when(F.col("type_name") == FIRST_LEG_TYPE, F.lit(0))
        .when(F.col("type_name") == SECOND_LEG_TYPE, F.lit(1))
    )
    b = ledger.fraud_cells.select(bucket.alias("b"), "fraud_txns", "value")
    aggs = []
    for i, _ in enumerate(ATTRIBUTION_BUCKETS):
        aggs += [
            F.coalesce(F.sum(F.when(F.col("b") == i, F.col("fraud_txns"))), F.lit(0)).alias(f"n{i}"),
            sum_cents(F.when(F.col("b") == i, F.col("value"))).alias(f"c{i}"),
        ]
    one = b.agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("attributed_to"),
            F.lit(basis).alias("basis"),
            F.lit(i).alias("bucket_order"),
            F.col(f"n{i}").alias("fraud_txns"),
            F.col(f"c{i}").alias("loss_cents"),
        )
        for i, (name, basis) in enumerate(ATTRIBUTION_BUCKETS)
    ])
    return one.select(F.inline(rows))


def fraud_loss_attribution(ledger) -> DataFrame:
    t = attribution_totals(ledger)
    return t.select(
        "attributed_to",
        "basis",
        "fraud_txns",
        money(F.col("loss_cents")).alias("attributed_loss"),
        millions("loss_cents").alias("attributed_loss_millions"),
        (F.col("attributed_to") != F.lit(NOT_COUNTED)).alias("counts_toward_true_loss"),
    ).orderBy(F.col("loss_cents").desc_nulls_first())


def risk_fraud_by_type(ledger) -> DataFrame:
    agg = ledger.sums("transaction_type_key")
    named = with_type_names(agg, ledger.dim_type, "is_fraud_bearing")
    fraud = "coalesce(fraud_cents, 0)"
    return named.select(
        "type_name",
        "is_fraud_bearing",
        F.col("txn_count").alias("total_txns"),
        "fraud_txns",
        pct("fraud_txns", "txn_count", 4).alias("fraud_rate_pct"),
        millions(fraud).alias("gross_fraud_value_millions"),
        pct(fraud, "value_cents", 4).alias("fraud_pct_of_type_value"),
        ratio_half_up(fraud, "fraud_txns * 100", 2).alias("avg_fraud_amount"),
        "flagged_txns",
        F.col("flagged_fraud_txns").alias("flagged_and_fraud"),
        pct("flagged_fraud_txns", "fraud_txns", 4).alias("incumbent_rule_recall_pct"),
    ).orderBy(F.col("fraud_txns").desc())


def risk_fraud_by_amount_band(ledger) -> DataFrame:
    agg = ledger.sums("band_id")
    # share of all fraud value: a window over at most six aggregated rows
    return agg.select(
        band_label_by_id(F.col("band_id")).alias("amount_band"),
        F.col("txn_count").alias("total_txns"),
        "fraud_txns",
        pct("fraud_txns", "txn_count", 4).alias("fraud_rate_pct"),
        millions("coalesce(fraud_cents, 0)").alias("gross_fraud_value_millions"),
        pct("coalesce(fraud_cents, 0)", "sum(fraud_cents) OVER ()", 2).alias("pct_of_all_fraud_value"),
    ).orderBy("amount_band")


def risk_flagged_vs_actual(ledger) -> DataFrame:
    c = ledger.cells.agg(*cell_sums(loss=False)).selectExpr(
        "flagged_fraud_txns AS true_positives",
        "flagged_txns - flagged_fraud_txns AS false_positives",
        "fraud_txns - flagged_fraud_txns AS false_negatives",
        "txn_count - fraud_txns - flagged_txns + flagged_fraud_txns AS true_negatives",
        "coalesce(missed_cents, 0) AS missed_cents",
    )
    return c.select(
        "true_positives",
        "false_positives",
        "false_negatives",
        "true_negatives",
        pct("true_positives", "true_positives + false_positives", 2).alias("precision_pct"),
        pct("true_positives", "true_positives + false_negatives", 4).alias("recall_pct"),
        millions("missed_cents").alias("gross_value_missed_millions"),
    )


def risk_balance_signature(ledger) -> DataFrame:
    orig_bad = F.abs(F.col("orig_balance_error")) > _tol()
    dest_bad = F.abs(F.col("dest_balance_error")) > _tol()
    agg = ledger.facts.groupBy("transaction_type_key", "is_fraud").agg(
        F.count(F.lit(1)).alias("txns"),
        F.count_if(orig_bad).alias("orig_inconsistent"),
        F.count("dest_balance_error").alias("dest_checkable_txns"),
        F.count_if(dest_bad).alias("dest_inconsistent"),
    )
    named = with_type_names(agg, ledger.dim_type)
    return named.select(
        "type_name",
        "is_fraud",
        "txns",
        "orig_inconsistent",
        pct("orig_inconsistent", "txns", 2).alias("pct_orig_inconsistent"),
        "dest_checkable_txns",
        "dest_inconsistent",
        pct("dest_inconsistent", "dest_checkable_txns", 2).alias("pct_dest_inconsistent"),
    ).orderBy("type_name", "is_fraud")
