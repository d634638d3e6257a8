"""Profitability marts: fee revenue - processing cost = gross profit;
gross - deduplicated fraud loss = net profit.

Money is summed exactly: amounts and costs in cents, fees in 1e-7 units. Every
mart adds up ``ledger.net_cells``: one scan for the sums by (day, type, band)
and one over fraud rows for the duplicate legs to take off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.bands import band_label_by_id
from ledgerlens.functions.fees import FEE_SCALE
from ledgerlens.functions.numeric import ratio_half_up
from ledgerlens.operators.common import cell_sums, fee_units_of_cents, hours_seen, millions, pct, with_type_names


def _net_u(loss_col: str = "loss_cents") -> str:
    """SQL text: net profit in fee units (fee - cost - loss)."""
    return f"fee_u - {fee_units_of_cents('cost_cents')} - {fee_units_of_cents(loss_col)}"


def _gross_u() -> str:
    return f"fee_u - {fee_units_of_cents('cost_cents')}"


def profitability_by_type(ledger) -> DataFrame:
    agg = ledger.net_cells.groupBy("transaction_type_key").agg(*cell_sums())
    combined = with_type_names(agg, ledger.dim_type).withColumn("loss_cents", F.col("true_cents"))
    fee_den = 10 ** FEE_SCALE
    return combined.select(
        "type_name",
        "txn_count",
        millions("value_cents").alias("total_value_millions"),
        millions("fee_u", FEE_SCALE).alias("fee_revenue_millions"),
        millions("cost_cents").alias("processing_cost_millions"),
        millions(_gross_u(), FEE_SCALE).alias("gross_profit_millions"),
        millions("loss_cents").alias("fraud_loss_millions"),
        millions(_net_u(), FEE_SCALE).alias("net_profit_millions"),
        ratio_half_up("fee_u", f"txn_count * {fee_den}", 4).alias("avg_fee_per_txn"),
        pct("fee_u", fee_units_of_cents("value_cents"), 4).alias("effective_take_rate_pct"),
        "txns_hitting_cap",
        "txns_hitting_floor",
        pct("txns_hitting_cap", "txn_count", 2).alias("pct_hitting_cap"),
        F.expr(f"({_net_u()}) < 0").alias("is_loss_making"),
    ).orderBy(F.col("net_profit_millions").desc())


def profitability_by_type_and_band(ledger) -> DataFrame:
    agg = ledger.net_cells.groupBy("transaction_type_key", "band_id").agg(*cell_sums())
    named = with_type_names(agg).withColumn("amount_band", band_label_by_id(F.col("band_id")))
    return named.select(
        "type_name",
        "amount_band",
        "txn_count",
        millions("value_cents").alias("total_value_millions"),
        millions("fee_u", FEE_SCALE).alias("fee_revenue_millions"),
        millions("cost_cents").alias("processing_cost_millions"),
        millions("loss_cents").alias("fraud_loss_millions"),
        millions(_net_u(), FEE_SCALE).alias("net_profit_millions"),
        pct("fee_u", fee_units_of_cents("value_cents"), 4).alias("effective_take_rate_pct"),
        F.expr(f"({_net_u()}) < 0").alias("is_loss_making"),
    ).orderBy("type_name", "amount_band")


def profitability_daily(ledger) -> DataFrame:
    d = ledger.net_cells.groupBy("day_number").agg(*cell_sums())
    # running total over at most one row per simulated day
    running = f"sum({_net_u()}) OVER (ORDER BY day_number RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return d.select(
        F.col("day_number").cast("long").alias("day_number"),
        "txn_count",
        millions("fee_u", FEE_SCALE).alias("fee_revenue_millions"),
        millions("cost_cents").alias("processing_cost_millions"),
        millions(_gross_u(), FEE_SCALE).alias("gross_profit_millions"),
        millions("loss_cents").alias("fraud_loss_millions"),
        millions(_net_u(), FEE_SCALE).alias("net_profit_millions"),
        (hours_seen() == 24).alias("is_complete_day"),
        millions(running, FEE_SCALE).alias("cumulative_net_profit_millions"),
    ).orderBy("day_number")


def profitability_summary(ledger, extra: list | None = None) -> DataFrame:
    """One row; ``extra`` columns are computed from the same aggregate row."""
    s = ledger.net_cells.agg(*cell_sums()).withColumn("fraud_cents", F.coalesce(F.col("fraud_cents"), F.lit(0)))
    return s.select(
        F.col("txn_count").alias("total_txns"),
        ratio_half_up("value_cents", 10**11, 2).alias("total_value_billions"),
        millions("fee_u", FEE_SCALE).alias("fee_revenue_millions"),
        millions("cost_cents").alias("processing_cost_millions"),
        millions(_gross_u(), FEE_SCALE).alias("gross_profit_millions"),
        millions("fraud_cents").alias("gross_fraud_loss_millions"),
        millions("true_cents").alias("deduplicated_fraud_loss_millions"),
        millions("fraud_cents - true_cents").alias("double_counted_millions"),
        millions(_net_u("true_cents"), FEE_SCALE).alias("net_profit_millions"),
        pct("true_cents", "value_cents", 4).alias("fraud_pct_of_total_value"),
        *(extra or []),
    )
