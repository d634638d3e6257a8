"""BI-shaped marts: synthetic calendar, one-row KPI, the daily join, the fraud
waterfall and caveats computed from the data."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.fees import FEE_SCALE
from ledgerlens.functions.numeric import ratio_half_up
from ledgerlens.operators.common import beside, cell_sums, millions, pct, sum_cents
from ledgerlens.operators.growth import account_activity, with_accounts
from ledgerlens.operators.profitability import _gross_u, _net_u, profitability_summary
from ledgerlens.operators.risk import attribution_totals
from ledgerlens.operators.star import calendar_date
from ledgerlens.schemas import (
    CAVEATS,
    FINAL_DAY_COMPLETE,
    FINAL_DAY_PARTIAL,
    FIRST_LEG_TYPE,
    NOT_COUNTED,
    SECOND_LEG_TYPE,
    WATERFALL_STEPS,
)


def dashboard_date(ledger) -> DataFrame:
    """One row per simulated day between the first and last day of dim_date,
    with the hours dim_date holds for it (the calendar definition of a
    complete day)."""
    dd = ledger.dim_date
    hours = dd.groupBy("day_number").agg(F.count(F.lit(1)).alias("hours_observed"))
    bounds = dd.agg(F.min("day_number").cast("int").alias("lo"), F.max("day_number").cast("int").alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", "hi")).alias("day_number"))
    d = calendar_date(F.col("day_number"))
    return days.join(hours, "day_number").select(
        F.col("day_number").cast("long").alias("day_number"),
        d.cast("string").alias("simulated_date"),
        F.concat(F.lit("Day "), F.col("day_number").cast("string")).alias("day_label"),
        "hours_observed",
        (F.col("hours_observed") == 24).alias("is_complete_day"),
        F.date_format(d, "EEEE").alias("synthetic_weekday"),
        (F.floor(F.col("day_number") / 7) + 1).cast("long").alias("simulated_week"),
    ).orderBy("day_number")


def dashboard_kpi(ledger) -> DataFrame:
    s = profitability_summary(ledger, extra=[
        pct("fraud_txns", "txn_count", 4).alias("fraud_pct_of_txn_count")
    ])
    return s.select(
        "total_txns",
        "total_value_billions",
        "fee_revenue_millions",
        "processing_cost_millions",
        "gross_profit_millions",
        "net_profit_millions",
        F.col("deduplicated_fraud_loss_millions").alias("fraud_loss_millions"),
        F.col("gross_fraud_loss_millions").alias("fraud_loss_naive_millions"),
        "double_counted_millions",
        "fraud_pct_of_total_value",
        "fraud_pct_of_txn_count",
    )


def dashboard_daily(ledger) -> DataFrame:
    """Growth and profitability on one daily grain, with the calendar flag: the
    daily sums of ``net_cells``, the accounts of both roles and the calendar."""
    daily = with_accounts(ledger.net_cells.groupBy("day_number").agg(*cell_sums()), ledger)
    cal = dashboard_date(ledger).select(F.col("day_number").cast("int").alias("day_number"), "simulated_date",
                                        "is_complete_day")
    running = f"sum({_net_u()}) OVER (ORDER BY day_number RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return daily.join(cal, "day_number").select(
        F.col("day_number").cast("long").alias("day_number"),
        "simulated_date",
        "is_complete_day",
        "txn_count",
        millions("value_cents").alias("total_value_millions"),
        "active_originators",
        "active_destinations",
        ratio_half_up("value_cents", "txn_count * 100", 2).alias("avg_txn_value"),
        millions("fee_u", FEE_SCALE).alias("fee_revenue_millions"),
        millions("cost_cents").alias("processing_cost_millions"),
        millions(_gross_u(), FEE_SCALE).alias("gross_profit_millions"),
        millions("loss_cents").alias("fraud_loss_millions"),
        millions(_net_u(), FEE_SCALE).alias("net_profit_millions"),
        millions(running, FEE_SCALE).alias("cumulative_net_profit_millions"),
    ).orderBy("day_number")


def dashboard_fraud_waterfall(ledger) -> DataFrame:
    """Three signed bars from one aggregate row (explode, no re-scan)."""
    naive = ledger.fraud_cells.agg(sum_cents("value").alias("naive_cents"))
    parts = attribution_totals(ledger).agg(
        F.sum(F.when(F.col("attributed_to") == NOT_COUNTED, F.col("loss_cents"))).alias("dup_cents"),
        F.sum(F.when(F.col("attributed_to") != NOT_COUNTED, F.col("loss_cents"))).alias("true_cents"),
    )
    t = beside(naive, parts)
    def bar(order: int, step: str, value, kind: str):
        return F.struct(
            F.lit(order).cast("long").alias("sort_order"),
            F.lit(step).alias("step"),
            value.alias("value_millions"),
            F.lit(kind).alias("bar_type"),
        )

    values = {1: millions("naive_cents"), 2: F.lit(0.0) - millions("dup_cents"), 3: millions("true_cents")}
    bars = F.array(*[bar(order, step, values[order], kind) for order, step, kind in WATERFALL_STEPS])
    return t.select(F.inline(bars)).orderBy("sort_order")


def _dec(c, scale: int = 2):
    """A published figure as fixed-point text (e.g. '7492.72')."""
    return c.cast(f"decimal(24,{scale})").cast("string")


def _n(c):
    return c.cast("long").cast("string")


def dashboard_data_caveats(ledger) -> DataFrame:
    """The caveats that must travel with the marts, as data. Every figure in
    the texts is computed from the tables (one aggregate row per source)."""
    s = profitability_summary(ledger).select(
        "deduplicated_fraud_loss_millions", "gross_fraud_loss_millions", "total_value_billions"
    )
    # dim_date is dense, so the last day's hours follow from its bounds
    steps = ledger.dim_date.agg(F.min("date_key").alias("min_step"), F.max("date_key").alias("max_step")).selectExpr(
        "min_step",
        "max_step",
        "CAST(floor((max_step - 1) / 24) AS INT) AS last_day",
        "max_step - greatest(min_step, max_step - pmod(max_step - 1, 24)) + 1 AS last_day_hours",
    )
    orig = account_activity(ledger.facts, "name_orig").agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if(F.col("txn_count") == 1).alias("single"), F.count_if(F.col("active_days") > 1).alias("multi")
    ).select(pct("single", "accounts", 2).alias("pct_single"), pct("multi", "accounts", 2).alias("pct_multi"))
    fraud, bad = F.col("is_fraud"), F.abs(F.col("orig_balance_error")) > F.lit(0.01).cast("decimal(3,2)")
    tenm = F.col("amount") == F.lit(10_000_000)
    cash_out = F.col("type_name") == SECOND_LEG_TYPE
    zero = (F.col("amount") == 0) & fraud & cash_out
    rows = ledger.priced.agg(
        F.count_if(fraud).alias("fraud"),
        F.count_if(~fraud).alias("legit"),
        F.count_if(fraud & bad).alias("fraud_bad_rows"),
        F.count_if(~fraud & bad).alias("legit_bad_rows"),
        F.count_if(tenm & cash_out).alias("cashout_10m"),
        F.count_if(tenm & cash_out & fraud).alias("cashout_10m_fraud"),
        F.count_if(tenm & (F.col("type_name") == FIRST_LEG_TYPE) & ~fraud).alias("transfer_10m_legit"),
        F.count_if(zero).alias("zero_rows"),
        F.coalesce(F.sum(F.when(zero, F.col("fee_u"))), F.lit(0)).alias("zero_fee_u"),
    ).select("*", pct("fraud_bad_rows", "fraud", 2).alias("fraud_bad"), pct("legit_bad_rows", "legit", 2).alias("legit_bad"))
    row = beside(s, steps, orig, rows)
    c = F.col
    figures = {
        "true_loss_m": _dec(c("deduplicated_fraud_loss_millions")),
        "naive_loss_m": _dec(c("gross_fraud_loss_millions")),
        "min_step": _n(c("min_step")),
        "max_step": _n(c("max_step")),
        "days": _n(c("last_day") + 1),
        "last_day": _n(c("last_day")),
        "last_day_hours": _n(c("last_day_hours")),
        "final_day_note": F.when(c("last_day_hours") < 24, F.lit(FINAL_DAY_PARTIAL)).otherwise(F.lit(FINAL_DAY_COMPLETE)),
        "pct_single": _dec(c("pct_single")),
        "pct_multi": _dec(c("pct_multi")),
        "fraud_bad": _dec(c("fraud_bad")),
        "legit_bad": _dec(c("legit_bad")),
        "cashout_10m_fraud": _n(c("cashout_10m_fraud")),
        "cashout_10m": _n(c("cashout_10m")),
        "transfer_10m_legit": _n(c("transfer_10m_legit")),
        "total_bn": _dec(c("total_value_billions")),
        "zero_rows": _n(c("zero_rows")),
        "zero_fee": _dec(c("zero_fee_u").cast("decimal(38,0)") / F.lit(10**7)),
    }

    def render(template: str):
        parts = re.split(r"\{(\w+)\}", template)  # literal, name, literal, name, ...
        cols = [figures[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2]
        return F.concat(*cols) if len(cols) > 1 else cols[0]

    items = F.array(*[
        F.struct(F.lit(i).cast("long").alias("caveat_id"), F.lit(topic).alias("applies_to"),
                 render(template).alias("caveat_text"))
        for i, topic, template in CAVEATS
    ])
    return row.select(F.inline(items)).orderBy("caveat_id")
