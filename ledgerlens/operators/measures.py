"""BI measures re-aimed as DataFrame operators over the marts.

Each measure takes either a ``Ledger`` (the marts are computed, as a
registered query must) or ``WrittenMarts`` (the pipeline evaluates them over
the marts it has just written, like a BI layer over imported tables).

Ratios are always recomputed from summed numerators and denominators, never
averaged. Sums over published (rounded) columns are exact: each rounded value
is turned back into integer hundredths before summing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import ratio_half_up
from ledgerlens.operators import dashboard, growth, profitability, risk
from ledgerlens.functions.fees import FEE_SCALE
from ledgerlens.operators.common import beside, cell_sums, millions, money, pct
from ledgerlens.schemas import BAND_LABELS, TRANSACTION_TYPES


class WrittenMarts:
    """Marts already written by the pipeline (one folder per mart): measures
    evaluated over them read a few hundred rows instead of the fact."""

    def __init__(self, spark, marts_dir: str):
        self.spark, self.marts_dir = spark, marts_dir

    def read(self, name: str) -> DataFrame:
        import os

        return self.spark.read.parquet(os.path.join(self.marts_dir, name))


_MART_FUNCS = {
    "dashboard_kpi": lambda L: dashboard.dashboard_kpi(L),
    "dashboard_daily": lambda L: dashboard.dashboard_daily(L),
    "dashboard_date": lambda L: dashboard.dashboard_date(L),
    "risk_fraud_by_type": lambda L: risk.risk_fraud_by_type(L),
    "risk_flagged_vs_actual": lambda L: risk.risk_flagged_vs_actual(L),
    "profitability_by_type": lambda L: profitability.profitability_by_type(L),
    "profitability_by_type_and_band": lambda L: profitability.profitability_by_type_and_band(L),
    "growth_daily_by_type": lambda L: growth.growth_daily_by_type(L),
}


def _mart(source, name: str) -> DataFrame:
    """A mart from written files, or computed from a ledger."""
    if isinstance(source, WrittenMarts):
        return source.read(name)
    return _MART_FUNCS[name](source)


def hundredths(col: str) -> Column:
    """A published 2-dp figure back to exact integer hundredths."""
    return F.expr(hundredths_sql(col))


def hundredths_sql(col: str) -> str:
    return f"CAST(round({col} * 100D) AS DECIMAL(38,0))"


def _sum2(df: DataFrame, col: str, alias: str) -> Column:
    return money(F.sum(hundredths(col))).alias(alias)


def measure_cards(source) -> DataFrame:
    """The plain SUM cards of the report, on one row."""
    figures = _written_card_parts(source) if isinstance(source, WrittenMarts) else _ledger_card_parts(source)
    return beside(*figures).select(*CARDS)  # every input is a single aggregated row


def _sums(df: DataFrame, **names: str) -> DataFrame:
    """Exact sums of published figures: result name -> column."""
    return df.agg(*[money(F.sum(hundredths(c))).alias(n) for n, c in names.items()])


def _written_card_parts(source: WrittenMarts) -> list[DataFrame]:
    daily, by_type = source.read("dashboard_daily"), source.read("profitability_by_type")
    return [
        source.read("dashboard_kpi").selectExpr(*KPI_CARDS),
        daily.agg(F.sum("txn_count").alias("daily_transactions"), F.sum("active_originators").alias("active_originators")),
        _sums(daily, daily_value_millions="total_value_millions", cumulative_net_profit_millions="cumulative_net_profit_millions"),
        source.read("risk_fraud_by_type").agg(F.sum("fraud_txns").alias("fraud_transactions")),
        source.read("risk_flagged_vs_actual").selectExpr("false_negatives AS frauds_missed", "gross_value_missed_millions AS value_missed_millions"),
        _sums(by_type, **TYPE_CARDS),
        _sums(source.read("profitability_by_type_and_band"), net_profit_band_millions="net_profit_millions"),
    ]


CARDS = [
    "total_transactions", "total_value_billions", "fee_revenue_millions", "gross_profit_millions", "net_profit_millions",
    "fraud_loss_millions", "fraud_loss_naive_millions", "fraud_pct_of_value", "fraud_pct_of_count", "daily_transactions",
    "daily_value_millions", "active_originators", "cumulative_net_profit_millions", "fraud_transactions", "frauds_missed",
    "value_missed_millions", "net_profit_by_type_millions", "fee_revenue_by_type_millions", "fraud_loss_by_type_millions",
    "net_profit_band_millions",
]
KPI_CARDS = [
    "total_txns AS total_transactions", "total_value_billions", "fee_revenue_millions", "gross_profit_millions",
    "net_profit_millions", "fraud_loss_millions", "fraud_loss_naive_millions",
    "fraud_pct_of_total_value AS fraud_pct_of_value", "fraud_pct_of_txn_count AS fraud_pct_of_count",
]
TYPE_CARDS = {
    "net_profit_by_type_millions": "net_profit_millions",
    "fee_revenue_by_type_millions": "fee_revenue_millions",
    "fraud_loss_by_type_millions": "fraud_loss_millions",
}


def _ledger_card_parts(ledger) -> list[DataFrame]:
    """The same figures from one pass over the net cells: sums for the whole,
    each type, each type and band, and each day come out of one aggregate with
    grouping sets over the few cell rows."""
    cells = ledger.net_cells.groupingSets(
        [[], [F.col("transaction_type_key")], [F.col("transaction_type_key"), F.col("band_id")], [F.col("day_number")]],
        "transaction_type_key", "band_id", "day_number",
    ).agg(F.grouping("transaction_type_key").alias("no_type"), F.grouping("band_id").alias("no_band"), F.grouping("day_number").alias("no_day"), *cell_sums())
    level = F.expr("CASE WHEN no_day = 0 THEN 'day' WHEN no_type = 1 THEN 'all' WHEN no_band = 1 THEN 'type' ELSE 'band' END")
    loss = "CASE WHEN level IN ('type', 'all') THEN true_cents ELSE loss_cents END"
    net = profitability._net_u(f"({loss})")
    running = f"sum(CASE WHEN level = 'day' THEN {net} END) OVER (PARTITION BY level ORDER BY day_number)"
    rows = cells.withColumn("level", level).select(
        "*",
        millions("value_cents").alias("value_m"),
        millions("fee_u", FEE_SCALE).alias("fee_m"),
        millions(loss).alias("loss_m"),
        millions(net, FEE_SCALE).alias("net_m"),
        millions(running, FEE_SCALE).alias("running_m"),
    )

    def total(at: str, column: str, name: str) -> Column:
        return money(F.sum(F.expr(f"CASE WHEN level = '{at}' THEN {hundredths_sql(column)} END"))).alias(name)

    def whole(column: str, name: str) -> Column:
        return F.max(F.when(F.col("level") == "all", F.col(column))).alias(name)

    days = F.col("level") == "day"
    one = rows.agg(
        *[whole(c, c) for c in ("txn_count", "fraud_txns", "flagged_fraud_txns", "value_cents", "fee_u", "cost_cents", "true_cents")],
        F.coalesce(whole("fraud_cents", "f"), F.lit(0)).alias("fraud_cents"),
        F.coalesce(whole("missed_cents", "m"), F.lit(0)).alias("missed_cents"),
        F.sum(F.when(days, F.col("txn_count"))).alias("daily_transactions"),
        total("day", "value_m", "daily_value_millions"),
        total("day", "running_m", "cumulative_net_profit_millions"),
        total("type", "net_m", "net_profit_by_type_millions"),
        total("type", "fee_m", "fee_revenue_by_type_millions"),
        total("type", "loss_m", "fraud_loss_by_type_millions"),
        total("band", "net_m", "net_profit_band_millions"),
    )
    cards = one.select(
        F.col("txn_count").alias("total_transactions"),
        ratio_half_up("value_cents", 10**11, 2).alias("total_value_billions"),
        millions("fee_u", FEE_SCALE).alias("fee_revenue_millions"),
        millions(profitability._gross_u(), FEE_SCALE).alias("gross_profit_millions"),
        millions(profitability._net_u("true_cents"), FEE_SCALE).alias("net_profit_millions"),
        millions("true_cents").alias("fraud_loss_millions"),
        millions("fraud_cents").alias("fraud_loss_naive_millions"),
        pct("true_cents", "value_cents", 4).alias("fraud_pct_of_value"),
        pct("fraud_txns", "txn_count", 4).alias("fraud_pct_of_count"),
        "daily_transactions",
        "daily_value_millions",
        "cumulative_net_profit_millions",
        F.col("fraud_txns").alias("fraud_transactions"),
        (F.col("fraud_txns") - F.col("flagged_fraud_txns")).alias("frauds_missed"),
        millions("missed_cents").alias("value_missed_millions"),
        *TYPE_CARDS,
        "net_profit_band_millions",
    )
    origins = growth.accounts_by_day(ledger, {"name_orig": "n"}).agg(F.sum("n").alias("active_originators"))
    return [cards, origins]


def measure_fraud_pct_gross_profit(ledger) -> DataFrame:
    """Fraud loss as a share of gross profit; blank (NULL) when gross is 0."""
    k = _mart(ledger, "dashboard_kpi")
    return k.select(
        ratio_half_up(hundredths_sql("fraud_loss_millions"), hundredths_sql("gross_profit_millions"), 4).alias(
            "fraud_as_share_of_gross_profit"
        )
    )


def measure_daily_value_complete(ledger) -> DataFrame:
    d = _mart(ledger, "dashboard_daily").where(F.col("is_complete_day"))
    return d.agg(money(F.sum(hundredths("total_value_millions"))).alias("daily_value_complete_days_millions"))


def measure_value_7d_avg(ledger) -> DataFrame:
    """Trailing 7-calendar-day mean of daily value per calendar day; days
    without a daily row are skipped (not counted as zero)."""
    dates = _mart(ledger, "dashboard_date").select("day_number", "simulated_date")
    daily = _mart(ledger, "dashboard_daily").select("day_number", hundredths("total_value_millions").alias("v"))
    week = "(ORDER BY day_number RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)"  # one row per simulated day
    j = dates.join(daily, "day_number", "left")
    return j.select(
        "day_number",
        "simulated_date",
        ratio_half_up(f"sum(v) OVER {week}", f"count(v) OVER {week} * 100", 4).alias("value_7d_avg_millions"),
    ).orderBy("day_number")


def measure_fraud_rate(ledger) -> DataFrame:
    t = _mart(ledger, "risk_fraud_by_type").agg(F.sum("fraud_txns").alias("f"), F.sum("total_txns").alias("n"))
    return t.select(ratio_half_up("f * 100", "n", 4).alias("fraud_rate_pct"))


def measure_rule_recall(ledger) -> DataFrame:
    r = _mart(ledger, "risk_flagged_vs_actual")
    tp, fn = F.col("true_positives"), F.col("false_negatives")
    return r.select(
        ratio_half_up("true_positives * 100", "true_positives + false_negatives", 4).alias(
            "incumbent_rule_recall_pct"
        ),
        F.col("false_negatives").alias("frauds_missed"),
        F.col("gross_value_missed_millions").alias("value_missed_millions"),
    )


def measure_take_rate(ledger) -> DataFrame:
    """Sum of fee revenue / sum of value over the per-type mart (value-weighted)."""
    t = _mart(ledger, "profitability_by_type").agg(
        F.sum(hundredths("fee_revenue_millions")).alias("fee"), F.sum(hundredths("total_value_millions")).alias("value")
    )
    return t.select(ratio_half_up("fee * 100", "value", 4).alias("effective_take_rate_pct"))


def measure_is_loss_making(ledger) -> DataFrame:
    t = _mart(ledger, "profitability_by_type")
    return t.select(
        "type_name",
        "net_profit_millions",
        F.when(F.col("net_profit_millions") < 0, 1).otherwise(0).cast("long").alias("is_loss_making"),
    ).orderBy("type_name")


def profit_heatmap(ledger) -> DataFrame:
    """Type x band matrix of net profit (M); the band list is fixed, so the
    pivot needs no extra pass to discover its values."""
    label_to_id = F.create_map(*[F.lit(x) for i, label in BAND_LABELS for x in (label, i)])
    b = _mart(ledger, "profitability_by_type_and_band").withColumn(
        "band_id", label_to_id[F.col("amount_band")]
    )
    keys = [f"band_{i}" for i, _ in BAND_LABELS]
    p = (
        b.select("type_name", F.concat(F.lit("band_"), F.col("band_id").cast("string")).alias("band"),
                 hundredths("net_profit_millions").alias("v"))
        .groupBy("type_name")
        .pivot("band", keys)
        .agg(F.sum("v"))
    )
    return p.select("type_name", *[money(F.col(k)).alias(k) for k in keys]).orderBy("type_name")


def product_mix(ledger) -> DataFrame:
    """Daily transaction count per type, one column per type (stacked chart)."""
    names = [t[1] for t in TRANSACTION_TYPES]
    d = _mart(ledger, "growth_daily_by_type")
    return d.groupBy("day_number").pivot("type_name", names).agg(F.sum("txn_count")).orderBy("day_number")
