"""Query registry: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (``events`` -> staging -> star), so its
work grows with the data. Results are normalised at the boundary: integers
to BIGINT, decimals to DOUBLE, dates to ISO text, matching the oracle texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import dashboard, evidence, growth, measures, profile, profitability, quality, risk
from ledgerlens.plans import increments
from ledgerlens.plans.model import Ledger

Mart = Callable[[Ledger], DataFrame]


def normalise(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


MARTS: dict[str, Mart] = {
    # risk
    "fraud_loss_attribution": risk.fraud_loss_attribution,
    "risk_fraud_by_type": risk.risk_fraud_by_type,
    "risk_fraud_by_amount_band": risk.risk_fraud_by_amount_band,
    "risk_flagged_vs_actual": risk.risk_flagged_vs_actual,
    "risk_balance_signature": risk.risk_balance_signature,
    # growth
    "growth_daily_activity": growth.growth_daily_activity,
    "growth_daily_by_type": growth.growth_daily_by_type,
    "growth_hourly_profile": growth.growth_hourly_profile,
    "growth_top_destinations": growth.growth_top_destinations,
    "growth_account_recurrence": growth.growth_account_recurrence,
    # profitability
    "profitability_by_type": profitability.profitability_by_type,
    "profitability_by_type_and_band": profitability.profitability_by_type_and_band,
    "profitability_daily": profitability.profitability_daily,
    "profitability_summary": profitability.profitability_summary,
    # dashboard
    "dashboard_date": dashboard.dashboard_date,
    "dashboard_kpi": dashboard.dashboard_kpi,
    "dashboard_daily": dashboard.dashboard_daily,
    "dashboard_fraud_waterfall": dashboard.dashboard_fraud_waterfall,
    "dashboard_data_caveats": dashboard.dashboard_data_caveats,
    # staging profile
    "profile_row_count": lambda L: profile.profile_row_count(L.stg),
    "profile_type_distribution": lambda L: profile.profile_type_distribution(L.stg),
    "profile_fraud_rate": lambda L: profile.profile_fraud_rate(L.stg),
    "profile_step_range": lambda L: profile.profile_step_range(L.stg),
    "profile_orig_recurrence": lambda L: profile.profile_orig_recurrence(L.stg),
    "profile_orig_distribution": lambda L: profile.profile_orig_distribution(L.stg),
    "profile_orig_multi_day": lambda L: profile.profile_orig_multi_day(L.stg),
    "profile_dest_recurrence": lambda L: profile.profile_dest_recurrence(L.stg),
    "profile_dest_prefix": lambda L: profile.profile_dest_prefix(L.stg),
    # star
    "dim_date": lambda L: L.dim_date,
    "dim_accounts": lambda L: L.accounts,
    "fact_transactions": lambda L: L.fact,
    "balance_deltas": lambda L: L.residuals.select("transaction_key", "orig_balance_delta", "dest_balance_delta"),
    "ledger_residuals": lambda L: L.residuals.select("transaction_key", "orig_balance_error", "dest_balance_error"),
    "duplicate_cashout_legs": lambda L: L.duplicate_legs,
    # batches: staging applied in three, then the state's legs and marts
    "incremental_duplicate_legs": lambda L: increments.in_batches(L.spark, L.stg).duplicate_legs(),
    "incremental_profitability_by_type_and_band": lambda L: profitability.profitability_by_type_and_band(
        increments.in_batches(L.spark, L.stg).ledger()
    ),
    "incremental_profitability_daily": lambda L: profitability.profitability_daily(increments.in_batches(L.spark, L.stg).ledger()),
    "incremental_fraud_loss_attribution": lambda L: risk.fraud_loss_attribution(increments.in_batches(L.spark, L.stg).ledger()),
    # quality
    "assert_payment_dest_untracked": lambda L: quality.assert_payment_dest_untracked(L.stg),
    "assert_fraud_bearing": lambda L: quality.assert_fraud_bearing(L.stg, L.dim_type),
    "assert_merchant_rule": lambda L: quality.assert_merchant_rule(L.stg),
    "check_row_count": lambda L: quality.check_row_count(L.stg, L.fact),
    "check_measures": lambda L: quality.check_measures(L.stg, L.fact),
    "check_grain": lambda L: quality.check_grain(L.fact),
    "check_orphans": lambda L: quality.check_orphans(L.fact, L.dim_date, L.dim_type, L.accounts),
    "dimension_row_counts": lambda L: quality.dimension_row_counts(L.dim_date, L.dim_type, L.accounts, L.fact),
    "check_date_dense": lambda L: quality.check_date_dense(L.dim_date, L.stg),
    "account_coverage": lambda L: quality.account_coverage(L.fact, L.accounts),
    "party_type_split": lambda L: quality.party_type_split(L.accounts),
    "balance_error_by_fraud": lambda L: quality.balance_error_by_fraud(L.facts),
    "balance_error_by_type": lambda L: quality.balance_error_by_type(L.facts, L.dim_type),
    "fraud_by_type_star": lambda L: quality.fraud_by_type_star(L.fact, L.dim_type),
    "constraint_violations": lambda L: quality.constraint_violations(
        L.stg, L.dim_date, L.dim_type, L.accounts, L.fee_model, L.fact, L.duplicate_legs
    ),
    # evidence
    "evidence_leg_pairs": evidence.evidence_leg_pairs,
    "evidence_full_drain": evidence.evidence_full_drain,
    "evidence_chain_trace": evidence.evidence_chain_trace,
    "what_if_uncapped_fee": evidence.what_if_uncapped_fee,
    "evidence_round_amount_cluster": evidence.evidence_round_amount_cluster,
    "evidence_zero_amount": evidence.evidence_zero_amount,
    "evidence_naive_residual": evidence.evidence_naive_residual,
    "evidence_amount_stats": evidence.evidence_amount_stats,
    "type_share": evidence.type_share,
    "evidence_fraud_size_ratio": evidence.evidence_fraud_size_ratio,
    "evidence_merchant_payment": evidence.evidence_merchant_payment,
    # BI measures
    "measure_cards": measures.measure_cards,
    "measure_fraud_pct_gross_profit": measures.measure_fraud_pct_gross_profit,
    "measure_daily_value_complete": measures.measure_daily_value_complete,
    "measure_value_7d_avg": measures.measure_value_7d_avg,
    "measure_fraud_rate": measures.measure_fraud_rate,
    "measure_rule_recall": measures.measure_rule_recall,
    "measure_take_rate": measures.measure_take_rate,
    "measure_is_loss_making": measures.measure_is_loss_making,
    "profit_heatmap": measures.profit_heatmap,
    "product_mix": measures.product_mix,
}


# The BI layer: the marts a report imports.
BI_MARTS = [
    "fraud_loss_attribution", "risk_fraud_by_type", "risk_fraud_by_amount_band", "risk_flagged_vs_actual",
    "risk_balance_signature", "growth_daily_activity", "growth_daily_by_type", "growth_hourly_profile",
    "growth_top_destinations", "growth_account_recurrence", "profitability_by_type",
    "profitability_by_type_and_band", "profitability_daily", "profitability_summary", "dashboard_date",
    "dashboard_kpi", "dashboard_daily", "dashboard_fraud_waterfall", "dashboard_data_caveats",
]


def run_mart(mart: Mart, spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(mart(Ledger.from_sf_dir(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, _m=mart: run_mart(_m, spark, sf_dir)) for name, mart in MARTS.items()}
