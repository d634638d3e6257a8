"""Plan shape: fees inline (no Python UDF), top-k without a global sort,
fixed dimensions resolved without joins, no global ROW_NUMBER window, and
the fraud subset read with a pushed-down filter."""

import os
import re
import tempfile

import pytest

from ledgerlens.operators import growth, profitability
from ledgerlens.plans import pipeline
from ledgerlens.plans.model import Ledger
from ledgerlens.plans.registry import queries
from ledgerlens.sources.staging import staging_from_sf_dir
from tests.conftest import SMOKE_DIR


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fee_is_an_expression(spark):
    L = Ledger.from_sf_dir(spark, SMOKE_DIR)
    p = plan(profitability.profitability_by_type(L))
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_top_destinations_is_take_ordered(spark):
    L = Ledger.from_sf_dir(spark, SMOKE_DIR)
    assert "TakeOrderedAndProject" in plan(growth.growth_top_destinations(L))


def test_no_global_row_number(spark):
    L = Ledger.from_sf_dir(spark, SMOKE_DIR)
    p = plan(L.fact)
    assert "row_number" not in p.lower()


def test_fraud_filter_is_pushed_to_the_written_fact(spark):
    out = tempfile.mkdtemp(prefix="ll-plan-")
    pipeline.build_star(spark, staging_from_sf_dir(spark, SMOKE_DIR), out)
    fact = spark.read.parquet(os.path.join(out, "fact_transactions"))
    written = Ledger(spark, None, {"fact": fact})
    for df in (written.duplicate_legs, written.fraud_cells):
        pushed = re.findall(r"PushedFilters: \[[^\]]*", plan(df))
        assert pushed and all("EqualTo(is_fraud,true)" in f for f in pushed)


# Scans of the source that each query plans (a scan under a reused exchange
# counts once). Keyed queries read their key tables; those are counted too.
SCANS = {
    "account_coverage": 8, "assert_fraud_bearing": 1, "assert_merchant_rule": 1, "assert_payment_dest_untracked": 1,
    "balance_deltas": 2, "balance_error_by_fraud": 1, "balance_error_by_type": 1, "check_date_dense": 3,
    "check_grain": 6, "check_measures": 7, "check_orphans": 6, "check_row_count": 7, "constraint_violations": 14,
    "dashboard_daily": 5, "dashboard_data_caveats": 5, "dashboard_date": 2, "dashboard_fraud_waterfall": 2,
    "dashboard_kpi": 2, "dim_accounts": 2, "dim_date": 1, "dimension_row_counts": 9, "duplicate_cashout_legs": 4,
    "evidence_amount_stats": 1, "evidence_chain_trace": 3, "evidence_fraud_size_ratio": 1, "evidence_full_drain": 1,
    "evidence_leg_pairs": 4, "evidence_merchant_payment": 1, "evidence_naive_residual": 1,
    "evidence_round_amount_cluster": 1, "evidence_zero_amount": 1, "fact_transactions": 6, "fraud_by_type_star": 6,
    "fraud_loss_attribution": 1, "growth_account_recurrence": 2, "growth_daily_activity": 2, "growth_daily_by_type": 1,
    "incremental_duplicate_legs": 1, "incremental_fraud_loss_attribution": 3,
    "incremental_profitability_by_type_and_band": 2, "incremental_profitability_daily": 2,
    "growth_hourly_profile": 1, "growth_top_destinations": 1, "ledger_residuals": 2, "measure_cards": 3,
    "measure_daily_value_complete": 4, "measure_fraud_pct_gross_profit": 2, "measure_fraud_rate": 1,
    "measure_is_loss_making": 2, "measure_rule_recall": 1, "measure_take_rate": 2, "measure_value_7d_avg": 6,
    "party_type_split": 2, "product_mix": 1, "profile_dest_prefix": 1, "profile_dest_recurrence": 1,
    "profile_fraud_rate": 2, "profile_orig_distribution": 1, "profile_orig_multi_day": 1, "profile_orig_recurrence": 1,
    "profile_row_count": 1, "profile_step_range": 1, "profile_type_distribution": 1, "profit_heatmap": 2,
    "profitability_by_type": 2, "profitability_by_type_and_band": 2, "profitability_daily": 2,
    "profitability_summary": 2, "risk_balance_signature": 1, "risk_flagged_vs_actual": 1,
    "risk_fraud_by_amount_band": 1, "risk_fraud_by_type": 1, "type_share": 1, "what_if_uncapped_fee": 3,
}


@pytest.fixture(scope="module")
def plans(spark):
    """The physical plan of every registered query of the reference."""
    return {name: plan(q(spark, SMOKE_DIR)) for name, q in queries().items()}


def test_every_query_scans_no_more_than_it_must(plans):
    assert set(plans) == set(SCANS)
    over = {n: (p.count("FileScan"), SCANS[n]) for n, p in plans.items() if p.count("FileScan") > SCANS[n]}
    assert over == {}


def test_no_cartesian_or_python_in_any_query(plans):
    """No query plans a cartesian product, a nested-loop join or a Python UDF."""
    ops = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
    assert {n: [op for op in ops if op in p] for n, p in plans.items() if any(op in p for op in ops)} == {}


def test_distinct_accounts_do_not_multiply_rows(plans):
    """Expand only for grouping sets, which run over the few cells."""
    assert [n for n, p in plans.items() if "Expand" in p] == ["measure_cards"]
