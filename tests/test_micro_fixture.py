"""Hand-computed answers on the 9-row micro-fixture (zero amount, exactly
10M, partial days, single-use accounts, a caught fraud, a duplicate leg)."""

from pyspark.sql import functions as F

from ledgerlens.operators import growth, profitability, quality, risk
from ledgerlens.operators.common import cell_sums
from ledgerlens.operators.quality import fee_clamp_cases


def by(rows, key):
    return {r[key]: r for r in rows}


def test_fee_clamp_cases(spark):
    assert all(r["ok"] for r in fee_clamp_cases(spark).collect())


def test_attribution(micro):
    rows = by(risk.fraud_loss_attribution(micro).collect(), "attributed_to")
    assert (rows["TRANSFER"]["fraud_txns"], rows["TRANSFER"]["attributed_loss"]) == (2, 301000.00)
    assert (rows["CASH_OUT"]["fraud_txns"], rows["CASH_OUT"]["attributed_loss"]) == (2, 10000000.00)
    nc = rows["NOT COUNTED (duplicate leg)"]
    assert (nc["fraud_txns"], nc["attributed_loss"], nc["counts_toward_true_loss"]) == (1, 1000.00, False)


def test_summary(micro):
    s = micro.net_cells.agg(*cell_sums()).collect()[0]
    assert s["fraud_cents"] == 1030200000 and s["true_cents"] == 1030100000
    assert s["fee_u"] == 180420000000  # 18042.00 in 1e-7 units
    assert s["cost_cents"] == 1650
    net = profitability.profitability_summary(micro).collect()[0]
    assert net["net_profit_millions"] == -10.28  # -10282974.50
    assert net["double_counted_millions"] == 0.0


def test_fees_by_type(micro):
    rows = by(profitability.profitability_by_type(micro).collect(), "type_name")
    fee = {k: round(v["avg_fee_per_txn"] * v["txn_count"], 2) for k, v in rows.items()}
    assert fee == {"CASH_IN": 0.0, "CASH_OUT": 5025.0, "DEBIT": 6.0, "PAYMENT": 1.0, "TRANSFER": 13010.0}
    hits = {k: (v["txns_hitting_cap"], v["txns_hitting_floor"]) for k, v in rows.items()}
    assert hits == {"CASH_IN": (0, 0), "CASH_OUT": (1, 1), "DEBIT": (0, 0), "PAYMENT": (0, 1), "TRANSFER": (1, 0)}
    assert rows["CASH_OUT"]["fraud_loss_millions"] == 10.0
    assert rows["TRANSFER"]["fraud_loss_millions"] == 0.3


def test_confusion_and_false_positive(spark, micro, micro_rows):
    r = risk.risk_flagged_vs_actual(micro).collect()[0]
    assert (r["true_positives"], r["false_positives"], r["false_negatives"], r["true_negatives"]) == (1, 0, 4, 4)
    assert (r["precision_pct"], r["recall_pct"], r["gross_value_missed_millions"]) == (100.0, 20.0, 10.0)
    from ledgerlens.plans.model import Ledger
    from tests.conftest import staging_df

    rows = micro_rows[:-1] + [micro_rows[-1][:9] + (0, 1)]  # flagged but not fraud
    r = risk.risk_flagged_vs_actual(Ledger.from_staging(spark, staging_df(spark, rows))).collect()[0]
    assert (r["true_positives"], r["false_positives"], r["false_negatives"], r["true_negatives"]) == (0, 1, 4, 4)
    assert (r["precision_pct"], r["recall_pct"]) == (0.0, 0.0)


def test_residuals_and_keys(micro):
    f = micro.fact.orderBy("transaction_key").collect()
    assert [r["transaction_key"] for r in f] == list(range(1, 10))
    assert [float(r["orig_balance_error"]) for r in f] == [0, 0, 0, 0, -50, 0, 2000000, 300000, 0]
    dest = [None if r["dest_balance_error"] is None else float(r["dest_balance_error"]) for r in f]
    assert dest == [-1000, 0, 0, 0, None, 0, 0, -300000, 0]
    keys = {r["account_id"]: r["account_key"] for r in micro.accounts.collect()}
    assert keys == {"C1": 1, "C10": 2, "C11": 3, "C2": 4, "C3": 5, "C4": 6, "C5": 7, "C6": 8, "C7": 9,
                    "C8": 10, "C9": 11, "M1": 12}
    assert sorted(r["transaction_key"] for r in micro.duplicate_legs.collect()) == [2]


def test_daily_and_calendar(micro):
    from ledgerlens.operators import dashboard

    d = by(growth.growth_daily_activity(micro).collect(), "day_number")
    d0, d1 = d[0], d[1]
    assert (d0["txn_count"], d0["total_value"], d0["active_originators"], d0["active_destinations"],
            d0["hours_observed"]) == (4, 10002000.0, 4, 3, 3)
    assert (d1["txn_count"], d1["total_value"], d1["active_originators"], d1["active_destinations"],
            d1["hours_observed"]) == (5, 2301250.0, 5, 4, 2)
    assert d1["value_change_vs_prior_day"] == -7700750.0 and d0["value_change_vs_prior_day"] is None
    assert not d0["is_complete_day"] and not d1["is_complete_day"]
    cal = by(dashboard.dashboard_date(micro).collect(), "day_number")
    assert cal[0]["is_complete_day"] and not cal[1]["is_complete_day"]
    assert cal[0]["synthetic_weekday"] == "Monday" and cal[1]["simulated_date"] == "2024-01-02"
    assert micro.dim_date.count() == 26


def test_recurrence(micro):
    rows = by(growth.growth_account_recurrence(micro).collect(), "account_role")
    o, d = rows["ORIGINATOR"], rows["DESTINATION"]
    assert (o["distinct_accounts"], o["single_txn_accounts"], o["multi_day_accounts"], o["max_txns"],
            o["avg_txns"]) == (8, 7, 1, 2, 1.125)
    assert (d["distinct_accounts"], d["single_txn_accounts"], d["multi_day_accounts"], d["max_txns"],
            d["avg_txns"]) == (5, 3, 2, 3, 1.8)


def test_bands(micro):
    rows = by(risk.risk_fraud_by_amount_band(micro).collect(), "amount_band")
    got = {k[:1]: (v["total_txns"], v["fraud_txns"]) for k, v in rows.items()}
    assert got == {"1": (6, 3), "3": (1, 1), "5": (1, 0), "6": (1, 1)}
    assert "6. 10M and over" in rows  # exactly 10M falls in the top band


def test_properties(micro):
    """Sums agree across grains; shares add up; the confusion matrix covers all rows."""
    by_type = profitability.profitability_by_type(micro).agg(F.sum("txn_count")).collect()[0][0]
    by_band = profitability.profitability_by_type_and_band(micro).agg(F.sum("txn_count")).collect()[0][0]
    daily = profitability.profitability_daily(micro).orderBy("day_number").collect()
    assert by_type == by_band == sum(r["txn_count"] for r in daily) == 9
    summary = profitability.profitability_summary(micro).collect()[0]
    assert daily[-1]["cumulative_net_profit_millions"] == summary["net_profit_millions"]
    attr = {r["attributed_to"]: r["attributed_loss"] for r in risk.fraud_loss_attribution(micro).collect()}
    assert sum(attr.values()) == 10302000.0  # TRANSFER + CASH_OUT + duplicate = naive
    acc = quality.account_coverage(micro.fact, micro.accounts).collect()[0]
    assert acc["dim_account_rows"] == acc["distinct_originators"] + acc["distinct_destinations"] - acc[
        "accounts_in_both_roles"]


def test_caveats_partial_final_day(micro):
    from ledgerlens.operators import dashboard

    c = {r["caveat_id"]: r["caveat_text"] for r in dashboard.dashboard_data_caveats(micro).collect()}
    assert c[3] == "Day 1 holds 2 of 24 hours. Its sums are lower for that reason alone; is_complete_day filters it out."
    assert c[1].startswith("Each stolen sum counts once: 10.30M. Adding up every row marked as fraud would give 10.30M")
    assert c[9].startswith("1 fraud rows of type CASH_OUT move nothing.") and "charges 10.00 on them" in c[9]
