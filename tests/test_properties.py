"""Cross-grain properties on the driver fixture (exact units, before rounding)."""

from pyspark.sql import functions as F

from ledgerlens.operators import risk
from ledgerlens.operators.common import cell_sums
from ledgerlens.plans.model import Ledger
from tests.conftest import SMOKE_DIR


def test_loss_and_fees_agree_across_grains(spark):
    L = Ledger.from_sf_dir(spark, SMOKE_DIR)
    summary = L.net_cells.agg(*cell_sums()).collect()[0]
    days = L.net_cells.groupBy("day_number").agg(*cell_sums())
    daily = days.agg(F.sum("true_cents").alias("loss"), F.sum("fee_u").alias("fee"), F.sum("txn_count").alias("n")).collect()[0]
    attribution = {r["attributed_to"]: r["loss_cents"] for r in risk.attribution_totals(L).collect()}
    assert daily["loss"] == summary["true_cents"] == attribution["TRANSFER"] + attribution["CASH_OUT"]
    assert summary["fraud_cents"] == sum(v for v in attribution.values() if v is not None)
    assert daily["fee"] == summary["fee_u"] and daily["n"] == summary["txn_count"]
    by_type = L.priced.groupBy("transaction_type_key").agg(F.sum("fee_u").alias("f")).agg(F.sum("f")).collect()[0][0]
    assert by_type == summary["fee_u"]


def test_confusion_covers_every_row_and_shares_add_up(spark):
    L = Ledger.from_sf_dir(spark, SMOKE_DIR)
    r = risk.risk_flagged_vs_actual(L).collect()[0]
    n = L.facts.count()
    assert r["true_positives"] + r["false_positives"] + r["false_negatives"] + r["true_negatives"] == n
    shares = [row["pct_of_all_fraud_value"] for row in risk.risk_fraud_by_amount_band(L).collect()]
    assert abs(sum(shares) - 100.0) <= 0.01 * len(shares)
