"""Every assertion passes on clean data and fails on a doctored row."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import quality
from ledgerlens.plans.model import Ledger
from tests.conftest import staging_df


def verdicts(df):
    return {r["check"]: r["result"] for r in df.collect()}


def test_clean_fixture_validates(micro):
    report = quality.validate(micro)
    assert {r["result"] for r in report.collect()} == {"PASS"}


@pytest.mark.parametrize(
    "change, check",
    [
        (lambda r: (r[0], r[1], r[2], "M77", *r[4:]), "merchant_never_originates"),
        (lambda r: (*r[:6], "M77", *r[7:]), "merchant_receives_only_payment"),
    ],
)
def test_merchant_rule_negative(spark, micro_rows, change, check):
    rows = [change(micro_rows[0])] + micro_rows[1:]
    v = verdicts(quality.assert_merchant_rule(staging_df(spark, rows)))
    assert v[check] == "FAIL"


def test_fraud_on_payment_fails(spark, micro_rows):
    r = micro_rows[4]  # the PAYMENT row
    rows = micro_rows[:4] + [(*r[:9], 1, 0)] + micro_rows[5:]
    v = verdicts(quality.assert_fraud_bearing(staging_df(spark, rows), Ledger.from_staging(spark, None).dim_type))
    assert v["fraud_bearing_flags"] == "FAIL"


def test_unknown_type_fails(spark, micro_rows):
    r = micro_rows[5]
    rows = micro_rows[:5] + [(r[0], "REFUND", *r[2:])] + micro_rows[6:]
    stg = staging_df(spark, rows)
    v = verdicts(quality.assert_fraud_bearing(stg, Ledger.from_staging(spark, stg).dim_type))
    assert v["known_types"] == "FAIL"
    # and the fact silently drops it, which row_count then reports
    with pytest.raises(quality.ValidationError):
        quality.validate(Ledger.from_staging(spark, stg))


def test_payment_dest_populated_fails(spark, micro_rows):
    r = micro_rows[4]
    rows = micro_rows[:4] + [(*r[:7], D("5"), *r[8:])] + micro_rows[5:]
    v = verdicts(quality.assert_payment_dest_untracked(staging_df(spark, rows)))
    assert v["payment_dest_untracked"] == "FAIL"


def test_duplicate_key_fails(micro):
    fact = micro.fact
    doubled = fact.unionByName(fact.where(F.col("transaction_key") == 1))
    assert quality.check_grain(doubled).collect()[0]["result"] == "FAIL"


def test_fee_cap_below_floor_fails(micro):
    bad_fees = micro.fee_model.withColumn(
        "fee_max", F.when(F.col("type_name") == "DEBIT", F.lit(1).cast("decimal(12,2)")).otherwise(F.col("fee_max"))
    )
    v = {r["constraint"]: r["violations"] for r in quality.constraint_violations(
        micro.stg, micro.dim_date, micro.dim_type, micro.accounts, bad_fees, micro.fact, micro.duplicate_legs).collect()}
    assert v["fee_cap_at_least_floor"] == 1
    assert sum(v.values()) == 1


def test_corrupt_step_is_an_error_and_not_a_long_calendar(spark, micro_rows):
    rows = micro_rows[:-1] + [(2_000_000_000, *micro_rows[-1][1:])]
    with pytest.raises(Exception, match="steps span too many hours"):
        Ledger.from_staging(spark, staging_df(spark, rows)).dim_date.count()
