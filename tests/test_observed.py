"""Checks that come with the writes of a build."""

import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import quality
from ledgerlens.plans import pipeline
from ledgerlens.plans.model import Ledger
from ledgerlens.sources.staging import staging_from_sf_dir
from tests.conftest import MICRO_ROWS, SMOKE_DIR, staging_df


def observed_build(spark, stg):
    observed = {}
    ledger = pipeline.build_star(spark, stg, tempfile.mkdtemp(prefix="ll-obs-"), observed=observed)
    return ledger, observed


def test_observed_figures_equal_the_tables(spark):
    L, seen = observed_build(spark, staging_from_sf_dir(spark, SMOKE_DIR))
    row = quality.check_measures(L.stg, L.fact).first()
    assert seen["staging"]["s_c"] == seen["fact"]["f_c"] == int(row["fact_total_amount"] * 100)
    assert seen["fact"]["fact_rows"] == L.fact.count() == seen["staging"]["staging_rows"]
    assert seen["ranges"]["accounts"] == (1, L.accounts.count())
    found = quality.validate_written(L, **seen)
    assert set(found.values()) == {0}
    report = {r["check"] for r in quality.validate(L).collect()}
    assert report <= set(found)


def test_staging_is_not_read_again_to_check_it(spark, monkeypatch):
    """The only readers of written staging are the account and key builds."""
    reads = []
    monkeypatch.setattr(quality, "validate_staging", lambda ledger: reads.append("staging"))
    monkeypatch.setattr(quality, "validation_report", lambda ledger: reads.append("report"))
    pipeline.run(spark, staging_df(spark, MICRO_ROWS), tempfile.mkdtemp(prefix="ll-obs-"), marts=["dashboard_kpi"])
    assert reads == []


@pytest.mark.parametrize(
    "change, name",
    [
        (lambda r: (*r[:3], "M1", *r[4:]), "merchant_never_originates"),
        (lambda r: (r[0], "REFUND", *r[2:]), "known_types"),
        (lambda r: (r[0], "PAYMENT", *r[2:]), "fraud_bearing_flags"),
        (lambda r: (*r[:9], 2, r[10]), "constraint:staging_flags_zero_one"),
    ],
)
def test_a_doctored_row_stops_the_build(spark, change, name):
    rows = [change(MICRO_ROWS[0]), *MICRO_ROWS[1:]]
    with pytest.raises(quality.ValidationError, match=name):
        observed_build(spark, staging_df(spark, rows))


def test_a_doctored_fact_is_found(spark):
    L, seen = observed_build(spark, staging_df(spark, MICRO_ROWS))
    with pytest.raises(quality.ValidationError, match="row_count: 1"):
        quality.validate_written(L, seen["staging"], {**seen["fact"], "fact_rows": 8}, seen["ranges"])
    L._prebuilt["fact"] = L.fact.unionByName(L.fact.where(F.col("transaction_key") == 1))
    fresh = Ledger(spark, L.stg, L._prebuilt)
    with pytest.raises(quality.ValidationError, match="grain: 1"):
        quality.validate_written(fresh, **seen)


def test_fact_files_hold_stretches_of_keys(spark):
    L, _ = observed_build(spark, staging_from_sf_dir(spark, "/root/testdata/sf0.1"))
    files = L.fact.groupBy(F.input_file_name()).agg(F.min("transaction_key"), F.max("transaction_key"), F.min("date_key"), F.max("date_key")).collect()
    spans = sorted(tuple(r)[1:] for r in files)
    assert len(spans) > 1 and all(a[1] < b[0] and a[3] <= b[2] for a, b in zip(spans, spans[1:]))


def test_an_empty_feed_builds_an_empty_star(spark):
    L, seen = observed_build(spark, staging_df(spark, []))
    assert set(quality.validate_written(L, **seen).values()) == {0} and L.fact.count() == 0
