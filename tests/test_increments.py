"""Batches against full builds; refreshes without a rebuild; markers."""

import tempfile
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import quality
from ledgerlens.plans import increments, pipeline, views
from ledgerlens.plans.increments import MARTS_OF_CELLS, ConflictError, Increments
from ledgerlens.plans.model import Ledger
from ledgerlens.plans.registry import BI_MARTS, MARTS, normalise
from ledgerlens.sources import warehouse
from ledgerlens.sources.staging import staging_from_sf_dir
from tests.conftest import MICRO_ROWS, SMOKE_DIR, staging_df


def rows(df):
    return sorted(map(repr, normalise(df).collect()))


def folder():
    return tempfile.mkdtemp(prefix="ll-inc-")


def test_each_batch_equals_a_full_build_so_far(spark):
    stg = staging_from_sf_dir(spark, SMOKE_DIR)
    stg = spark.createDataFrame(stg.collect(), stg.schema)
    inc, done = Increments(spark, folder()), None
    edges = [0, 200, 430, 10_000]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        batch = stg.where(F.col("step").between(low + 1, high))
        done = batch if done is None else done.unionByName(batch)
        assert inc.append(batch, i) and not inc.append(batch, i)  # once
        full = Ledger.from_staging(spark, done)
        assert rows(inc.duplicate_legs()) == rows(full.duplicate_legs)
        cells = "profitability_by_type_and_band"
        assert rows(MARTS[cells](inc.ledger())) == rows(MARTS[cells](full))
    for name in MARTS_OF_CELLS:
        mart = MARTS[name](inc.ledger())
        assert rows(mart) == rows(MARTS[name](full)), name
        assert {f.split("/")[-2] for f in mart.inputFiles()} <= {"cells", "dup_cells"}, name


def test_a_late_first_leg_makes_earlier_rows_duplicates(spark):
    late = (30, "TRANSFER", D("10000000.00"), "C50", D("10000000"), D("0"), "C51", D("0"), D("0"), 1, 0)
    inc = Increments(spark, folder())
    inc.append(staging_df(spark, MICRO_ROWS), "a")
    assert [r[0] for r in inc.duplicate_legs().collect()] == [2]  # the 10M row waits
    inc.append(staging_df(spark, [late, (30, "CASH_OUT", *late[2:3], "C52", *late[4:])]), "b")
    full = Ledger.from_staging(spark, staging_df(spark, [*MICRO_ROWS, late, (30, "CASH_OUT", *late[2:3], "C52", *late[4:])]))
    assert rows(inc.duplicate_legs()) == rows(full.duplicate_legs) and inc.duplicate_legs().count() == 3
    assert rows(MARTS["dashboard_fraud_waterfall"](inc.ledger())) == rows(MARTS["dashboard_fraud_waterfall"](full))


def test_bad_batch_changes_nothing(spark):
    inc = Increments(spark, folder())
    inc.append(staging_df(spark, MICRO_ROWS[:4]), 0)
    before = inc.state()
    bad = (26, "PAYMENT", D("5"), "M5", D("9"), D("4"), "M1", D("0"), D("0"), 0, 0)
    with pytest.raises(quality.ValidationError, match="merchant_never_originates"):
        inc.append(staging_df(spark, [bad]), 1)
    assert inc.state() == before


def test_two_writers(spark, monkeypatch):
    place = folder()
    one, two = Increments(spark, place), Increments(spark, place)
    old = two.state()
    one.append(staging_df(spark, MICRO_ROWS[:4]), "first")
    monkeypatch.setattr(two, "state", lambda: old)  # had looked before
    with pytest.raises(ConflictError):
        two.append(staging_df(spark, MICRO_ROWS[4:]), "second")
    monkeypatch.undo()
    assert two.append(staging_df(spark, MICRO_ROWS[4:]), "second")
    full = Ledger.from_staging(spark, staging_df(spark, MICRO_ROWS))
    assert rows(MARTS["dashboard_kpi"](two.ledger())) == rows(MARTS["dashboard_kpi"](full))


def test_compaction_and_vacuum(spark, monkeypatch):
    monkeypatch.setattr(increments, "COMPACT", 2)
    inc = Increments(spark, folder())
    for i, row in enumerate((MICRO_ROWS[:3], [], MICRO_ROWS[3:6], MICRO_ROWS[6:])):
        inc.append(staging_df(spark, row), i)
    assert len(inc.state()[1]["cells"]) <= 2
    full = Ledger.from_staging(spark, staging_df(spark, MICRO_ROWS))
    check = lambda: [rows(MARTS[n](inc.ledger())) == rows(MARTS[n](full)) for n in ("profitability_by_type", "risk_flagged_vs_actual")]
    assert all(check()) and inc.vacuum() > 0 and all(check()) and inc.vacuum() == 0
    assert rows(inc.duplicate_legs()) == rows(full.duplicate_legs)


def test_legs_of_a_build_are_refreshed_alone(spark):
    out = folder()
    build = pipeline.run(spark, staging_df(spark, MICRO_ROWS), out, marts=["dashboard_kpi"]).build
    spark.createDataFrame([(7,)], "transaction_key long").write.mode("overwrite").parquet(f"{build}/{warehouse.LEGS}")  # a stale set
    assert [r[0] for r in Ledger.from_warehouse(spark, build).duplicate_legs.collect()] == [7]
    increments.refresh_duplicate_legs(spark, build)
    assert [r[0] for r in Ledger.from_warehouse(spark, build).duplicate_legs.collect()] == [2]


def test_views_follow_the_published_build(spark):
    out = folder()
    pipeline.run(spark, staging_df(spark, MICRO_ROWS), out)
    assert views.follow(spark, out) and not views.follow(spark, out)
    total = lambda: spark.sql("select total_txns from dashboard_kpi").first()[0]
    assert total() == 9
    build = pipeline.run(spark, staging_df(spark, MICRO_ROWS[1:]), out).build
    assert total() == 8 and spark.sql("select build from ledgerlens_build").first()[0] == build
    later = warehouse.new_build(out)  # published elsewhere
    spark.read.parquet(f"{build}/marts/dashboard_kpi").withColumn("total_txns", F.lit(77)).write.parquet(f"{later}/marts/dashboard_kpi")
    for name in set(BI_MARTS) - {"dashboard_kpi"}:
        spark.read.parquet(f"{build}/marts/{name}").write.parquet(f"{later}/marts/{name}")
    warehouse.publish(spark, out, later)
    assert total() == 8 and views.follow(spark, out) and total() == 77


def test_markers_are_created_once(spark):
    markers = warehouse.Markers(spark, folder() + "/m")
    assert markers.last() == (0, "")
    assert markers.create(1, "one") and not markers.create(1, "other") and markers.last() == (1, "one")
    markers.create(2, "")  # its writer has not finished
    assert markers.last() == (1, "one")
