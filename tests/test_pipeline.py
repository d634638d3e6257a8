"""Full rebuilds: published versions, failures that leave the good one, marts
from the written star."""

import os
import tempfile

import pytest

from ledgerlens.operators import measures, quality
from ledgerlens.plans import pipeline, views
from ledgerlens.plans.model import Ledger
from ledgerlens.plans.registry import BI_MARTS, MARTS, normalise
from ledgerlens.sources import warehouse
from tests.conftest import MICRO_ROWS, staging_df


def key_tables(spark):
    from ledgerlens.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).replace("file:", "")
    return {d for d in os.listdir(folder) if d.startswith("keys-")}


def rows(df):
    return sorted(map(repr, normalise(df).collect()))


def test_rebuild_is_idempotent_and_versioned(spark):
    out = tempfile.mkdtemp(prefix="ll-pipe-")
    before = key_tables(spark)
    first = pipeline.run(spark, staging_df(spark, MICRO_ROWS), out)
    assert key_tables(spark) == before  # released once the star is written
    assert warehouse.current(spark, out) == first.build
    second = pipeline.run(spark, staging_df(spark, MICRO_ROWS), out)
    assert first.headline == second.headline
    assert first.headline["total_txns"] == 9
    assert first.headline["fraud_loss_millions"] == 10.3
    assert warehouse.current(spark, out) == second.build != first.build
    for name in BI_MARTS:
        assert os.path.isdir(os.path.join(second.build, "marts", name))
    dup = spark.read.parquet(os.path.join(second.build, "duplicate_cashout_legs")).collect()
    assert [r["transaction_key"] for r in dup] == [2]
    pipeline.run(spark, staging_df(spark, MICRO_ROWS), out, marts=["dashboard_kpi"])
    assert not os.path.exists(first.build) and os.path.exists(second.build)  # two are kept


def test_failed_check_leaves_the_published_build(spark, monkeypatch):
    out = tempfile.mkdtemp(prefix="ll-pipe-")
    good = pipeline.run(spark, staging_df(spark, MICRO_ROWS), out, marts=["dashboard_kpi"])
    bad = [(*r[:3], "M1", *r[4:]) if i == 0 else r for i, r in enumerate(MICRO_ROWS)]
    # the star is never started: its first dimension would raise
    monkeypatch.setattr(Ledger, "dim_date", property(lambda self: pytest.fail("dimension built")))
    with pytest.raises(quality.ValidationError, match="merchant_never_originates"):
        pipeline.run(spark, staging_df(spark, bad), out)
    monkeypatch.undo()
    assert warehouse.current(spark, out) == good.build
    assert spark.read.parquet(os.path.join(good.build, "marts", "dashboard_kpi")).count() == 1
    assert os.listdir(os.path.join(out, "builds")) == [os.path.basename(good.build)]


def test_nothing_published(spark):
    with pytest.raises(FileNotFoundError):
        warehouse.current(spark, tempfile.mkdtemp(prefix="ll-none-"))


def test_warehouse_marts_equal_direct_marts(spark):
    """All 19 marts over the written fact (by account key) equal those computed
    from staging, and read neither staging nor, unless they name accounts, the
    account dimension."""
    out = tempfile.mkdtemp(prefix="ll-wh-")
    stg = staging_df(spark, MICRO_ROWS)
    wh = pipeline.build_star(spark, stg, out)
    direct = Ledger.from_staging(spark, stg)
    for name in BI_MARTS:
        mart = MARTS[name](wh)
        assert rows(mart) == rows(MARTS[name](direct)), name
        read = {f.split(out)[1].split("/")[1] for f in mart.inputFiles()}
        assert read <= {"fact_transactions", "dim_date", "dim_accounts"}, name
        assert ("dim_accounts" in read) == (name == "growth_top_destinations")
    assert sorted(wh.duplicate_legs.collect()) == sorted(direct.duplicate_legs.collect())


def test_named_views(spark):
    names = views.register_views(Ledger.from_staging(spark, staging_df(spark, MICRO_ROWS)))
    assert len(names) == 19
    for name in names:
        assert spark.sql(f"select * from {name}").columns
    assert spark.sql("select total_txns from dashboard_kpi").first()[0] == 9
    out = tempfile.mkdtemp(prefix="ll-view-")
    result = pipeline.run(spark, staging_df(spark, MICRO_ROWS[1:]), out)
    views.register_written(spark, result.build)
    assert spark.sql("select total_txns from dashboard_kpi").first()[0] == 8


def test_measures_over_written_marts_equal_direct(spark):
    """Measures evaluated over the written marts equal those computed from
    the ledger (the registered-query path)."""
    out = tempfile.mkdtemp(prefix="ll-meas-")
    stg = staging_df(spark, MICRO_ROWS)
    build = pipeline.run(spark, stg, out).build
    direct = Ledger.from_staging(spark, stg)
    for name in pipeline.MEASURES:
        written = spark.read.parquet(os.path.join(build, "measures", name))
        assert sorted(written.collect()) == sorted(normalise(getattr(measures, name)(direct)).collect()), name
