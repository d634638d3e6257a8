"""Surrogate keys equal ROW_NUMBER over the full order, whatever the input
order or partition count."""

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.keys import KeyTables, assign_key
from ledgerlens.schemas import FACT_KEY_ORDER
from ledgerlens.sources.staging import staging_from_sf_dir
from tests.conftest import SMOKE_DIR


def test_keys_equal_row_number_and_are_stable(spark):
    stg = staging_from_sf_dir(spark, SMOKE_DIR)
    reference = {
        tuple(r[:-1]): r[-1]
        for r in stg.select(*FACT_KEY_ORDER, F.row_number().over(Window.orderBy(*FACT_KEY_ORDER)).alias("k")).collect()
    }
    for parts, shuffled in [(3, False), (7, True)]:
        src = stg.orderBy(F.rand(seed=parts)) if shuffled else stg
        keyed = assign_key(src, FACT_KEY_ORDER, "k", KeyTables(spark), num_partitions=parts)
        got = {tuple(r[:-1]): r[-1] for r in keyed.select(*FACT_KEY_ORDER, "k").collect()}
        assert got == reference
    n = len(reference)
    assert sorted(reference.values()) == list(range(1, n + 1))


def test_each_caller_releases_its_own_tables(spark):
    df = spark.range(0, 2000, numPartitions=13).withColumnRenamed("id", "v")
    mine, other = KeyTables(spark), KeyTables(spark)
    first, second = assign_key(df, ["v"], "k", mine, num_partitions=5), assign_key(df, ["v"], "k", other)
    assert sorted(r["k"] for r in first.collect()) == list(range(1, 2001))
    paths = [p.replace("file:", "") for p in mine.paths]
    assert mine.release() == 1 and not any(map(os.path.exists, paths))
    assert second.count() == 2000 and other.release() == 1


def test_keys_run_the_input_once(spark):
    """The input's distinct is shuffled once and no partition count is asked of it."""
    df = spark.range(0, 100).selectExpr("id % 10 AS v").distinct()
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assign_key(df, ["v"], "k", KeyTables(spark), num_partitions=2)
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)
    assert len(jobs) <= 5  # no job beside those of the distinct, the range sample and the write
