"""The BI marts as named temporary views, for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerlens.plans.model import Ledger
from ledgerlens.plans.registry import BI_MARTS, MARTS, normalise
from ledgerlens.sources import warehouse

BUILD_VIEW = "ledgerlens_build"  # one row: the warehouse and the build that the views read


def register_views(ledger: Ledger, names: list[str] | None = None) -> list[str]:
    """A view over each mart's plan: reading it reads the ledger's tables."""
    names = names or BI_MARTS
    for name in names:
        normalise(MARTS[name](ledger)).createOrReplaceTempView(name)
    return names


def register_written(spark: SparkSession, build: str) -> list[str]:
    """A view over each mart that a build has written."""
    for name in BI_MARTS:
        spark.read.parquet(f"{build}/marts/{name}").createOrReplaceTempView(name)
    return BI_MARTS


def followed(spark: SparkSession) -> tuple[str, str] | None:
    """(warehouse, build) that the views of this session read."""
    row = spark.table(BUILD_VIEW).first() if spark.catalog.tableExists(BUILD_VIEW) else None
    return (row["warehouse"], row["build"]) if row else None


def follow(spark: SparkSession, out_dir: str) -> bool:
    """Let the views read the published build of a warehouse, now and after each
    build that this session publishes there; a session that only reads calls it
    again before a report. False if they read that build already."""
    build = warehouse.current(spark, out_dir)
    if followed(spark) == (out_dir, build):
        return False
    register_written(spark, build)
    spark.createDataFrame([(out_dir, build)], "warehouse string, build string").createOrReplaceTempView(BUILD_VIEW)
    return True


def after_publish(spark: SparkSession, out_dir: str) -> None:
    """Move the views on if they follow this warehouse."""
    seen = followed(spark)
    if seen and seen[0] == out_dir:
        follow(spark, out_dir)
