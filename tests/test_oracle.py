"""Every registered query against its SQL oracle (DuckDB) on sf0.001:
row count, column names and exact values, order-insensitive."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlens.plans.registry import queries
from tests.conftest import SMOKE_DIR

TABLES = ["events"]


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("null",)
    if hasattr(v, "item"):
        v = v.item()
    return (type(v).__name__ if not isinstance(v, bool) else "bool", v + 0.0 if isinstance(v, float) else v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SMOKE_DIR, t + '.parquet')}')")
    return c


def test_every_query_has_an_oracle():
    assert set(queries()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle(spark, con, name):
    s = entry.queries()[name](spark, SMOKE_DIR).toPandas()
    d = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    cols = sorted(s.columns)
    srows = sorted(tuple(canon(x) for x in r) for r in s[cols].astype(object).itertuples(index=False))
    drows = sorted(tuple(canon(x) for x in r) for r in d[cols].astype(object).itertuples(index=False))
    assert srows == drows


def test_entry_smoke(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["total_txns"] > 0


@pytest.mark.parametrize("name", ["dashboard_date", "growth_daily_activity", "growth_hourly_profile"])
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        s = entry.queries()[name](spark, SMOKE_DIR).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    d = con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(s.columns)
    assert sorted(tuple(canon(x) for x in r) for r in s[cols].astype(object).itertuples(index=False)) == sorted(
        tuple(canon(x) for x in r) for r in d[cols].astype(object).itertuples(index=False)
    )
