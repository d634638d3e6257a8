"""Staging readers.

``read_staging_csv`` reads the raw ledger CSV under a declared schema
(positional, header skipped, FAILFAST on malformed rows) and renames the
camelCase header to the staging contract.

``staging_from_events`` maps the driver's ``events`` table onto the same
11-column contract with integer arithmetic only, so every engine derives
identical rows. One scan: the optional second leg of a fraudulent transfer is
produced by a generator (explode) in the same pipeline, not a second scan.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.schemas import CSV_HEADER, STAGING_SCHEMA

# ---------------------------------------------------------------------------
# Fixed values of the events -> staging mapping.
# ---------------------------------------------------------------------------
EVENT_TYPE_TO_TXN_TYPE = {
    "view": "CASH_IN",
    "purchase": "CASH_OUT",
    "signup": "DEBIT",
    "click": "PAYMENT",
    "error": "TRANSFER",
}
AMOUNT_MULTIPLIER = 25000          # cents = round(value * 100) * 25000 + event_id % 100
TRANSFER_FRAUD_MODULUS = 7         # TRANSFER is fraud when event_id % 7 = 0
CASH_OUT_FRAUD_MODULUS = 31        # CASH_OUT is fraud when event_id % 31 = 0
SECOND_LEG_SKIP_MODULUS = 5        # fraud TRANSFER gets a CASH_OUT leg unless event_id % 5 = 0
SECOND_LEG_ID_OFFSET = 900000000   # originator id of the second leg
ORIG_BALANCE_MULT, ORIG_BALANCE_MOD = 7919, 100000000
DEST_BALANCE_MULT, DEST_BALANCE_MOD = 104729, 1000000000
REPEAT_ORIGINATOR_MODULUS = 50     # event_id % 50 = 1 reuses the previous originator id
UNTRACKED_DEST_MODULUS = 4         # event_id % 4 = 0 leaves the destination balance unchanged
FLAG_THRESHOLD_CENTS = 300000000   # incumbent rule fires on fraud TRANSFER above 3M
STEP_ORIGIN_DATE = "2024-01-01"  # step 1 = the first hour of this day


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_staging_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV -> staging DataFrame under the declared schema.

    Fails fast with a clear message when the source is missing (before any
    expensive work), on any malformed row and on any missing value: no staging
    column may be NULL."""
    csv_schema = T.StructType(
        [T.StructField(h, f.dataType, True) for h, f in zip(CSV_HEADER, STAGING_SCHEMA.fields)]
    )
    try:
        raw = (
            spark.read.schema(csv_schema)
            .option("header", True)
            .option("mode", "FAILFAST")
            .option("enforceSchema", True)
            .csv(path)
        )
    except AnalysisException as exc:  # missing path is detected while planning
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"staging source not found: {path}") from exc
    present = [
        F.coalesce(F.col(h), F.raise_error(F.lit(f"staging column {f.name} is NULL")).cast(f.dataType)).alias(f.name)
        for h, f in zip(CSV_HEADER, STAGING_SCHEMA.fields)
    ]
    return raw.select(*present)


def _sql_case(expr: str, mapping: dict, quote: bool = True) -> str:
    q = (lambda v: f"'{v}'") if quote else str
    return "CASE " + expr + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"


def _sql_money(cents: str) -> str:
    return f"CAST(CAST(({cents}) AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"


def staging_from_events(events: DataFrame) -> DataFrame:
    """Three projections and one generator, written as SQL text over the raw
    columns (a single codegen stage; one JVM call per projection)."""
    type0 = _sql_case("event_type", EVENT_TYPE_TO_TXN_TYPE)
    fraud0 = (
        f"(({type0}) = 'TRANSFER' AND event_id % {TRANSFER_FRAUD_MODULUS} = 0)"
        f" OR (({type0}) = 'CASH_OUT' AND event_id % {CASH_OUT_FRAUD_MODULUS} = 0)"
    )
    second_leg = f"({type0}) = 'TRANSFER' AND ({fraud0}) AND event_id % {SECOND_LEG_SKIP_MODULUS} <> 0"
    legs = events.selectExpr(
        "event_id",
        "user_id",
        # whole hours since the origin, zone-free on the wall-clock timestamp
        f"CAST(datediff(to_date(ts), DATE '{STEP_ORIGIN_DATE}') * 24 + hour(ts) + 1 AS INT) AS step",
        f"{type0} AS type0",
        f"CAST(round(value * 100) AS BIGINT) * {AMOUNT_MULTIPLIER} + event_id % 100 AS cents",
        f"{fraud0} AS fraud0",
        f"explode(CASE WHEN {second_leg} THEN array(0, 1) ELSE array(0) END) AS leg",
    )
    typed = legs.selectExpr(
        "event_id",
        "user_id",
        "step",
        "cents",
        "leg",
        "CASE WHEN leg = 1 THEN 'CASH_OUT' ELSE type0 END AS type",
        "leg = 1 OR fraud0 AS fraud",
    )
    old_o = f"CASE WHEN fraud THEN cents ELSE event_id * {ORIG_BALANCE_MULT} % {ORIG_BALANCE_MOD} END"
    old_d = f"CASE WHEN type = 'PAYMENT' THEN 0L ELSE event_id * {DEST_BALANCE_MULT} % {DEST_BALANCE_MOD} END"
    orig_sign = "CASE WHEN type = 'CASH_IN' THEN 1 ELSE -1 END"
    dest_sign = "CASE WHEN type = 'CASH_IN' THEN -1 WHEN type = 'PAYMENT' THEN 0 ELSE 1 END"
    orig_id = (
        f"CASE WHEN leg = 1 THEN {SECOND_LEG_ID_OFFSET} + event_id"
        f" ELSE event_id - CASE WHEN event_id % {REPEAT_ORIGINATOR_MODULUS} = 1 THEN 1 ELSE 0 END END"
    )
    new_d = (
        f"CASE WHEN event_id % {UNTRACKED_DEST_MODULUS} = 0 THEN {old_d}"
        f" ELSE greatest(0, {old_d} + ({dest_sign}) * cents) END"
    )
    return typed.selectExpr(
        "step",
        "type",
        f"{_sql_money('cents')} AS amount",
        f"concat('C', CAST({orig_id} AS STRING)) AS name_orig",
        f"{_sql_money(old_o)} AS oldbalance_org",
        f"{_sql_money(f'greatest(0, {old_o} + ({orig_sign}) * cents)')} AS newbalance_orig",
        "concat(CASE WHEN type = 'PAYMENT' THEN 'M' ELSE 'C' END, CAST(user_id AS STRING)) AS name_dest",
        f"{_sql_money(old_d)} AS oldbalance_dest",
        f"{_sql_money(new_d)} AS newbalance_dest",
        "CAST(fraud AS SMALLINT) AS is_fraud",
        f"CAST(fraud AND type = 'TRANSFER' AND cents > {FLAG_THRESHOLD_CENTS} AS SMALLINT) AS is_flagged_fraud",
    )


def staging_from_sf_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return staging_from_events(events)
