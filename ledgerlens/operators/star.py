"""Star schema builders: hour dimension, type dimension, conformed account
dimension, transaction fact, fee assumptions and duplicate legs.

Scale notes
* The type and fee tables are fixed 5-row values. The fact resolves them as
  CASE lookups inside its projection (no join, no broadcast); the tables
  themselves exist for output and for the checks.
* ``dim_date`` is derived from two aggregates (min/max step) and a sequence;
  its size is the number of simulated hours, not the number of rows.
* ``dim_accounts`` is as large as the fact. It is joined by shuffle (never
  broadcast); AQE splits a hot destination on the fact side.
* Marts do not need surrogate keys: they group on the ids the keys stand for
  (``ledger_facts``), so only the fact build pays the two account joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.literals import literal_frame
from ledgerlens.operators.keys import KeyTables, assign_key
from ledgerlens.schemas import (
    CALENDAR_ANCHOR,
    FACT_KEY_ORDER,
    FEE_ASSUMPTIONS,
    FIRST_LEG_TYPE,
    SECOND_LEG_TYPE,
    TRANSACTION_TYPES,
)

TYPE_SCHEMA = T.StructType(
    [
        T.StructField("transaction_type_key", T.ShortType(), False),
        T.StructField("type_name", T.StringType(), False),
        T.StructField("type_description", T.StringType(), False),
        T.StructField("is_fraud_bearing", T.BooleanType(), False),
        T.StructField("orig_balance_sign", T.ShortType(), False),
        T.StructField("dest_balance_sign", T.ShortType(), True),
    ]
)

FEE_SCHEMA = T.StructType(
    [
        T.StructField("type_name", T.StringType(), False),
        T.StructField("fee_rate", T.DecimalType(6, 5), False),
        T.StructField("fee_min", T.DecimalType(12, 2), False),
        T.StructField("fee_max", T.DecimalType(12, 2), False),
        T.StructField("cost_per_txn", T.DecimalType(12, 2), False),
        T.StructField("rationale", T.StringType(), False),
    ]
)


_TYPE_FIELDS = [f.name for f in TYPE_SCHEMA.fields]


def _lookup(pairs: list[tuple], key: Column, value_type: T.DataType | None = None) -> Column:
    """Value of ``key`` in a fixed mapping, as a map-literal expression (NULL
    when absent). Resolving the fixed 5-row dimensions this way costs no join
    and no broadcast job at any scale; results equal the inner join."""
    m = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    v = m[key]
    return v.cast(value_type) if value_type is not None else v




def type_attr_by_key(type_key: Column, attr: str) -> Column:
    i = _TYPE_FIELDS.index(attr)
    pairs = [(t[0], t[i]) for t in TRANSACTION_TYPES if t[i] is not None]
    return _lookup(pairs, type_key, TYPE_SCHEMA.fields[i].dataType)




def day_of(step: Column) -> Column:
    """Model day: step 1 is day 0 hour 0 -> (step - 1) div 24."""
    return F.floor((step - F.lit(1)) / F.lit(24)).cast("int")


def hour_of(step: Column) -> Column:
    return F.pmod(step - F.lit(1), F.lit(24)).cast("int")


def dim_transaction_type(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, TRANSACTION_TYPES, TYPE_SCHEMA)


def fee_model(spark: SparkSession, dim_type: DataFrame | None = None) -> DataFrame:
    """Fee assumptions resolved to the type key (inner join on the natural key)."""
    dim_type = dim_type if dim_type is not None else dim_transaction_type(spark)
    fees = literal_frame(spark, FEE_ASSUMPTIONS, FEE_SCHEMA)
    return fees.join(F.broadcast(dim_type.select("type_name", "transaction_type_key")), "type_name").select(
        "transaction_type_key", "type_name", "fee_rate", "fee_min", "fee_max", "cost_per_txn", "rationale"
    )


MAX_HOURS = 2_000_000  # over two centuries: a longer span is a corrupt step


def dim_date(stg: DataFrame) -> DataFrame:
    """Every hour between the observed min and max step (dense series). A span
    over ``MAX_HOURS`` is an error, not a dimension of that length."""
    bounds = stg.agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    too_long = F.raise_error(F.concat(F.lit("steps span too many hours: "), F.col("lo"), F.lit(" to "), F.col("hi"))).cast("int")
    last = F.when(F.col("hi").cast("long") - F.col("lo") > MAX_HOURS, too_long).otherwise(F.col("hi"))
    return _hours(bounds.select(F.explode(F.sequence("lo", last)).alias("date_key")))


def dim_date_between(spark: SparkSession, first: int | None, last: int | None) -> DataFrame:
    """The same from known bounds (None: no hour)."""
    if first is None:
        return _hours(spark.range(0).select(F.col("id").alias("date_key")))
    if last - first > MAX_HOURS:
        raise ValueError(f"steps span too many hours: {first} to {last}")
    return _hours(spark.range(first, last + 1, numPartitions=1).select(F.col("id").alias("date_key")))


def _hours(steps: DataFrame) -> DataFrame:
    day = day_of(F.col("date_key"))
    return steps.select(
        F.col("date_key").cast("int").alias("date_key"),
        day.cast("short").alias("day_number"),
        hour_of(F.col("date_key")).cast("short").alias("hour_of_day"),
        F.concat(F.lit("Day_"), F.pmod(day, F.lit(7)).cast("string")).alias("day_of_week"),
        F.pmod(day, F.lit(7)).isin(5, 6).alias("is_weekend"),
    )


def party_type(account_id: Column) -> Column:
    return F.when(F.left(account_id, F.lit(1)) == "M", F.lit("MERCHANT")).otherwise(F.lit("CUSTOMER"))


def dim_accounts(stg: DataFrame, tables: KeyTables) -> DataFrame:
    """One row per distinct id from either role; key = rank of the id.

    ``distinct`` runs first so a hot id collapses map-side (partial
    aggregation) before the range shuffle that numbers the ids."""
    ids = (
        stg.select(F.col("name_orig").alias("account_id"))
        .union(stg.select(F.col("name_dest").alias("account_id")))
        .distinct()
    )
    keyed = assign_key(ids, ["account_id"], "account_key", tables)
    return keyed.select("account_key", "account_id", party_type(F.col("account_id")).alias("party_type"))


def _sql_lookup(expr: str, pairs: list[tuple], sql_type: str) -> str:
    """CASE lookup in a fixed mapping as SQL text (NULL when absent)."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    whens = " ".join(f"WHEN {lit(k)} THEN CAST({lit(v)} AS {sql_type})" for k, v in pairs)
    return f"CASE {expr} {whens} END"


def type_attr_sql(expr: str, attr: str, by_key: bool = False) -> str:
    i = _TYPE_FIELDS.index(attr)
    pairs = [(t[0] if by_key else t[1], t[i]) for t in TRANSACTION_TYPES if t[i] is not None]
    return _sql_lookup(expr, pairs, TYPE_SCHEMA.fields[i].dataType.simpleString())


def fee_attr_sql(key_expr: str, attr: str) -> str:
    i = [f.name for f in FEE_SCHEMA.fields].index(attr)
    keys = {t[1]: t[0] for t in TRANSACTION_TYPES}
    pairs = [(keys[f[0]], str(f[i])) for f in FEE_ASSUMPTIONS]
    return _sql_lookup(key_expr, pairs, FEE_SCHEMA.fields[i].dataType.simpleString())


def _typed_exprs() -> tuple[str, list[str]]:
    """(type key, [deltas and direction-aware residuals]) as SQL text over
    staging columns: residual = new - (old + sign * amount); the destination
    residual is NULL where the type does not track the destination balance."""
    key = type_attr_sql("type", "transaction_type_key")
    o_sign = type_attr_sql("type", "orig_balance_sign")
    d_sign = type_attr_sql("type", "dest_balance_sign")
    return key, [
        "newbalance_orig - oldbalance_org AS orig_balance_delta",
        "newbalance_dest - oldbalance_dest AS dest_balance_delta",
        f"newbalance_orig - (oldbalance_org + ({o_sign}) * amount) AS orig_balance_error",
        f"CASE WHEN ({d_sign}) IS NOT NULL THEN newbalance_dest - (oldbalance_dest + ({d_sign}) * amount) END"
        " AS dest_balance_error",
    ]


_MONEY_COLUMNS = ["amount", "oldbalance_org", "newbalance_orig", "oldbalance_dest", "newbalance_dest"]


def ledger_facts(stg: DataFrame, dim_type: DataFrame | None = None) -> DataFrame:
    """Transaction grain without surrogate keys, for the marts.

    The type dimension is resolved by key lookup with inner-join semantics (a
    row whose type is not in the dimension is dropped; ``assert_fraud_bearing``
    reports such types). Day and hour are arithmetic on the step, equal to the
    dim_date join since dim_date is a dense series over the same steps."""
    key, _ = _typed_exprs()
    return stg.where(f"({key}) IS NOT NULL").selectExpr(*fact_columns())


def fact_columns() -> list[str]:
    """Staging columns as columns of the transaction grain (SQL text)."""
    key, residuals = _typed_exprs()
    return [
        "step AS date_key",
        "CAST(floor((step - 1) / 24) AS INT) AS day_number",
        "CAST(pmod(step - 1, 24) AS INT) AS hour_of_day",
        f"{key} AS transaction_type_key",
        "type AS type_name",
        "name_orig",
        "name_dest",
        *_MONEY_COLUMNS,
        *residuals,
        "is_fraud = 1 AS is_fraud",
        "is_flagged_fraud = 1 AS is_flagged_fraud",
    ]


def facts_of(fact: DataFrame) -> DataFrame:
    """The same grain from a written fact: account keys stand for accounts."""
    key = "transaction_type_key"
    return fact.selectExpr(
        "date_key",
        "CAST(floor((date_key - 1) / 24) AS INT) AS day_number",
        "CAST(pmod(date_key - 1, 24) AS INT) AS hour_of_day",
        key,
        f"{type_attr_sql(key, 'type_name', by_key=True)} AS type_name",
        "orig_account_key AS name_orig",
        "dest_account_key AS name_dest",
        *_MONEY_COLUMNS,
        "orig_balance_delta",
        "dest_balance_delta",
        "orig_balance_error",
        "dest_balance_error",
        "is_fraud",
        "is_flagged_fraud",
    )


def keyed_transactions(stg: DataFrame, tables: KeyTables) -> DataFrame:
    """Staging rows of known types with their ``transaction_key``."""
    key, _ = _typed_exprs()
    # rows tied on all eleven columns are identical: any numbering among them
    # gives the same table, so they may be split across partitions
    return assign_key(stg.where(f"({key}) IS NOT NULL"), FACT_KEY_ORDER, "transaction_key", tables, split_ties=True)


def balance_residuals(keyed: DataFrame) -> DataFrame:
    """Deltas and residuals by transaction key; no account is needed."""
    _, residuals = _typed_exprs()
    return keyed.selectExpr("transaction_key", *residuals)


def fact_transactions(accounts: DataFrame, keyed: DataFrame) -> DataFrame:
    """The keyed fact: one row per staging row.

    transaction_key = ROW_NUMBER over (step, name_orig, amount, <all other
    staging columns>) via ``assign_key``; account keys by two shuffle joins
    to the conformed account dimension (role-playing)."""
    key, residuals = _typed_exprs()
    orig = accounts.selectExpr("account_id AS name_orig", "account_key AS orig_account_key")
    dest = accounts.selectExpr("account_id AS name_dest", "account_key AS dest_account_key")
    joined = keyed.join(orig, "name_orig").join(dest, "name_dest")
    return joined.selectExpr(
        "transaction_key",
        "step AS date_key",
        f"{key} AS transaction_type_key",
        "orig_account_key",
        "dest_account_key",
        *_MONEY_COLUMNS,
        *residuals,
        "is_fraud = 1 AS is_fraud",
        "is_flagged_fraud = 1 AS is_flagged_fraud",
    )


SIGNATURE = ["amount", "oldbalance_org"]


def fraud_cells(fraud_rows: DataFrame) -> DataFrame:
    """Fraud rows summed by (signature, type, day), each cell with
    ``is_duplicate_leg``: second legs whose signature some first leg has.

    One scan and no self-join: the aggregate collapses a hot signature to at
    most one row for each type and day before the window over the signature
    looks for a first leg."""
    cells = fraud_rows.groupBy(*SIGNATURE, "transaction_type_key", "type_name", "day_number").agg(
        F.count(F.lit(1)).alias("fraud_txns"), F.sum("amount").alias("value")
    )
    has_first = F.max(F.col("type_name") == FIRST_LEG_TYPE).over(Window.partitionBy(*SIGNATURE))
    return cells.withColumn("is_duplicate_leg", (F.col("type_name") == SECOND_LEG_TYPE) & has_first)


def fraud_cells_of(cells: DataFrame, dup_cells: DataFrame) -> DataFrame:
    """Fraud sums by (type, day, band) with ``is_duplicate_leg``, from the sums of
    all fraud and of the duplicate legs."""
    keys = ["day_number", "transaction_type_key", "band_id"]
    value = lambda cents: (cents * F.lit(0.01).cast("decimal(3,2)")).alias("value")
    both = cells.where(F.col("fraud_txns") > 0).join(dup_cells, keys, "left").na.fill(0, ["dup_txns", "dup_cents"])
    rest = both.select(*keys, (F.col("fraud_txns") - F.col("dup_txns")).alias("fraud_txns"), value(F.col("fraud_cents") - F.col("dup_cents")), F.lit(False).alias("is_duplicate_leg"))
    legs = dup_cells.select(*keys, F.col("dup_txns").alias("fraud_txns"), value(F.col("dup_cents")), F.lit(True).alias("is_duplicate_leg"))
    rows = rest.unionByName(legs).where(F.col("fraud_txns") > 0)
    return rows.withColumn("type_name", type_attr_by_key(F.col("transaction_type_key"), "type_name"))


def duplicate_cashout_legs(fact: DataFrame, dim_type: DataFrame | None = None) -> DataFrame:
    """Keys of the duplicate legs (the materialized set), from the keyed fact
    or from keyed staging rows (``type``, ``is_fraud`` as 0/1).

    Reads only fraud rows (a pushed-down filter), then a left-semi join on the
    signature."""
    if "type" in fact.columns:  # keyed staging rows
        fraud = fact.where(F.col("is_fraud") == 1).withColumnRenamed("type", "type_name")
    else:
        fraud = fact.where(F.col("is_fraud")).withColumn(
            "type_name", type_attr_by_key(F.col("transaction_type_key"), "type_name")
        )
    # one row for each signature: a hot one skews only the probe side, which AQE splits
    first_legs = fraud.where(F.col("type_name") == FIRST_LEG_TYPE).select(*SIGNATURE).distinct()
    return (
        fraud.where(F.col("type_name") == SECOND_LEG_TYPE)
        .join(first_legs, SIGNATURE, "left_semi")
        .select("transaction_key")
    )


def calendar_date(day_number: Column) -> Column:
    return F.date_add(F.lit(CALENDAR_ANCHOR).cast("date"), day_number)
