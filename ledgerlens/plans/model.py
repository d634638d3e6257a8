"""The ledger model: lazily built DataFrames shared by every mart.

``Ledger.from_sf_dir`` derives staging from the driver's ``events`` table;
``Ledger.from_staging`` wraps any staging DataFrame (e.g. the CSV reader);
``Ledger.from_warehouse`` reads a star written by ``plans.pipeline``: its marts
read the written fact, grouped on account keys, and label accounts last.

Nothing here triggers a job except the keyed tables (``keyed``, ``accounts``
and ``fact``), which are written once; ``release`` deletes them.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.bands import band_id_sql
from ledgerlens.functions.fees import FEE_SCALE, fee_sql, hits_cap_sql, hits_floor_sql
from ledgerlens.operators import star
from ledgerlens.operators.common import cell_sums, sum_cents
from ledgerlens.operators.keys import KeyTables
from ledgerlens.schemas import FIRST_LEG_TYPE, SECOND_LEG_TYPE, TRANSACTION_TYPES
from ledgerlens.sources.staging import staging_from_sf_dir
from ledgerlens.sources.warehouse import legs_path

CELL_KEYS = ["day_number", "transaction_type_key", "band_id"]


@dataclass
class Ledger:
    spark: SparkSession
    stg: DataFrame
    _prebuilt: dict = field(default_factory=dict)

    @cached_property
    def key_tables(self) -> KeyTables:
        return KeyTables(self.spark)

    def release(self) -> int:
        """Delete the key tables of this ledger (after its outputs are written)."""
        return self.key_tables.release()

    # -- constructors ------------------------------------------------------
    @classmethod
    def from_sf_dir(cls, spark: SparkSession, sf_dir: str) -> "Ledger":
        return cls(spark, staging_from_sf_dir(spark, sf_dir))

    @classmethod
    def from_staging(cls, spark: SparkSession, stg: DataFrame) -> "Ledger":
        return cls(spark, stg)

    @classmethod
    def from_facts(cls, spark: SparkSession, facts: DataFrame) -> "Ledger":
        """Over rows that are at the transaction grain already."""
        return cls(spark, None, {"facts": facts})

    @classmethod
    def from_warehouse(cls, spark: SparkSession, path: str) -> "Ledger":
        read = lambda name: spark.read.parquet(os.path.join(path, name))
        prebuilt = {
            "dim_date": read("dim_date"),
            "accounts": read("dim_accounts"),
            "fact": read("fact_transactions"),
            "duplicate_legs": spark.read.parquet(legs_path(spark, path)),
        }
        return cls(spark, read("stg_transactions"), prebuilt)

    # -- dimensions --------------------------------------------------------
    @cached_property
    def dim_type(self) -> DataFrame:
        return star.dim_transaction_type(self.spark)

    @cached_property
    def fee_model(self) -> DataFrame:
        return star.fee_model(self.spark, self.dim_type)

    @cached_property
    def dim_date(self) -> DataFrame:
        return self._prebuilt["dim_date"] if "dim_date" in self._prebuilt else star.dim_date(self.stg)

    @cached_property
    def accounts(self) -> DataFrame:
        return self._prebuilt["accounts"] if "accounts" in self._prebuilt else star.dim_accounts(self.stg, self.key_tables)

    # -- facts ---------------------------------------------------------------
    @cached_property
    def keyed(self) -> DataFrame:
        """Staging rows with their transaction_key (a written table)."""
        return star.keyed_transactions(self.stg, self.key_tables)

    @cached_property
    def fact(self) -> DataFrame:
        """The keyed fact (surrogate transaction and account keys)."""
        if "fact" in self._prebuilt:
            return self._prebuilt["fact"]
        return star.fact_transactions(self.accounts, self.keyed)

    @cached_property
    def duplicate_legs(self) -> DataFrame:
        """Duplicate-leg keys; they need the transaction key only, so without a
        written fact they come from the keyed staging rows (the account joins
        cannot drop a row: the account dimension is built from both columns)."""
        if "duplicate_legs" in self._prebuilt:
            return self._prebuilt["duplicate_legs"]
        if "fact" in self._prebuilt:
            return star.duplicate_cashout_legs(self._prebuilt["fact"])
        return star.duplicate_cashout_legs(self.keyed)

    @cached_property
    def residuals(self) -> DataFrame:
        """Deltas and residuals by transaction key."""
        if "fact" in self._prebuilt:
            return self._prebuilt["fact"]
        return star.balance_residuals(self.keyed)

    @cached_property
    def facts(self) -> DataFrame:
        """Transaction grain that the marts read. ``name_orig`` and ``name_dest``
        stand for accounts: ids from staging, account keys from a written fact
        (keys follow the ids' order, so both sort alike)."""
        if "facts" in self._prebuilt:
            return self._prebuilt["facts"]
        if "fact" in self._prebuilt:
            return star.facts_of(self._prebuilt["fact"])
        return star.ledger_facts(self.stg)

    def named_accounts(self, df: DataFrame, column: str) -> DataFrame:
        """Replace account references in ``column`` by account ids. Callers pass
        aggregated or filtered rows."""
        if "fact" not in self._prebuilt:
            return df
        names = self.accounts.select(F.col("account_key").alias(column), "account_id")
        return df.join(names, column).drop(column).withColumnRenamed("account_id", column)

    @cached_property
    def fraud_rows(self) -> DataFrame:
        return self.facts.where(F.col("is_fraud"))

    @cached_property
    def fraud_cells(self) -> DataFrame:
        """Fraud sums by (signature, type, day) with ``is_duplicate_leg``; by
        (type, day, band) where a ledger holds cells instead of rows."""
        if "cells" in self._prebuilt:
            return star.fraud_cells_of(self.cells, self.dup_cells)
        return star.fraud_cells(self.fraud_rows)

    @cached_property
    def priced(self) -> DataFrame:
        """Facts with the fee rule applied (fee assumptions resolved by key)."""
        rate, fmin, fmax, cost = (
            star.fee_attr_sql("transaction_type_key", attr) for attr in ("fee_rate", "fee_min", "fee_max", "cost_per_txn")
        )
        fee = fee_sql("amount", rate, fmin, fmax)
        # inner-join semantics: a type without fee assumptions is dropped
        return self.facts.where(f"({rate}) IS NOT NULL").selectExpr(
            "*",
            f"{rate} AS fee_rate",
            f"{fmin} AS fee_min",
            f"{fmax} AS fee_max",
            f"{cost} AS cost_per_txn",
            f"{fee} AS fee",
            f"CAST(({fee}) * {10 ** FEE_SCALE} AS DECIMAL(20,0)) AS fee_u",
            f"{hits_cap_sql('amount', rate, fmax)} AS hits_cap",
            f"{hits_floor_sql('amount', rate, fmin)} AS hits_floor",
            f"{band_id_sql('amount')} AS band_id",
        )

    @cached_property
    def cells(self) -> DataFrame:
        """Exact sums by (day, type, band), from one scan: the grain that every
        mart on these keys adds up."""
        if "cells" in self._prebuilt:
            return self._prebuilt["cells"]
        return self._summed(*CELL_KEYS)

    def sums(self, *keys: str) -> DataFrame:
        """The sums of ``cells`` by some of their keys: straight from the rows where
        one mart asks (one aggregate), from the cells where only they are held."""
        if "cells" in self._prebuilt:
            return self.cells.groupBy(*keys).agg(*cell_sums(loss=False))
        return self._summed(*keys)

    def _summed(self, *keys: str) -> DataFrame:
        fraud, flagged = F.col("is_fraud"), F.col("is_flagged_fraud")
        return self.priced.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("txn_count"),
            F.count_if(fraud).alias("fraud_txns"),
            F.count_if(flagged).alias("flagged_txns"),
            F.count_if(flagged & fraud).alias("flagged_fraud_txns"),
            F.count_if(F.col("hits_cap")).alias("txns_hitting_cap"),
            F.count_if(F.col("hits_floor")).alias("txns_hitting_floor"),
            sum_cents("amount").alias("value_cents"),
            F.sum("fee_u").alias("fee_u"),
            sum_cents("cost_per_txn").alias("cost_cents"),
            sum_cents(F.when(fraud, F.col("amount"))).alias("fraud_cents"),
            sum_cents(F.when(fraud & ~flagged, F.col("amount"))).alias("missed_cents"),
            F.expr("bit_or(shiftleft(1, hour_of_day)) AS hours"),
        )

    @cached_property
    def dup_cells(self) -> DataFrame:
        """Duplicate legs by (day, type, band)."""
        if "dup_cells" in self._prebuilt:
            return self._prebuilt["dup_cells"]
        legs = self.fraud_cells.where(F.col("is_duplicate_leg"))
        return legs.groupBy("day_number", "transaction_type_key", F.expr(band_id_sql("amount")).alias("band_id")).agg(
            F.sum("fraud_txns").alias("dup_txns"), sum_cents("value").alias("dup_cents")
        )

    @cached_property
    def net_cells(self) -> DataFrame:
        """Cells with ``loss_cents`` (fraud value without duplicate legs) and
        ``true_cents`` (that of the types that attribution counts)."""
        loss = F.coalesce(F.col("fraud_cents"), F.lit(0)) - F.coalesce(F.col("dup_cents"), F.lit(0))
        counted = F.col("transaction_type_key").isin([t[0] for t in TRANSACTION_TYPES if t[1] in (FIRST_LEG_TYPE, SECOND_LEG_TYPE)])
        joined = self.cells.join(self.dup_cells.drop("dup_txns"), CELL_KEYS, "left")
        return joined.withColumn("loss_cents", loss).withColumn("true_cents", F.when(counted, F.col("loss_cents")).otherwise(F.lit(0)))
