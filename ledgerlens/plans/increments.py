"""A ledger that grows by batches: duplicate legs and additive marts.

The state of all batches so far is small beside the fact, and a batch changes it
without a look at older fact rows:

* ``cells``: exact sums by (day, type, band), added up over the batches;
* ``firsts``: the signatures (amount, opening balance) of all first legs;
* ``waiting``: second legs whose signature no first leg has yet. A late
  TRANSFER turns the earlier CASH_OUT rows of its signature into duplicates, so
  a batch joins its own second legs and the waiting ones to the first legs;
* ``legs``: keys of the duplicate legs, and ``dup_cells``, their sums.

Transaction keys go on from the last batch's; batches that follow each other in
time get the keys of a full build. A batch writes a folder of its own and takes
effect with one marker (``warehouse.Markers``) that lists the state's folders:
a failed batch changes nothing, and of two writers one has to start again. A
batch id is applied once, so ``append`` can be the body of ``foreachBatch``.
After ``COMPACT`` batches the additive tables are added up into one folder.

What grows: a batch reads the first legs' signatures (a fraud subset) and the
waiting rows; both are joined by shuffle. Folders that are no longer listed stay
until ``vacuum``, since readers may still use them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.bands import band_id_sql
from ledgerlens.operators import quality, star
from ledgerlens.operators.common import CELL_COUNTS, CELL_UNITS, sum_cents
from ledgerlens.operators.keys import KeyTables
from ledgerlens.plans.model import CELL_KEYS, Ledger
from ledgerlens.session import delete_path, ensure_checkpoint_dir, file_system
from ledgerlens.schemas import FIRST_LEG_TYPE, SECOND_LEG_TYPE
from ledgerlens.sources.warehouse import LEGS, Markers, legs_path, publish_legs

COMPACT = 16
DUP_SUMS = ["dup_txns", "dup_cents"]
ADDITIVE = ("cells", "dup_cells", "firsts")


class ConflictError(RuntimeError):
    """Another writer has published a batch in the meantime."""


def merged_cells(cells: DataFrame) -> DataFrame:
    """Cells of several batches added up."""
    sums = [F.sum(c).cast(cells.schema[c].dataType).alias(c) for c in [*CELL_COUNTS, *CELL_UNITS]]
    return cells.groupBy(*CELL_KEYS).agg(*sums, F.bit_or("hours").alias("hours"))


def merged_dup_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*CELL_KEYS).agg(*[F.sum(c).cast(cells.schema[c].dataType).alias(c) for c in DUP_SUMS])


class Increments:
    """The state in one folder of shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.markers = Markers(spark, f"{folder}/published")

    def state(self) -> tuple[int, dict]:
        number, text = self.markers.last()
        empty = {"batches": [], "last_key": 0, "cells": [], "dup_cells": [], "firsts": [], "legs": [], "waiting": []}
        return number, json.loads(text) if text else empty

    def _read(self, names: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.folder}/{n}" for n in names]) if names else None

    def _write(self, df: DataFrame, name: str, *partitions: str) -> DataFrame:
        df.write.partitionBy(*partitions).parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def append(self, stg: DataFrame, batch_id: str | int) -> bool:
        """Apply a batch of new staging rows; False if it was applied before.
        Raises ``quality.ValidationError`` (and changes nothing) if an assertion
        on the batch fails, ``ConflictError`` if another batch came first."""
        number, state = self.state()
        if str(batch_id) in state["batches"]:
            return False
        batch = Ledger.from_staging(self.spark, stg)
        quality.validate_staging(batch)
        part = f"batches/{uuid.uuid4().hex}"
        tables = KeyTables(self.spark)
        keyed = star.keyed_transactions(stg, tables)
        key = F.col("transaction_key") + F.lit(state["last_key"])
        rows = keyed.selectExpr("transaction_key", *star.fact_columns())
        last_key = state["last_key"] + (rows.agg(F.max("transaction_key")).first()[0] or 0)

        self._write(Ledger.from_facts(self.spark, rows).cells.coalesce(1), f"{part}/cells")
        fraud = rows.where(F.col("is_fraud")).select(
            *star.SIGNATURE, "type_name", "day_number", "transaction_type_key", F.expr(band_id_sql("amount")).alias("band_id"), key.alias("transaction_key")
        )
        new = fraud.where(F.col("type_name") == FIRST_LEG_TYPE).select(*star.SIGNATURE).distinct()
        old = self._read(state["firsts"])
        firsts = self._write(new if old is None else new.join(old, star.SIGNATURE, "left_anti"), f"{part}/firsts")
        if old is not None:
            firsts = old.unionByName(firsts)
        seconds = fraud.where(F.col("type_name") == SECOND_LEG_TYPE).drop("type_name")
        waiting = self._read(state["waiting"])
        if waiting is not None:
            seconds = seconds.unionByName(waiting)
        marked = seconds.join(firsts.withColumn("paired", F.lit(True)), star.SIGNATURE, "left").withColumn("paired", F.coalesce("paired", F.lit(False)))
        seconds = self._write(marked, f"{part}/seconds", "paired")
        legs = seconds.where(F.col("paired"))
        self._write(legs.select("transaction_key"), f"{part}/legs")
        dups = legs.groupBy(*CELL_KEYS).agg(F.count(F.lit(1)).alias("dup_txns"), sum_cents("amount").alias("dup_cents"))
        self._write(dups.coalesce(1), f"{part}/dup_cells")
        self._write(seconds.where(~F.col("paired")).drop("paired"), f"{part}/waiting")
        tables.release()
        delete_path(self.spark, f"{self.folder}/{part}/seconds")

        new_state = {
            "batches": [*state["batches"], str(batch_id)],
            "last_key": last_key,
            "waiting": [f"{part}/waiting"],
            **{name: [*state[name], f"{part}/{name}"] for name in (*ADDITIVE, "legs")},
        }
        if len(new_state["cells"]) > COMPACT:
            self._compact(new_state, f"{part}-compact")
        if not self.markers.create(number + 1, json.dumps(new_state)):
            for left in (part, f"{part}-compact"):
                delete_path(self.spark, f"{self.folder}/{left}")
            raise ConflictError(f"batch {batch_id}: another batch was published first")
        return True

    def _compact(self, state: dict, part: str) -> None:
        merge = {"cells": merged_cells, "dup_cells": merged_dup_cells, "firsts": lambda df: df}
        for name in ADDITIVE:
            df = merge[name](self._read(state[name]))
            self._write(df if name == "firsts" else df.coalesce(1), f"{part}/{name}")
            state[name] = [f"{part}/{name}"]

    def vacuum(self) -> int:
        """Delete the folders that the last state does not list; no reader of an
        older state and no writer may be active. Returns how many."""
        _, state = self.state()
        kept = {n for name in (*ADDITIVE, "legs", "waiting") for n in state[name]}
        fs, at = file_system(self.spark, f"{self.folder}/batches")
        found = [(p.getPath().getName(), t.getPath().getName()) for p in (fs.listStatus(at) if fs.exists(at) else []) for t in fs.listStatus(p.getPath())]
        gone = [f"batches/{p}/{t}" for p, t in found if f"batches/{p}/{t}" not in kept]
        return sum(delete_path(self.spark, f"{self.folder}/{name}") for name in gone)

    def duplicate_legs(self) -> DataFrame:
        """Keys of all duplicate legs so far."""
        return self._read(self.state()[1]["legs"]) or self.spark.createDataFrame([], "transaction_key long")

    def ledger(self) -> Ledger:
        """A ledger of the added-up cells, for the marts in ``MARTS_OF_CELLS``."""
        _, state = self.state()
        if not state["cells"]:
            raise FileNotFoundError(f"no batch in {self.folder}")
        cells = {"cells": merged_cells(self._read(state["cells"])), "dup_cells": merged_dup_cells(self._read(state["dup_cells"]))}
        return Ledger(self.spark, None, cells | {"duplicate_legs": self.duplicate_legs()})


#: The marts that cells and duplicate legs decide.
MARTS_OF_CELLS = [
    "fraud_loss_attribution", "risk_fraud_by_type", "risk_fraud_by_amount_band", "risk_flagged_vs_actual", "growth_daily_by_type",
    "profitability_by_type", "profitability_by_type_and_band", "profitability_daily", "profitability_summary", "dashboard_kpi",
    "dashboard_fraud_waterfall",
]


def refresh_duplicate_legs(spark: SparkSession, build: str) -> str:
    """Find the duplicate legs of a written build again from its fact, without a
    rebuild, and make them its current set. Returns their folder."""
    folder = uuid.uuid4().hex
    fact = spark.read.parquet(f"{build}/fact_transactions")
    star.duplicate_cashout_legs(fact).write.parquet(f"{build}/refreshed_legs/{folder}")
    publish_legs(spark, build, folder)
    return legs_path(spark, build)


def in_batches(spark: SparkSession, stg: DataFrame, batches: int = 3) -> Increments:
    """The whole of staging applied as consecutive batches of hours, in a new
    folder of the shared checkpoint folder."""
    increments = Increments(spark, f"{ensure_checkpoint_dir(spark)}/increments-{uuid.uuid4().hex}")
    first, last = stg.agg(F.min("step"), F.max("step")).first()
    if first is None:
        return increments
    span = last - first + 1
    for i in range(batches):
        low, high = first + span * i // batches, first + span * (i + 1) // batches
        increments.append(stg.where((F.col("step") >= low) & (F.col("step") < high)), i)
    return increments
