"""Dense surrogate keys equal to ``ROW_NUMBER() OVER (ORDER BY cols)``
without a single-partition window.

Plan: one range shuffle on the full order (sampled boundaries, so a hot
leading value such as one busy hour is split across partitions by the
following columns), a sort within each partition, then the position of each
row inside its partition. The tagged rows are written once as a table in the
cluster's shared checkpoint folder (``spark.checkpoint.dir``), which fixes
partition ids and positions (a lost executor cannot renumber anything) and
cuts lineage; unlike an eager RDD checkpoint, the sort is not run a second
time to write the files. Per-partition row counts
(one row per partition: a proven size bound) become running offsets that are
broadcast back. Keys are 1..n in order; rows tied on *every* order column
are identical, so any numbering among them yields the same table.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.session import delete_path, ensure_checkpoint_dir

_POSITION_BITS = 33  # monotonically_increasing_id = (partition << 33) + position


class KeyTables:
    """Owns the tagged tables behind one caller's keyed DataFrames. ``release``
    deletes these tables and no others, once everything that reads them has
    been written out."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def new_path(self) -> str:
        self.paths.append(os.path.join(ensure_checkpoint_dir(self.spark), f"keys-{uuid.uuid4().hex}"))
        return self.paths[-1]

    def release(self) -> int:
        """Number of tables removed."""
        removed = sum(delete_path(self.spark, path) for path in self.paths)
        self.paths.clear()
        return removed


def assign_key(
    df: DataFrame,
    order_cols: list[str],
    key_col: str,
    tables: KeyTables,
    num_partitions: int | None = None,
    split_ties: bool = False,
) -> DataFrame:
    """Keys 1..n in ``order_cols`` order; the tagged table belongs to ``tables``.

    The range partition count defaults to the session's shuffle partition
    setting (asking the DataFrame for its own would run its shuffles).
    ``split_ties`` appends the input position as a last order column: rows tied
    on every order column (interchangeable for the caller) can then be spread
    over several partitions instead of piling into one; the written table
    freezes the numbering."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = list(order_cols)
    if split_ties:
        df = df.withColumn("_tie", F.monotonically_increasing_id())
        order.append("_tie")
    tagged_path = tables.new_path()
    (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        .write.parquet(tagged_path)
    )
    tagged = spark.read.parquet(tagged_path)
    position = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), _POSITION_BITS)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_pid")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_pid", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    keyed = tagged.join(F.broadcast(offsets), "_pid").withColumn(
        key_col, F.col("_offset") + position + F.lit(1)
    )
    return keyed.drop("_pid", "_mid", "_offset", "_tie")
