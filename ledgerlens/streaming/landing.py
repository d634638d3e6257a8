"""Landing folder -> staging table, exactly once.

The file source remembers which files it has read (in the checkpoint) and the
Parquet file sink commits each micro-batch through its metadata log, by batch
number. Both belong together: a job that is run again must name the same
checkpoint folder, which therefore has no default (a new one would restart at
batch 0, which the sink takes for already committed). ``availableNow`` processes everything
that has landed, in bounded micro-batches, then stops: the stream doubles as
an incremental batch load.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.schemas import CSV_HEADER, STAGING_COLUMNS, STAGING_SCHEMA


def land_staging(
    spark: SparkSession,
    landing_dir: str,
    staging_path: str,
    checkpoint_path: str,
    max_files_per_trigger: int = 1000,
    wait: bool = True,
) -> StreamingQuery:
    """Append every new CSV file of ``landing_dir`` to the staging table.

    ``checkpoint_path`` is a folder in shared storage that stays with this
    staging table for good. Malformed rows fail the batch (FAILFAST), as the
    bulk loader does."""
    csv_schema = T.StructType(
        [T.StructField(h, f.dataType, True) for h, f in zip(CSV_HEADER, STAGING_SCHEMA.fields)]
    )
    stream = (
        spark.readStream.schema(csv_schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .csv(landing_dir)
        .toDF(*STAGING_COLUMNS)
    )
    query = (
        stream.writeStream.format("parquet")
        .option("path", staging_path)
        .option("checkpointLocation", checkpoint_path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    if wait:
        query.awaitTermination()
    return query
