"""Small literal relations built JVM-side.

``spark.createDataFrame(list)`` ships the rows through a Python RDD: every
use launches Python workers and the relation has no size statistics, so a
join to it is planned as a sort-merge join. A one-row range exploded into
typed structs stays in the JVM, is planned with known tiny size and can be
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
