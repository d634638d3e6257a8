"""Session helpers.

Library code never creates a session: it receives one. ``local_session`` is
for tests and bench only. ``ensure_checkpoint_dir`` reads the cluster's
``spark.checkpoint.dir`` and only supplies one when it is unset on a local
master (tests); on a cluster a missing shared checkpoint folder is an error.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlens") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # call-site capture costs several JVM round trips per Column call
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # HotSpot never JIT-compiles methods over 8000 bytes of bytecode; larger
        # whole-stage methods would run interpreted (Spark's documented advice)
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path object) of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return bool(fs.delete(at, True))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only for local runs."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/...) "
            "for reliable checkpoints; a machine-local folder is not safe on a cluster"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-ckpt-"))
    return sc.getCheckpointDir()
