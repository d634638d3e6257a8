"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import delete_path, ensure_checkpoint_dir

SEGMENT_BYTES = 1 << 22  # texts are worked on in pieces of about this size
_SPACE = b" \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def frozen(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it
    back: row numbers stay fixed if an executor is lost, and nothing above
    computes it again. The table lives as long as the checkpoint folder, or as
    the ``passing_tables`` around it."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    schema = df.schema
    if (tables := _passing.get()) is not None:
        tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[..., tuple[DataFrame, ...]]]:
    """Drop the tables that ``frozen`` writes in this block when it ends, but for
    those that the given function is told to let stay (frozen frames, unchanged)."""
    tables: list[str] = []
    kept: set[str] = set()

    def stay(*frames: DataFrame) -> tuple[DataFrame, ...]:
        kept.update(f.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in frames for f in df.inputFiles())
        return frames

    token = _passing.set(tables)
    try:
        yield stay
    finally:
        _passing.reset(token)
        for path in tables:
            if path.rsplit("/", 1)[1] not in kept:
                delete_path(spark, path)


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fixed folds of the contracts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def chunks(values: Iterable[bytes | None], limit: int = SEGMENT_BYTES) -> Iterator[list[bytes]]:
    """Lists of consecutive texts of about ``limit`` bytes together; None
    becomes an empty text. One text over the limit comes alone."""
    held, size = [], 0
    for value in values:
        value = value or b""
        if held and size + len(value) > limit:
            yield held
            held, size = [], 0
        held.append(value)
        size += len(value)
    if held:
        yield held


def segments(text: bytes, limit: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """Parts of a text of about ``limit`` bytes, cut only at ASCII white space."""
    at = 0
    while len(text) - at > limit:
        cut = max(text.rfind(bytes((c,)), at, at + limit) for c in _SPACE)
        if cut <= at:
            found = [p for c in _SPACE if (p := text.find(bytes((c,)), at + limit)) >= 0]
            cut = min(found, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]
