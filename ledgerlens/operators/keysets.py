"""Sets of integer keys as words of 64 bits.

Surrogate keys are 1..n. A word stands for 64 consecutive keys: rows are
grouped by word with one OR of their bits, so the keys that a task has seen
leave it as 24 bytes for each word it touched: at most 3n/8 bytes, however many
rows there are, and at most one small row for each input row where keys are
scattered. The OR of longs stays inside generated hash aggregates; larger
blocks (binary bitmaps of 4 kB) would be sorted and cost 4 kB for each scattered
key. Counts of distinct keys, repeats and keys in several roles are sums of bit
counts. A relation whose keys fill a whole range proves that any key inside the
range refers to a row of it, so references are checked without a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word(key: str) -> Column:
    """Number of the word of a key; null for null."""
    return F.expr(f"shiftright(CAST({key} AS BIGINT) - 1, 6)")


def bit(key: str) -> Column:
    return F.expr(f"shiftleft(1L, CAST((CAST({key} AS BIGINT) - 1) & 63 AS INT))")


def bits_of(words: Column) -> Column:
    """Number of keys in words (null: none)."""
    return F.coalesce(F.sum(F.bit_count(words)), F.lit(0)).cast("long")


def distinct_keys(df: DataFrame, key: str, by: Sequence[str], name: str) -> DataFrame:
    """Number of distinct keys for each value of ``by``."""
    words = df.groupBy(*by, word(key).alias("_word")).agg(F.bit_or(bit(key)).alias("_bits"))
    return words.groupBy(*by).agg(bits_of(F.col("_bits")).alias(name))


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, keyed rows, distinct keys, least and greatest key."""
    words = df.groupBy(word(key).alias("_word")).agg(
        F.bit_or(bit(key)).alias("_bits"), F.count(F.lit(1)).alias("_rows"), F.count(key).alias("_keyed"), F.min(key).alias("_lo"), F.max(key).alias("_hi")
    )
    return words.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("total_rows"),
        F.coalesce(F.sum("_keyed"), F.lit(0)).cast("long").alias("keyed_rows"),
        bits_of(F.col("_bits")).alias("distinct_keys"),
        F.min("_lo").cast("long").alias("least"),
        F.max("_hi").cast("long").alias("greatest"),
    )


def full_ranges(relations: dict[str, tuple[DataFrame, str]]) -> dict[str, tuple[int, int] | None]:
    """For each relation (name: frame and key) the range that its keys fill
    without a gap, a repeat or a null, or None. One job over all of them."""
    rows = None
    for name, (df, key) in relations.items():
        one = key_counts(df, key).withColumn("relation", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    found = {r["relation"]: r for r in rows.collect()}
    ranges: dict[str, tuple[int, int] | None] = {}
    for name in relations:
        r = found[name]
        full = r["total_rows"] and r["total_rows"] == r["distinct_keys"] == r["greatest"] - r["least"] + 1
        ranges[name] = (r["least"], r["greatest"]) if full else None
    return ranges


def outside(key: str, bounds: tuple[int, int]) -> Column:
    """Whether a reference points to no row of a relation that fills ``bounds``."""
    return F.col(key).isNull() | ~F.col(key).between(*[F.lit(b) for b in bounds])
