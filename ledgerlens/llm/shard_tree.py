"""Sharding by a hierarchical weighted hash tree.

A row descends region -> rack -> shard. At each level every child of the node
reached so far draws ``-ln(u) / weight`` with ``u`` from a hash of (key,
child's label), and the least draw wins: children get rows in proportion to
their weights, and a changed weight moves rows only into or out of the subtree
whose weight changed. ``Tree.grow`` adds a shard as a region of its own, so
each row either stays or moves into the new shard.

Law: ``key`` - the integer id and the tree alone decide the shard. Slots
number the rows of a shard from 0 without gaps, in the order (block, id, text
crc, size), the block being an md5 prefix of (id, crc, size). Blocks split a
shard into thousands of sort groups, whose start offsets come from a prefix sum
over block counts. Equal (id, crc, size) rows are counted before the shuffle and
expanded after, and different texts under one id spread over all blocks of its
shard, so no shard, id or copy group has to fit a single task's sort.

Cases: a null id is hashed as the text ``null``; a null text has size 8 and
crc 0 (that of no bytes); repeated rows are interchangeable and get
consecutive slots; an empty table gives an empty result; other columns are
not read, so their names cannot clash. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 13  # hex digits of the md5 used for a draw: 52 bits, exact in a double
BLOCK_DIGITS = 3  # 4096 slot blocks a shard
BLOCK = f"substr(md5(concat(_key, ':', text_crc32, ':', size)), 1, {BLOCK_DIGITS})"
BROADCAST_BLOCKS = 1 << 18  # rows (shard, block, start) of under 100 bytes


@dataclass(frozen=True)
class Tree:
    """regions -> racks -> (shard number, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def even(regions: int = 2, racks: int = 3, shards: int = 4) -> Tree:
        """Equal weights; shards are numbered depth first from 0."""
        return Tree(
            tuple(
                tuple(tuple(((r * racks + k) * shards + s, 1.0) for s in range(shards)) for k in range(racks))
                for r in range(regions)
            )
        )

    def size(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region and rack of its own."""
        return Tree(self.regions + ((((self.size(), weight),),),))


def draw(key: str, label: str, weight: float) -> str:
    """SQL text of a child's draw; the least one wins."""
    u = f"(cast(conv(substr(md5(concat({key}, ':{label}')), 1, {HASH_DIGITS}), 16, 10) as double) + 0.5D)"
    return f"(-ln({u} / {float(16**HASH_DIGITS)!r}D) / {weight!r}D)"


def _least(options: list[tuple[str, str]]) -> str:
    """SQL text: the value of the (draw, value) pair with the least draw."""
    if len(options) == 1:
        return options[0][1]
    pairs = ", ".join(f"struct({d} as d, {v} as v)" for d, v in options)
    return f"array_min(array({pairs})).v"


def shard_column(key: Column | str, tree: Tree) -> list[tuple[str, str]]:
    """Three (name, SQL text) steps for ``withColumn``, one for each level."""
    weigh_rack = lambda rack: sum(w for _, w in rack)
    region = _least(
        [(draw(key, f"g{r}", sum(map(weigh_rack, racks))), str(r)) for r, racks in enumerate(tree.regions)]
    )
    rack = "case _region " + " ".join(
        f"when {r} then " + _least([(draw(key, f"g{r}k{k}", weigh_rack(x)), f"{r * 1000 + k}") for k, x in enumerate(racks)])
        for r, racks in enumerate(tree.regions)
    ) + " end"
    shard = "case _rack " + " ".join(
        f"when {r * 1000 + k} then " + _least([(draw(key, f"s{s}", w), str(s)) for s, w in x])
        for r, racks in enumerate(tree.regions)
        for k, x in enumerate(racks)
    ) + " end"
    return [("_region", region), ("_rack", rack), ("_shard", shard)]


def place(df: DataFrame, tree: Tree, out: str, key: str = "_key") -> DataFrame:
    """Add the column ``out`` with each row's shard for the text column ``key``."""
    for name, text in shard_column(key, tree):
        df = df.withColumn(name, F.expr(text))
    return df.withColumn(out, F.col("_shard").cast("int")).drop("_region", "_rack", "_shard")


def shard(documents: DataFrame, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot and the shard after growth for every row of ``documents``."""
    tree = tree or Tree.even()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (
        documents.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    )
    placed = place(place(rows, tree, "shard"), tree.grow(), "grown_shard").withColumn(
        "_block", F.expr(BLOCK)
    )
    counts = placed.groupBy("shard", "_block").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = (
        Window.partitionBy("shard", "_block")
        .orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = placed.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    # at most shards * 16^BLOCK_DIGITS small rows, however large the input
    bounded = tree.size() * 16**BLOCK_DIGITS <= BROADCAST_BLOCKS
    joined = numbered.join(F.broadcast(offsets) if bounded else offsets, ["shard", "_block"])
    return joined.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.expr("sequence(_start + _before, _start + _before + _n - 1)")).alias("slot"),
        "grown_shard",
    )
