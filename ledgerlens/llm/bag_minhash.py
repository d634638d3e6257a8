"""Near-duplicate classes by BagMinHash.

A text is the multiset (bag) of its five-word shingles. Every shingle starts a
Poisson process for each dyadic interval of its weight, [0, 1), [1, 2), [2, 4),
..., at the interval's length as rate; a point of it falls on one unit level
inside the interval (found by halving, here by the bits of one draw) and counts
if that level is below the shingle's weight. Each point goes to one of the
registers, which keep their earliest point. Two bags share a register's point
with the probability of their weighted Jaccard similarity, sum of minima over
sum of maxima.

Equal texts become one node. Nodes with an equal band (``ROWS`` registers) share
a bucket. Links are verified on the bags themselves, sizes first, and classes
are the connected components of verified links. As only classes are wanted,
each bucket is first compared with one leader, whatever its size. Where that
leaves several classes in a bucket, a bucket of at most ``SMALL`` members
compares those of different classes. Larger buckets, joined where they share a
member, are crowds: each has a centre (its commonest shingles), and its members
are compared by how they differ from it (``crowd_pairs``). Near copies with edits
of their own differ in ways that nobody shares, so crowds of texts just under
the threshold yield few pairs; no pair is left out.

A pair of similarity 0.8 shares no bucket with probability (1 - 0.8^4)^20,
under 3 in 100,000.

Cases: null and empty texts have no shingles and are classes of their own;
texts of one to four words are one shingle; white space and the case of A-Z
don't count; repeated rows are copies; a null id is last among a class's ids;
long texts are read whole; an empty table gives an empty result; only id and
text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import chunks, frozen, passing_tables

SHINGLE = 5
SIMILAR = (4, 5)  # similarity of at least 4 / 5
BANDS, ROWS = 20, 4
SMALL = 32  # buckets up to this size compare all members of different classes
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stride(k: int) -> np.uint64:
    return np.uint64(k * int(_GOLDEN) % (1 << 64))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Shingles:
    """Hashed shingles of a text; keeps the hashes of words."""

    KEPT = 100_000

    def __init__(self):
        import xxhash

        self.hash, self.known = xxhash.xxh64_intdigest, {}

    def bag(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes and their counts."""
        words = text.lower().split()
        if len(self.known) > self.KEPT:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h, np.zeros(0, np.int64)
        n = min(len(h), SHINGLE)  # fewer words are one shingle
        g = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            g = mix(g * _GOLDEN + h[k : len(h) - n + 1 + k])
        return np.unique(g, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """One row of registers (times of their earliest points) for each bag; the
    same point gives the same number in every bag. Empty bags keep infinity."""
    sizes = [len(b[0]) for b in bags]
    reg = np.full((len(bags), registers), np.inf)
    element = np.concatenate([b[0] for b in bags]) if bags else np.zeros(0, np.uint64)
    weight = np.concatenate([b[1] for b in bags]) if bags else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(bags)), sizes)
    # processes: interval k is [low, low + rate)
    seeds, rates, lows, weights, owners = [], [], [], [], []
    low, k = 0, 0
    while len(element):
        rate = max(low, 1)
        seeds.append(mix(element + stride(k)))
        rates.append(np.full(len(element), float(rate)))
        lows.append(np.full(len(element), low))
        weights.append(weight)
        owners.append(owner)
        low, k = low + rate, k + 1
        more = weight > low
        element, weight, owner = element[more], weight[more], owner[more]
    if not seeds:
        return reg
    seed, rate, low, weight, owner = map(np.concatenate, (seeds, rates, lows, weights, owners))
    time, flat, point = np.zeros(len(seed)), reg.reshape(-1), 0
    latest = np.full(len(bags), np.inf)
    while len(seed):
        point += 1
        h = mix(seed + stride(2 * point))
        time = time - np.log(unit(h)) / rate
        live = time < latest[owner]
        seed, rate, low, weight, owner, time, h = (x[live] for x in (seed, rate, low, weight, owner, time, h))
        if not len(seed):
            break
        h = mix(h ^ np.uint64(0xD6E8FEB86659FD93))
        register = (h >> np.uint64(40)) % np.uint64(registers)
        level = low + ((h & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate).astype(np.int64)
        counts = level < weight
        np.minimum.at(flat, owner[counts] * registers + register[counts].astype(np.int64), time[counts])
        touched = np.unique(owner)
        latest[touched] = reg[touched].max(1)
    return reg


def band_keys(reg: np.ndarray, bands: int, rows: int, salt: int = 0) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers."""
    bits = reg[:, : bands * rows].copy().view(np.uint64).reshape(len(reg), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + np.uint64(salt * 1000 + 1)), (len(reg), bands)).copy()
    for k in range(rows):
        key = mix(key * _GOLDEN + bits[:, :, k])
    return key.view(np.int64)


# ---------------------------------------------------------------- Spark


@cache
def worker_shingles() -> Shingles:
    return Shingles()


def signed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, weight, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = worker_shingles()
        for batch in batches:
            keys, weights, bands = [], [], []
            for some in chunks(batch["t"].to_pylist()):
                bags = list(map(shingles.bag, some))
                keys += [hashlib.md5(t).digest() for t in some]
                weights += [int(b[1].sum()) for b in bags]
                rows = band_keys(signatures(bags, BANDS * ROWS), BANDS, ROWS).tolist()
                bands += [r if len(b[0]) else [] for r, b in zip(rows, bags)]
            columns = [batch["doc_id"], pa.array(keys, pa.binary()), pa.array(weights, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "weight", "bands"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, text_key binary, weight long, bands array<long>")


def text_key(text: Column) -> Column:
    """The key that ``signed`` gives a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def alike(bag_a: tuple[np.ndarray, np.ndarray], bag_b: tuple[np.ndarray, np.ndarray]) -> bool:
    _, at_a, at_b = np.intersect1d(bag_a[0], bag_b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(bag_a[1][at_a], bag_b[1][at_b]).sum())
    either = int(bag_a[1].sum() + bag_b[1].sum()) - both
    return SIMILAR[1] * both >= SIMILAR[0] * either


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of rows (a, b), those whose texts' bags overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, bag = worker_shingles(), None, None
        for batch in batches:
            held = []
            for a, b, ta, tb in zip(*(batch[c].to_pylist() for c in ("a", "b", "ta", "tb"))):
                if a != last:
                    last, bag = a, shingles.bag(ta)
                held.append(alike(bag, shingles.bag(tb)))
            mask = pa.array(held, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    # always shuffled, alike at every size; a leader with many partners is split by AQE
    side = lambda end: texts.select(F.col("node").alias(end), F.col("t").alias(f"t{end}")).hint("merge")
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, class) for the nodes of links (a, b): the least node that they
    reach. Each round takes the least class of the neighbours, then the class
    of that class, so long chains shrink by powers."""
    ways = frozen(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "ways")
    labels = frozen(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("class")), "labels")
    while True:
        near = ways.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        step = labels.join(near, "node").select("node", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        there = step.select(F.col("node").alias("class"), F.col("class").alias("beyond"))
        new = frozen(step.join(there, "class", "left").select("node", "old", F.coalesce("beyond", "class").alias("class")), "labels")
        labels = new.select("node", "class")
        if new.where("class <> old").isEmpty():
            return labels


def with_class(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("class", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))


def sizes_fit(x: str, y: str) -> Column:
    """The lighter bag weighs enough of the heavier for the similarity."""
    return SIMILAR[1] * F.least(x, y) >= SIMILAR[0] * F.greatest(x, y)


def mixed_buckets(rows: DataFrame) -> DataFrame:
    """Buckets of rows (bucket, n, node, weight, class) that hold several
    classes, each with one leader."""
    lead = F.min_by(F.struct("node", "weight", "class"), F.xxhash64("node")).alias("lead")
    found = rows.groupBy("bucket").agg(lead, F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi")
    return frozen(found.select("bucket", "lead.*").toDF("bucket", "a", "wa", "ca"), "mixed")


def leader_pairs(rows: DataFrame) -> DataFrame:
    pairs = rows.join(mixed_buckets(rows), "bucket").where((F.col("class") != F.col("ca")) & sizes_fit("weight", "wa"))
    return pairs.select("a", F.col("node").alias("b")).distinct()


def small_pairs(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """Pairs of different classes in mixed buckets of at most SMALL members."""
    few = rows.where(F.col("n") <= SMALL).join(mixed.select("bucket"), "bucket").select("bucket", "node", "weight", "class")
    pairs = few.join(few.toDF("bucket", "a", "wa", "ca"), "bucket").where((F.col("a") < F.col("node")) & (F.col("class") != F.col("ca")) & sizes_fit("weight", "wa"))
    return pairs.select("a", F.col("node").alias("b")).distinct()


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(crowd, node, class, n, tokens) of rows (crowd, node, class, t): a bag as the
    set of its shingles numbered by occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = worker_shingles()
        for batch in batches:
            sets = []
            for t in batch["t"].to_pylist():
                h, c = shingles.bag(t)
                nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                sets.append(mix(np.repeat(h, c) + nth.astype(np.uint64) * _GOLDEN).view(np.int64))
            columns = [batch["crowd"], batch["node"], batch["class"], pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["crowd", "node", "class", "n", "tokens"])

    return rows.select("crowd", "node", "class", "t").mapInArrow(run, "crowd long, node long, class long, n long, tokens array<long>")


def crowds(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """(node, crowd) of the members of large mixed buckets: members of one bucket,
    and of buckets with a member in common, are one crowd. Components are found
    among the buckets, of which a crowd of any size has few."""
    large = rows.where(F.col("n") > SMALL).join(mixed.select("bucket"), "bucket")
    heads = frozen(large.groupBy("node").agg(F.array_sort(F.collect_set("bucket")).alias("buckets")), "large")
    first = F.get("buckets", F.lit(0)).alias("first")
    labels = components(heads.select(first.alias("a"), F.explode("buckets").alias("b")).distinct())
    found = heads.select("node", first).join(labels.toDF("first", "crowd"), "first", "left")
    return found.select("node", F.coalesce("crowd", "first").alias("crowd"))


ASKED = 64  # members of a crowd, about, whose tokens decide its centre


def centres(sets: DataFrame) -> DataFrame:
    """(crowd, centre, wide) for each crowd: the tokens that its members use more
    than half as often as the commonest one, and the mean size of its sets. About
    ``ASKED`` members by hash are asked, all of a smaller crowd: a centre decides
    how many pairs are compared, and never which are found."""
    sizes = frozen(sets.groupBy("crowd").agg(F.avg("n").alias("wide"), F.count(F.lit(1)).alias("members")), "sizes")
    asked = sets.join(sizes, "crowd").where(F.pmod(F.xxhash64("node"), F.col("members")) < ASKED)
    uses = frozen(asked.select("crowd", F.explode("tokens").alias("token")).groupBy("crowd", "token").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1"), "uses")
    most = uses.groupBy("crowd").agg(F.max("uses").alias("most"))
    common = uses.join(most, "crowd").where(2 * F.col("uses") > F.col("most")).groupBy("crowd").agg(F.sort_array(F.collect_list("token")).alias("centre"))
    return frozen(sizes.drop("members").join(common, "crowd", "left"), "centres")


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    """A column of lists as views of its numbers; null as the empty list."""
    edges, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(edges[:-1], edges[1:])]


def differences(sets: DataFrame, centre: DataFrame) -> DataFrame:
    """(crowd, node, class, n, wide, diff): the tokens by which a set differs from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            diff = [
                np.setxor1d(t, c, assume_unique=True) for t, c in zip(arrays(batch["tokens"]), arrays(batch["centre"]))
            ]
            names = ["crowd", "node", "class", "n", "wide"]
            yield pa.RecordBatch.from_arrays([*[batch[x] for x in names], pa.array(diff, pa.list_(pa.int64()))], [*names, "diff"])

    return sets.join(centre, "crowd").mapInArrow(run, "crowd long, node long, class long, n long, wide double, diff array<long>")


SLOT_BITS = 20  # counters: a table of bounded size at any input


def within(crowd: int, tokens: np.ndarray) -> np.ndarray:
    """Hashes of tokens of a crowd."""
    return mix(tokens.view(np.uint64) + stride(crowd))


def slot(crowd: int, tokens: np.ndarray) -> np.ndarray:
    """Counter of a token within its crowd."""
    return (within(crowd, tokens) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


BLOCK_BITS = 13  # slots of a block of the counter table
GROUP_TASKS = 256  # tasks whose blocks meet in the first step of adding


def slot_counts(diffs: DataFrame) -> np.ndarray:
    """How often the tokens of each slot occur: at most 2^SLOT_BITS numbers. Tasks
    hand on the slots they met by blocks of the table, which are added in two
    steps, so that what meets in one task is bounded by the table."""
    size = 1 << BLOCK_BITS
    schema = "grp long, block long, slots array<int>, counts array<long>"

    def row(grp: int, block: int, counts: np.ndarray) -> pa.RecordBatch:
        seen = np.flatnonzero(counts)
        columns = [pa.array([grp]), pa.array([block]), pa.array([seen.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts[seen]], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["grp", "block", "slots", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for crowd, tokens in zip(batch["crowd"].to_pylist(), arrays(batch["diff"])):
                np.add.at(counts, slot(crowd, tokens), 1)
        by_block = counts.reshape(-1, size)
        for k in np.flatnonzero(by_block.any(1)).tolist():
            yield row(TaskContext.get().partitionId() // GROUP_TASKS, k, by_block[k])

    def add(table: pa.Table) -> pa.Table:
        counts = np.zeros(size, np.int64)
        for part in table.to_batches():
            np.add.at(counts, part["slots"].flatten().to_numpy(), part["counts"].flatten().to_numpy())
        return pa.Table.from_batches([row(0, table["block"][0].as_py(), counts)])

    parts = diffs.select("crowd", "diff").mapInArrow(run, schema).groupBy("grp", "block").applyInArrow(add, schema)
    rows = parts.groupBy("block").applyInArrow(add, schema).toArrow()
    counts = np.zeros((max(1, (1 << SLOT_BITS) // size), size), np.int64)
    for block, slots, c in zip(rows["block"].to_pylist(), rows["slots"], rows["counts"]):
        counts[block, slots.values.to_numpy()] = c.values.to_numpy()
    return counts.ravel()


def crowd_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (node, class, crowd) whose links join the same
    classes as all similar pairs of different classes in a crowd do.

    Sets A and B of sizes a and b are similar if they differ in at most (a + b) / 9
    tokens. A crowd of near copies has a centre; with d the tokens by which a
    set differs from it and s = 9 d - size, A and B are similar if and only if
    their differences from the centre have at least (s_A + s_B) / 18 tokens in
    common. Sets that need none, counted with the set nearest to the centre, are
    similar to that one: one pair each. For the rest, rare tokens of the
    differences come first, and a pair must share one within the prefixes that
    its common tokens leave; s is cut into levels, and each set has a prefix for
    each level, so that sets far from the centre never meet by what all of them
    lack. Any centre and any order give all pairs; they only decide how few."""
    sets = frozen(shingle_sets(members.join(texts.hint("merge"), "node")), "sets")
    diffs = frozen(differences(sets, centres(sets)), "differences")
    score = 9 * F.size("diff") - F.col("n")
    nearest = frozen(diffs.groupBy("crowd").agg(F.min_by(F.struct("node", "class", score.alias("s")), F.struct(score, "node")).alias("near")).select("crowd", "near.*"), "nearest")
    with_near = diffs.join(nearest.toDF("crowd", "near", "near_class", "least"), "crowd").withColumn("s", score)
    sure = with_near.where((F.col("s") + F.col("least") <= 0) & (F.col("class") != F.col("near_class"))).select(F.col("near").alias("a"), F.col("node").alias("b"))

    counts = members.sparkSession.sparkContext.broadcast(slot_counts(diffs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = counts.value
        for batch in batches:
            out: list[tuple] = []
            for *known, tokens in zip(*(batch[c].to_pylist() for c in ("crowd", "node", "class", "n", "wide", "least")), arrays(batch["diff"])):
                out.append(prefix_rows(*known, tokens, uses))
                if len(out) == 256:
                    yield from as_batch(out)
                    out = []
            yield from as_batch(out)

    names = ["key", "node", "class", "n", "s", "rest", "lost", *[f"m{k}" for k in range(MARK_WORDS)]]

    def as_batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names)

    kept = frozen(with_near.select("crowd", "node", "class", "n", "wide", "least", "diff").mapInArrow(run, ", ".join(f"{x} long" for x in names)), "prefixes")
    other = kept.toDF("key", *[f"{x}a" for x in names[1:]]).withColumnsRenamed({"nodea": "a", "classa": "ca"})
    # tokens in common: at most those from the first one on, and at most the shared marks
    common = sum(F.bit_count(F.col(f"m{k}").bitwiseAND(F.col(f"m{k}a"))) for k in range(MARK_WORDS)) + F.least("lost", "losta")
    enough = 18 * F.least("rest", "resta", common) >= F.col("s") + F.col("sa")
    pairs = kept.join(other, "key").where((F.col("a") < F.col("node")) & (F.col("class") != F.col("ca")) & sizes_fit("n", "na") & enough)
    return sure.union(pairs.select("a", F.col("node").alias("b"))).distinct()


MARK_WORDS = 4  # 64-bit words that mark the tokens of a difference that others have, too
LEVEL_SIZES = 3  # a level of s is as wide as so many mean sizes of a crowd's sets


def prefix_rows(crowd: int, node: int, cls: int, n: int, wide: float, least: int, diff: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, node, class, n, s, rest, lost, marks) of a set's prefixes for all
    levels. A key stands for crowd, token and the two levels that meet; ``rest``
    is the number of tokens from that one on; the marks have one bit for each
    token that others use, too, and ``lost`` counts those that share a bit."""
    d, width = len(diff), max(9, int(LEVEL_SIZES * wide))
    s = 9 * d - n
    used = uses[slot(crowd, diff)]
    order = np.lexsort((diff, used))
    tokens, shared = diff[order], used[order] > 1  # a token used once meets nobody
    own = (s - least) // width
    # a partner needs (s + its s) / 18 <= d common tokens
    levels = np.arange(0, max(0, (18 * d - s - least) // width) + 1)
    common = np.maximum(1, -((-(s + least + levels * width)) // 18))
    at = np.flatnonzero(shared)
    row, column = np.nonzero(at[None, :] <= (d - common)[:, None])
    low, high = np.minimum(levels[row], own).astype(np.uint64), np.maximum(levels[row], own).astype(np.uint64)
    key = mix(within(crowd, tokens[at[column]]) + (low << np.uint64(32)) + high)
    bits = np.unique((tokens[at].view(np.uint64) >> np.uint64(8)) % np.uint64(64 * MARK_WORDS)).astype(np.uint64)
    marks = [np.bitwise_or.reduce(np.uint64(1) << (bits[bits // 64 == k] % 64), initial=np.uint64(0)).view(np.int64) for k in range(MARK_WORDS)]
    full = lambda v: np.full(len(row), v, np.int64)
    return key.view(np.int64), full(node), full(cls), full(n), full(s), (d - at[column]).astype(np.int64), full(len(at) - len(bits)), *map(full, marks)


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Classes after more links (a, b)."""
    if links.isEmpty():
        return labels
    ends = with_class(links.select(F.col("a").alias("node"), "b"), labels).select(F.col("class").alias("a"), F.col("b").alias("node"))
    joined = components(with_class(ends, labels).select("a", F.col("class").alias("b")))
    if labels is None:
        return joined
    moved = labels.join(joined.toDF("class", "onto"), "class", "left").select("node", F.coalesce("onto", "class").alias("class"))
    return frozen(moved.union(joined).distinct(), "labels")


def link_classes(held: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(node, class) of linked nodes, from rows (bucket, n, node, weight)."""

    def checked(pairs: DataFrame) -> DataFrame:
        return frozen(verified(frozen(pairs, "pairs"), texts), "links")

    labels = merged(None, checked(leader_pairs(with_class(held, None))))
    rows = frozen(with_class(held, labels), "members")
    mixed = mixed_buckets(rows)
    labels = merged(labels, checked(small_pairs(rows, mixed)))
    crowd = frozen(with_class(crowds(rows, mixed), labels), "crowd")
    if crowd.isEmpty():
        return labels
    return merged(labels, checked(crowd_pairs(crowd, texts)))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of the class), class_size, kept (one row of
    each class) and text_key for every row."""
    with passing_tables(documents.sparkSession) as stay:
        named, classes = stay(*_named_classes(documents, id_col, text_col))
    return named.join(classes, "class").select(
        "doc_id", "class_id", "class_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_key"
    )


def _named_classes(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their class, classes), both written."""
    signs = frozen(signed(documents, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "signatures")
    nodes = frozen(
        signs.where("weight > 0").groupBy("text_key").agg(F.min("row").alias("node"), F.first("weight").alias("weight"), F.first("bands").alias("bands")),
        "nodes",
    )
    members = nodes.select("node", "weight", F.explode("bands").alias("bucket"))
    shared = frozen(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    held = frozen(members.join(shared, "bucket"), "members")
    wanted = frozen(nodes.select("text_key", "node").join(held.select("node").distinct(), "node"), "wanted")
    texts = frozen(
        documents.select(F.col(text_col).cast("binary").alias("t"), text_key(F.col(text_col)).alias("text_key"))
        .join(wanted.hint("merge"), "text_key")
        .groupBy("node")
        .agg(F.first("t").alias("t")),
        "texts",
    )
    labels = link_classes(held, texts)
    named = signs.join(with_class(nodes.select("text_key", "node"), labels).select("text_key", "class"), "text_key", "left")
    # texts without shingles stand alone
    named = frozen(named.select("row", "doc_id", "text_key", F.coalesce("class", "row").alias("class")), "named")
    classes = frozen(
        named.groupBy("class").agg(
            F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
        ),
        "classes",
    )
    return named, classes


def distinct_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with the columns of ``documents``."""

    def row_key(doc_id: Column, key: Column) -> Column:
        return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), F.hex(key)))

    kept = near_duplicates(documents, id_col, text_col).where("kept").select(row_key(F.col("doc_id"), F.col("text_key")).alias("__llm_key"))
    rows = documents.withColumn("__llm_key", row_key(F.col(id_col), text_key(F.col(text_col))))
    has_words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # rows that repeat an id and a text: one of them; texts without shingles all stay
    once = rows.where(has_words).join(kept, "__llm_key", "left_semi").dropDuplicates(["__llm_key"])
    return once.unionByName(rows.where(~has_words)).drop("__llm_key").select(documents.columns)
