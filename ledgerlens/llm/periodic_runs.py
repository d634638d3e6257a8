"""Periodic runs of words.

A run is a stretch of consecutive words with smallest period q that keeps this
period and cannot be extended, of at least max(6, 4q) words. Each word of a run
occurs in it four times or more. So words that occur less often within a
segment cannot join a run of that segment: they split it. The parts are counted
again and split again until nothing changes (only parts that were split are
counted anew); parts of fewer than six words go. For most prose nothing is left.

The surviving segments are scanned by lags, the lags q in [B, 2B) together for
B = 1, 2, 4, ...: a run of 4q words holds a block of B words that starts at a
multiple of B and recurs q words on. Blocks are compared by exact ranks (equal
rank: equal words), each block with the B lags of its step, so a step costs one
comparison a word. Matches are extended to both sides by the same ranks; of
equal stretches the smallest period stays. Texts of a batch are scanned
together, separated by marks that equal nothing; one text is never cut.

Cases: null and empty texts have no words, no run and the empty string as
collapsed text; words are separated by ASCII white space only; repeated rows
and ids give a row each; a null id stays null; other columns are not read. No
rows move between tasks: there is no shuffle and nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import chunks

LEAST = 6  # words of a run
TIMES = 4  # periods of a run
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def split_rare(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions, with their segments, that survive frequency splitting.

    ``segment`` numbers the given segments; words are non-negative numbers."""
    at = np.arange(len(words))
    part = segment.astype(np.int64)
    done_at, done_part, used = [], [], 0
    span = np.int64(words.max(initial=0) + 1)
    while len(at):
        _, inverse, counts = np.unique(part * span + words[at], return_inverse=True, return_counts=True)
        keep = counts[inverse] >= TIMES
        cut = np.zeros(int(part[-1]) + 1, bool)
        cut[part[~keep]] = True
        stable = ~cut[part]
        done_at.append(at[stable])
        done_part.append(part[stable] + used)
        used += int(part[-1]) + 1
        at, part = at[keep & ~stable], part[keep & ~stable]
        if not len(at):
            break
        begins = np.ones(len(at), bool)
        begins[1:] = (np.diff(at) > 1) | (np.diff(part) > 0)
        part = np.cumsum(begins) - 1
        long_enough = np.bincount(part)[part] >= LEAST
        at, part = at[long_enough], part[long_enough]
        part = np.unique(part, return_inverse=True)[1]
    if not done_at:
        return at, part
    at, part = np.concatenate(done_at), np.concatenate(done_part)
    order = np.argsort(at, kind="stable")
    at, part = at[order], part[order]
    enough = np.bincount(part, minlength=1)[part] >= LEAST
    at, part = at[enough], part[enough]
    begins = np.zeros(len(at), np.int64)
    begins[1:] = part[1:] != part[:-1]
    return at, np.cumsum(begins)


def block_ranks(line: np.ndarray, longest: int) -> list[np.ndarray]:
    """ranks[k][i] numbers the block of 2^k words at i."""
    ranks = [np.unique(line, return_inverse=True)[1].astype(np.int64)]
    while (2 << (len(ranks) - 1)) <= longest:
        last, half = ranks[-1], 1 << (len(ranks) - 1)
        pair = last[:-half] * np.int64(len(line) + 1) + last[half:]
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
    return ranks


def _extended(ranks: list[np.ndarray], low: np.ndarray, high: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The widest [low, high) around the given ones in which words equal those ``lag`` on."""
    low, high = low.copy(), high.copy()
    for k in range(len(ranks) - 1, -1, -1):
        rank, size = ranks[k], 1 << k
        fits = np.flatnonzero(high + lag + size <= len(ranks[0]))
        more = fits[rank[high[fits]] == rank[high[fits] + lag[fits]]]
        high[more] += size
        fits = np.flatnonzero(low >= size)
        more = fits[rank[low[fits] - size] == rank[low[fits] - size + lag[fits]]]
        low[more] -= size
    return low, high


def lag_scan(line: np.ndarray, longest: int) -> np.ndarray:
    """Runs (start, length, period) of a line of numbers whose longest stretch
    without a mark has ``longest`` words. Marks are numbers that occur once."""
    found = []
    ranks = block_ranks(line, longest)
    block, k = 1, 0
    while TIMES * block <= longest:
        rank = ranks[k]
        base = np.arange(0, len(rank), block)
        for some in np.array_split(base, max(1, len(base) * block >> 22)):
            other = some[:, None] + np.arange(block, 2 * block)[None, :]
            inside = other < len(rank)
            hit = inside & (rank[np.where(inside, other, 0)] == rank[some][:, None])
            row, column = np.nonzero(hit)
            if len(row):
                low, lag = some[row], column + block
                low, high = _extended(ranks, low, low + block, lag)
                length = high - low + lag
                good = length >= np.maximum(LEAST, TIMES * lag)
                found.append(np.unique(np.stack([low[good], length[good], lag[good]], 1), axis=0))
        block, k = 2 * block, k + 1
    if not found:
        return np.empty((0, 3), np.int64)
    runs = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each list of words, as rows (start, length, period)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    nothing = np.empty((0, 3), np.int64)
    at, part = split_rare(words, np.repeat(np.arange(len(texts)), sizes))
    if not len(at):
        return [nothing for _ in texts]
    # surviving segments one after the other, a mark after each
    place = np.arange(len(at)) + part
    line = np.empty(len(at) + int(part[-1]) + 1, np.int64)
    line[place] = words[at]
    marks = np.setdiff1d(np.arange(len(line)), place, assume_unique=True)
    line[marks] = len(number) + np.arange(len(marks))
    back = np.full(len(line), -1, np.int64)
    back[place] = at
    runs = lag_scan(line, int(np.bincount(part).max()))
    runs[:, 0] = back[runs[:, 0]]
    owner = np.searchsorted(begins, runs[:, 0], "right") - 1
    runs[:, 0] -= begins[owner]
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [runs[edges[i] : edges[i + 1]] for i in range(len(texts))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0))


def periodic_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, the runs by start and period, and the text with each run cut to its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in chunks(batch["t"].to_pylist()):
                texts = [t.split() for t in some]
                runs = find_runs(texts)
                spans = np.concatenate(runs)
                edges = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(spans[:, c], pa.int64()) for c in range(3)], fields=list(RUN))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(at, len(some)),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(edges), values),
                        pa.array([collapse(t, r).decode("utf-8", "replace") for t, r in zip(texts, runs)], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
                at += len(some)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, SCHEMA)


def with_planted_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A tenth of the documents, by crc32 of the id, made periodic from a word on
    (the damage of the contract). A null id plants nothing."""
    words = F.filter(F.split(F.col(text_col), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g = F.expr(f"crc32(cast(cast(`{id_col}` as string) as binary)) div 10")
    n = F.size("__w")
    a = (F.col("__g") % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("__g") % 8))).cast("int")
    planted = F.transform("__w", lambda w, i: F.when(i < F.col("__a"), w).otherwise(F.get("__w", F.col("__a") + (i - F.col("__a")) % F.col("__p"))))
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0
    return (
        documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), hit.alias("__hit"), g.alias("__g"))
        .withColumn("__w", F.when(F.col("__hit"), words))
        .withColumn("__a", F.when(n > 0, a))
        .withColumn("__p", F.when(n > 0, p))
        .select("doc_id", F.when(F.col("__a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
    )


def digest(found: DataFrame) -> DataFrame:
    """Per document: the number of runs, the run of most periods (ties: least
    start, then period), and digests of all runs and of the collapsed text."""
    best = F.reduce(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))),
        F.get("runs", F.lit(0)),
        lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b),
    )
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
