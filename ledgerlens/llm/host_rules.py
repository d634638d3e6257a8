"""Quality rules by host.

Every document is measured and held against document rules. Failures are
counted by host, a beta prior is fitted to the hosts' failure rates by moments
(mean over all documents, spread between hosts beyond binomial noise), each
host's rate is shrunk to that prior, and the host's verdict is joined back to
its documents. A document goes if it fails the base rule or if its host's
shrunk failure rate is over ``HOST_LIMIT``, that is, if its next document more
likely fails than not. The limit is fixed: bad hosts do not stand out by being
worse than others, and where no rate reaches it no host goes.

Measures are taken in one pass over the texts and written once as a narrow
table; only that table is aggregated and joined, so a host with a third of all
rows costs partial sums. The join's small side is written too: Spark chooses
broadcast by its size or splits a hot host's rows.

Cases: null and empty texts have no words and fail the base rule; a document
without a host takes the prior's mean and no host verdict; with no documents,
or all hosts alike, the prior is as strong as it can be; repeated rows count
as often as they occur; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import chunks, frozen

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOL_PERCENT = 10  # of word characters
DUP_LINE_PERCENT = 30  # of words' lines
HOST_LIMIT = 0.5
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))  # white space and continuation bytes
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice. Windows get exact ranks
    by doubling (1, 2, 4, 8 words), so equal rank means equal words."""
    n = len(words)
    if n <= window or len(set(words)) == n:
        return 0
    number: dict[bytes, int] = {}
    rank = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    span, inverse, counts = 1, rank, None
    while span < window:
        inverse = inverse[:-span] * np.int64(n + 1) + inverse[span:]
        _, inverse, counts = np.unique(inverse, return_inverse=True, return_counts=True)
        span *= 2
    at = np.flatnonzero(counts[inverse] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    return (
        len(words),
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def measured(documents: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for some in chunks(batch["t"].to_pylist()) for t in some]
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64()) for _ in names]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["host"], *columns], ["doc_id", "host", *names])

    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("binary").alias("t")
    )
    return rows.mapInArrow(run, f"doc_id long, host string, {MEASURES}")


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) by moments from (n, failed) of all hosts."""
    row = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n").alias("n"),
        F.sum("failed").alias("failed"),
        F.sum(F.col("n") * F.col("n").cast("double")).alias("n2"),
        F.sum(F.col("failed") * F.col("failed").cast("double") / F.col("n")).alias("k2"),
    ).first()
    n = float(row["n"] or 0)
    mean = (float(row["failed"] or 0) + 0.5) / (n + 1.0)
    share = float(row["failed"] or 0) / n if n else mean
    noise = share * (1 - share)
    between = float(row["k2"] or 0) - n * share * share  # sum of n (p - mean)^2
    room = n - float(row["n2"] or 0) / n - (row["hosts"] - 1) if n else 0.0
    rho = (between - (row["hosts"] - 1) * noise) / (room * noise) if room > 0 and noise > 0 else 0.0
    rho = min(max(rho, 1e-4), 0.99)
    strength = 1 / rho - 1
    return mean * strength, (1 - mean) * strength


def host_rules(
    documents: DataFrame, host_limit: float = HOST_LIMIT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """Measures, base rule, host figures and verdict for every row."""
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n)
    fails = base | (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"))
    rows = frozen(
        measured(documents, id_col, text_col, host_col).withColumn("base_failed", base).withColumn("rule_failed", fails), "host-rules"
    )
    hosts = frozen(
        rows.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failed")),
        "hosts",
    )
    alpha, beta = beta_prior(hosts)
    verdicts = hosts.select(
        "host",
        F.col("n").alias("host_docs"),
        F.col("failed").alias("host_failed"),
        ((F.col("failed") + alpha) / (F.col("n") + alpha + beta)).alias("host_rate"),
    )
    joined = rows.join(verdicts, "host", "left")
    rate = F.coalesce(F.col("host_rate"), F.lit(alpha / (alpha + beta)))
    return joined.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= host_limit)).alias("kept"),
        "n_words",
        "rule_failed",
        "host",
        rate.alias("host_rate"),
    )
