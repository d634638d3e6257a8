"""Benchmark decontamination: a prefix-filtered containment join.

A benchmark item is a set of windows of ``window`` consecutive words (a
shorter item is one window). A document holds a window only if it holds all of
its words in place, so the overlap that a pair needs is the whole window and
its prefix, in an order by rarity, is one token: the word that the documents
use least. Document words are joined to these necessary words alone; a match at
a place bounds where the window would start and end (positional and length
bounds), and the words there are then compared one by one.

Rarity comes from exact counts of the benchmark's words in all documents. The
benchmark's windows are broadcast only if there are at most
``BROADCAST_WINDOWS`` of them and their words take at most ``BROADCAST_BYTES``;
they carry the name of a group of items, whose ids are joined by shuffle to the
groups that a document holds. Beyond that bound the necessary words meet the
document words in a shuffle join and survivors are compared after a join back
to their documents. Results are the same.

Cases: null and empty texts (of documents or items) have no words and no hit;
documents shorter than a window can only hold shorter items; a word inside
several windows counts once; equal items all count in ``n_items``; repeated
rows are returned as often as they occur; null ids stay null; an empty
benchmark leaves every document clean; only id and text columns are read.
DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import frozen

WINDOW = 13
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 64 << 20  # of their words; a word may be long
RATIO = 20  # contaminated from one word in RATIO hit
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words of a text; A-Z in lower case, other letters as they are."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, NOT_WORD), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """md5 of id and text; a null text counts as empty, as both have no words."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))))


def windows_of(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win, grp) and the items (grp, item_id) of each group.

    Windows of the same set of items form a group. Its name is that set's size
    and two sums of md5 parts, so that no task gathers the set: an item text
    repeated in a third of the table costs partial sums, and one group."""
    n = F.size("words")
    start = F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))))
    held = frozen(
        items.where(n > 0)
        .select("item_id", "words", start.alias("i"))
        .select("item_id", F.slice("words", F.col("i") + 1, window).alias("win"))
        .select("item_id", "win", F.md5(F.array_join("win", " ")).alias("win_key"))
        .groupBy("win_key", "item_id")
        .agg(F.first("win").alias("win")),
        "item-windows",
    )
    part = lambda at: F.sum(F.conv(F.substring(F.md5("item_id"), at, 15), 16, 10).cast("decimal(20,0)"))
    named = frozen(
        held.groupBy("win_key")
        .agg(F.first("win").alias("win"), F.md5(F.concat_ws(":", F.count(F.lit(1)), part(1), part(16))).alias("grp")),
        "windows",
    )
    members = held.select("win_key", "item_id").join(named.select("win_key", "grp"), "win_key").select("grp", "item_id").distinct()
    return named.select("win", "grp"), members


def anchored(windows: DataFrame, documents: DataFrame, broadcast: bool) -> DataFrame:
    """Windows with their rarest word (ties: the word, then the first place)."""
    hint = F.broadcast if broadcast else (lambda x: x)
    placed = windows.select("win", F.posexplode("win").alias("offset", "word"))
    wanted = placed.select("word").distinct()
    counts = documents.select(F.explode("tokens").alias("word")).join(hint(wanted), "word").groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    rarest = (
        placed.join(counts, "word", "left")
        .groupBy("win")
        .agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "word", "offset")).alias("r"))
    )
    return windows.join(rarest, "win").select("win", "grp", F.col("r.word").alias("word"), F.col("r.offset").alias("offset"), F.size("win").alias("len"))


KEY = ["doc_id", "text_key", "n_words"]  # text_key: md5 of id and text


def matches(documents: DataFrame, anchors: DataFrame, broadcast: bool) -> DataFrame:
    """Rows (KEY, start, len, grp): one for every window found at a place, and
    one with null start for every input row (that of the leading null token,
    which joins nothing). Places count from 1."""
    tokens = documents.select("*", F.posexplode("tokens").alias("pos", "word"))
    start = F.col("pos") - F.col("offset")
    fits = (start >= 1) & (start + F.col("len") - 1 <= F.col("n_words"))
    if broadcast:
        same = F.when(fits, F.slice("tokens", start + 1, F.col("len")) == F.col("win")).otherwise(F.lit(False))
        return (
            tokens.join(F.broadcast(anchors), "word", "left")
            .where(F.col("word").isNull() | F.coalesce(same, F.lit(False)))
            .select(*KEY, start.alias("start"), "len", "grp")
        )
    candidates = tokens.select(*KEY, "pos", "word").join(anchors, "word").where(fits).select("text_key", start.alias("start"), "len", "win", "grp").distinct()
    held = (
        documents.alias("d")
        .join(candidates.alias("c"), F.expr("d.text_key = c.text_key"))
        .where("slice(d.tokens, c.start + 1, c.len) = c.win")
        .selectExpr(*[f"d.{k}" for k in KEY], "c.start", "c.len", "c.grp")
    )
    rows = documents.selectExpr(*KEY, "cast(null as int) as start", "cast(null as int) as len", "cast(null as string) as grp")
    return rows.unionByName(held)


#: Words covered by sorted (start, len) spans.
COVERED = """aggregate(array_sort(spans), named_struct('n', 0L, 'upto', 0), (a, s) -> named_struct(
    'n', a.n + greatest(0, s.start + s.len - greatest(a.upto, s.start)), 'upto', greatest(a.upto, s.start + s.len)), a -> a.n)"""


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    ratio: int = RATIO,
    broadcast_windows: int = BROADCAST_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Word hits, items and verdict for every row of ``documents``."""
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        row_key(F.col(id_col), F.col(text_col)).alias("text_key"),
        F.concat(F.array(F.lit(None).cast("string")), word_array(F.col(text_col))).alias("tokens"),
    ).withColumn("n_words", F.size("tokens").cast("long") - 1)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text")).alias("words"))
    windows, members = windows_of(items, window)
    size = windows.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.array_join("win", " ")))).first()
    small = size[0] <= broadcast_windows and (size[1] or 0) <= BROADCAST_BYTES
    anchors = frozen(anchored(windows, docs, small), "anchors")
    # a document's spans and groups are bounded by its own length
    per_text = frozen(
        matches(docs, anchors, small)
        .groupBy(*KEY)
        .agg(
            F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "len"))).alias("spans"),
            F.collect_set("grp").alias("groups"),
            F.count_if(F.col("start").isNull()).alias("copies"),
        )
        .withColumn("n_hit", F.expr(COVERED))
        .drop("spans"),
        "hits",
    )
    item_ids = (
        per_text.select("text_key", F.explode("groups").alias("grp"))
        .join(members, "grp")
        .groupBy("text_key")
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    )
    hit = F.col("n_hit")
    return (
        per_text.join(item_ids, "text_key", "left")
        .withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
        .withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("item_ids").cast("long").alias("n_items"),
            F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
            ((hit > 0) & (ratio * hit >= F.col("n_words"))).alias("contaminated"),
            "text_key",
        )
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that are not contaminated."""
    hit = decontaminate(documents, benchmark, id_col=id_col, text_col=text_col).where("contaminated")
    keys = hit.select(F.col("text_key").alias("__llm_key")).distinct()
    return documents.join(keys, row_key(F.col(id_col), F.col(text_col)) == F.col("__llm_key"), "left_anti")
