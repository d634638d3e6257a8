"""Packing: concatenate and cut.

Pass 1 tokenises each input split in order, ends every document with an end
id, and writes its ids with their offset inside the split. The token totals of
the splits (one row each) become global offsets by a prefix sum. Pass 2 cuts
the one long stream that these offsets describe into fixed windows; a document
that crosses a boundary gives one boundary record (piece) for each window it
touches. Only the last sequence can have padding.

Cases: null and empty texts are the end id alone; very long texts are encoded
in segments cut at white space and give many pieces; repeated rows are packed
as often as they occur; an empty table gives an empty result; only the id and
text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import frozen, segments
from ledgerlens.llm.tokenizing import CACHE_WORDS, PreTokens, vocabulary_path, words_of

END_ID = 1


def id_type(library) -> str:
    return "<u2" if library.get_vocab_size() < 1 << 16 else "<u4"


class WordIds(dict):
    """Word -> its ids as bytes (two bytes an id where the vocabulary allows
    it), made when first asked for: the library's model gives the ids of each
    pre-token."""

    def __init__(self, path: str):
        super().__init__()
        self.pre = PreTokens(path)
        self.tokenize, self.dtype = self.pre.library.model.tokenize, id_type(self.pre.library)
        self.as_bytes = [np.array([i], self.dtype).tobytes() for i in range(self.pre.library.get_vocab_size())]

    def __missing__(self, word: bytes) -> bytes:
        got = self[word] = b"".join(map(self.of_piece, self.pre(word.decode())))
        return got

    def of_piece(self, piece: str | int) -> bytes:
        if isinstance(piece, int):
            return self.as_bytes[piece]
        # an ASCII piece of a word has the ids that it has as a word
        known = self.get(piece.encode()) if piece.isascii() else None
        return known or b"".join([self.as_bytes[t.id] for t in self.tokenize(piece)])

    def encode(self, text: bytes) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        return b"".join([b"".join(map(self.__getitem__, words_of(part))) for part in segments(text)])


@cache
def kept_ids(path: str) -> WordIds:
    """One for each worker process and vocabulary."""
    return WordIds(path)


def encoded(documents: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """One row per document: its split, its offset there, its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, at, split = kept_ids(path), 0, TaskContext.get().partitionId()
        width, end = np.dtype(kept.dtype).itemsize, np.array([END_ID], kept.dtype).tobytes()
        for batch in batches:
            ids = [kept.encode(t or b"") + end for t in batch["t"].to_pylist()]
            lengths = np.array([len(x) // width for x in ids], np.int64)
            starts = at + np.cumsum(lengths) - lengths
            at += int(lengths.sum())
            arrays = [batch["doc_id"], pa.array([split] * len(ids), pa.int64()), pa.array(starts), pa.array(lengths), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "split", "at", "n", "ids"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, split long, at long, n long, ids binary")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    documents: DataFrame, window: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents; ``with_ids`` adds the piece's ids as an array."""
    from tokenizers import Tokenizer

    path = path or vocabulary_path()
    dtype = id_type(Tokenizer.from_file(path))
    ids = frozen(encoded(documents, path, id_col, text_col), "packing")
    # one row for each input split
    totals = ids.groupBy("split").agg(F.sum("n").alias("total"))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = ids.join(F.broadcast(offsets), "split").select("doc_id", (F.col("base") + F.col("at")).alias("g"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for doc, g, raw in zip(batch["doc_id"].to_pylist(), batch["g"].to_pylist(), batch["ids"].to_pylist()):
                wide = np.frombuffer(raw, dtype).astype("<u4")
                n, start = len(wide), 0
                while start < n:
                    offset = (g + start) % window
                    length = min(window - offset, n - start)
                    piece = wide[start : start + length]
                    row = (doc, start, length, zlib.crc32(piece.tobytes()), n, (g + start) // window, offset)
                    for column, value in zip(columns, (*row, piece.tolist()) if with_ids else row):
                        column.append(value)
                    start += length
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                arrays.append(pa.array(columns[7], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return placed.mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))
