"""Token counts by rank-synchronous array merging.

Pre-tokens that a worker has not met are held together as one ragged numpy
array of symbols. In each round every sequence finds the lowest merge rank
among its own adjacent pairs (a segmented minimum) and applies that pair at
all its places at once; sequences without a known pair leave the array. What
survives is counted. Texts are split at ASCII white space, the counts of words
are kept, and a text's count is the sum over its words.

Normalising and pre-tokenising of new words use the tokenizer file's own
rules through the library; the merging is done here.

Cases: null and empty texts have 0 tokens; texts of any length are read whole,
in segments cut at white space; repeated rows repeat; an empty table gives an
empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import chunks, segments
from ledgerlens.llm.tokenizing import KeptWords, PreTokens, byte_symbols, vocabulary_path, words_of

NO_RANK = np.int64(1 << 40)


class RaggedMerger:
    """Counts BPE symbols of many pre-tokens at once."""

    def __init__(self, path: str):
        self.pre_tokens = PreTokens(path)
        model = self.pre_tokens.spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.width = len(vocab)
        # symbol ids by code point of the stand-in character: inside, and at the end of a pre-token
        self.inner, self.last = np.zeros(512, np.int64), np.zeros(512, np.int64)
        for c in byte_symbols():
            self.inner[ord(c)], self.last[ord(c)] = vocab[c], vocab[c + end]
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.by_rank = keys[order], order.astype(np.int64), made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def count_words(self, words: list[str]) -> list[int]:
        """Tokens of each white-space word; an added token is one."""
        split = list(map(self.pre_tokens, words))
        owner = np.repeat(np.arange(len(words)), list(map(len, split)))
        pieces = list(chain.from_iterable(split))
        plain = np.array([isinstance(p, str) for p in pieces], bool)
        counts = np.ones(len(pieces), np.int64)
        counts[plain] = self.survivors([p for p in pieces if isinstance(p, str)])
        return np.bincount(owner, weights=counts, minlength=len(words)).astype(np.int64).tolist()

    def survivors(self, tokens: list[str]) -> np.ndarray:
        """Symbols left of each pre-token when no known pair remains."""
        counts = np.zeros(len(tokens), np.int64)
        if not tokens:
            return counts
        lengths = np.array([len(t) for t in tokens], np.int64)
        points = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths) - 1
        symbols = self.inner[points]
        symbols[ends] = self.last[points[ends]]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        first = np.ones(len(symbols), bool)
        first[1:] = owner[1:] != owner[:-1]
        # rank[i] is that of the pair (i, i + 1); none across sequences
        rank = np.full(len(symbols), NO_RANK)
        rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        rank[ends] = NO_RANK
        while len(symbols):
            starts = np.flatnonzero(first)
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            done = least == NO_RANK
            if done.any():
                counts[owner[starts[done]]] = sizes[done]
                live = np.repeat(~done, sizes)
                symbols, owner, first, rank = symbols[live], owner[live], first[live], rank[live]
                least, sizes = least[~done], sizes[~done]
                if not len(symbols):
                    break
            lowest = np.repeat(least, sizes)
            hit = rank == lowest
            # of overlapping places (a run of equal symbols) every other one counts, from the left
            at = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), at, -1))
            hit &= (at - run) % 2 == 0
            symbols[hit] = self.by_rank[lowest[hit]]
            keep = ~np.append(False, hit[:-1])
            merged = hit[keep]
            symbols, owner, first, rank = symbols[keep], owner[keep], first[keep], rank[keep]
            fresh = merged.copy()
            fresh[:-1] |= merged[1:]
            fresh[:-1] &= ~first[1:]
            fresh[-1] = False
            rank[merged] = NO_RANK
            look = np.flatnonzero(fresh)
            rank[look] = self.rank(symbols[look], symbols[look + 1])
        return counts


@cache
def kept_counts(path: str) -> KeptWords:
    """One for each worker process and vocabulary."""
    return KeptWords(RaggedMerger(path).count_words)


def count_texts(texts: list[bytes], kept: KeptWords) -> Iterator[int]:
    for some in chunks(texts):
        if len(some) == 1:
            n = 0
            for part in segments(some[0]):
                words = words_of(part)
                kept.learn(set(words))
                n += sum(map(kept.__getitem__, words))
            yield n
        else:
            split = list(map(words_of, some))
            kept.learn(set(chain.from_iterable(split)))
            for words in split:
                yield sum(map(kept.__getitem__, words))


def token_counts(
    documents: DataFrame, path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = kept_counts(path)
        for batch in batches:
            counts = list(count_texts(batch["t"].to_pylist(), kept))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("t")
    )
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
