import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import packing, token_counts
from ledgerlens.llm.common import chunks, segments
from ledgerlens.llm.tokenizing import PreTokens, vocabulary_path
from tests.llm import cases


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def test_ragged_merging_equals_the_library(library):
    rng = random.Random(3)
    alphabet = "abcdefghiABC'.,!?0129 éßñçüøЖ東京́ \t\n<|>"
    texts = [t or "" for t in cases.ODD[:-1]] + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(1500)]
    got = list(token_counts.count_texts([t.encode() for t in texts], token_counts.kept_counts(vocabulary_path())))
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_overlapping_places_merge_from_the_left(library):
    merger = token_counts.RaggedMerger(vocabulary_path())
    words = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)]
    assert merger.count_words(words) == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert merger.count_words([]) == []


def test_token_counts_of_a_table(docs, empty, library):
    rows = token_counts.token_counts(docs).collect()
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in cases.documents())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows) and any(r.over_limit for r in rows)
    assert token_counts.token_counts(empty).count() == 0


def test_segments_cut_only_at_white_space():
    text = b"aa bb\tcc\n" * 50 + b"x" * 300 + b" y"
    parts = list(segments(text, 40))
    assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()
    assert [len(c) for c in chunks([b"a" * 5, None, b"b" * 9, b"c"], 8)] == [2, 1, 1]


def test_packing_is_an_exact_round_trip(docs, library):
    rows = packing.pack(docs, window=64, with_ids=True).toPandas()
    rows = rows.sort_values(["sequence_id", "offset"])
    # sequences are full but the last, and gapless
    fill = rows.groupby("sequence_id").length.sum()
    assert (fill[:-1] == 64).all() and fill.iloc[-1] <= 64
    assert (rows.sequence_id * 64 + rows.offset == rows.length.cumsum() - rows.length).all()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows.itertuples())
    # the stream, cut at document starts, holds every document once
    stream, starts = np.concatenate(rows.ids.to_list()).tolist(), (rows.sequence_id * 64 + rows.offset)[rows.start == 0].tolist()
    got = sorted(stream[a:b] for a, b in zip(starts, [*starts[1:], None]))
    assert got == sorted(library.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in cases.documents())
    assert (rows[rows.start == 0].doc_tokens == [len(stream[a:b]) for a, b in zip(starts, [*starts[1:], None])]).all()


def test_packing_nothing(empty):
    assert packing.pack(empty).count() == 0


def test_added_tokens_are_exact():
    pre = PreTokens(vocabulary_path())
    assert pre("a<|endoftext|>") == ["a", 49407]
    assert 49407 not in pre("<|ENDOFTEXT|>")
