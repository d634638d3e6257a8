"""Periodic runs against the definition, word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerlens.llm import periodic_runs, queries


def all_runs(w):
    """Every run by its definition."""
    n, found = len(w), {}
    number = {}
    ids = np.array([number.setdefault(x, len(number)) for x in w], int)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], ids[:-q] == ids[q:], [0]]).astype(int)
        step = np.diff(same)
        for start, end in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            length = int(end - start) + q
            if length >= max(6, 4 * q):
                found.setdefault((int(start), length), q)  # q grows: the smallest stays
    return sorted(((s, n_, q) for (s, n_), q in found.items()), key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = all_runs(w)
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def words_of(rng, n):
    out = []
    while len(out) < n:
        kind = rng.randrange(4)
        if kind == 0:
            out += [f"r{rng.randrange(99999)}" for _ in range(rng.randrange(1, 9))]
        elif kind == 1:
            out += [rng.choice("ab") for _ in range(rng.randrange(1, 20))]
        else:
            base = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
            out += base * rng.randrange(1, 9) + base[: rng.randrange(len(base))]
    return [x.encode() for x in out[:n]]


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_the_definition(seed):
    rng = random.Random(seed)
    texts = [words_of(rng, rng.randrange(0, 160)) for _ in range(25)] + [[], [b"a"] * 5, [b"a"] * 6, [b"a", b"b"] * 4, [b"x", b"y"] * 3 + [b"x"]]
    for words, got in zip(texts, periodic_runs.find_runs(texts)):
        assert [tuple(map(int, r)) for r in got] == all_runs(words), words


def test_fibonacci_words_and_powers():
    a, b = [b"b"], [b"a"]
    while len(b) < 900:
        a, b = b, b + a
    texts = [b, b * 4, [b"a"] * 3000, ([b"a"] * 7 + [b"b"]) * 40, [str(i).encode() for i in range(50)] * 5]
    for words, got in zip(texts, periodic_runs.find_runs(texts)):
        assert [tuple(map(int, r)) for r in got] == all_runs(words)


def test_splitting_keeps_only_what_can_repeat():
    words = np.array([0, 1, 0, 1, 0, 1, 0, 1, 2, 0, 0, 0, 3, 1, 1, 1, 1, 1, 1])
    at, part = periodic_runs.split_rare(words, np.zeros(len(words), np.int64))
    assert at.tolist() == [*range(8), *range(13, 19)] and part.tolist() == [0] * 8 + [1] * 6


def test_a_long_periodic_text_is_whole():
    unit = [f"w{i}".encode() for i in range(9000)]
    words = [b"head"] + unit * 7 + unit[:17]
    (got,) = periodic_runs.find_runs([words])
    assert got.tolist() == [[1, 63017, 9000]]


@pytest.mark.parametrize("given", ["odd", "sf0.001"])
def test_query_equals_brute_force(spark, docs, tmp_path, given):
    path = str(tmp_path) if given == "odd" else "/root/testdata/sf0.001"
    if given == "odd":
        docs.write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, path).collect()), key=str)
    want = sorted((row(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert got == want and sum(r[1] > 0 for r in want) >= 3


def test_empty_table(empty):
    assert periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(empty))).collect() == []
