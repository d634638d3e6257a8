"""Middle values by counting, against sorted lists."""

import random

import pytest

from ledgerlens.operators import evidence


def middles(values):
    v = sorted(x for x in values if x is not None)
    return v[(len(v) - 1) // 2], v[len(v) // 2]


def test_buckets_partition_the_numbers():
    edges = [s * ((1 << k) + d) for k in range(60) for d in (-1, 0, 1) for s in (1, -1)]
    for v in edges:
        size = evidence.bucket_width(abs(v))
        bucket = v - (abs(v) % size) * (1 if v >= 0 else -1)
        lo, hi = evidence.interval_of(bucket)
        assert lo <= v < hi and hi - lo == size


def test_middle_values(spark):
    rng = random.Random(5)
    groups = {
        1: [rng.randrange(0, 1 << 22) for _ in range(501)],
        2: [rng.randrange(-(1 << 40), 1 << 40) for _ in range(400)],
        3: [7] * 300 + [8] * 300,  # two values in the middle
        4: [-5],
        5: [10**17 + rng.randrange(1 << 45) for _ in range(64)] + [None] * 3,
        6: [-(1 << 30) - rng.randrange(1 << 20) for _ in range(33)],
        7: [1 << 20, 1 << 40],  # buckets far apart
        8: [None, None],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k int, v long").repartition(5)
    got = evidence.middle_values(rows, "k", "v")
    assert got == {k: middles(vs) for k, vs in groups.items() if any(v is not None for v in vs)}


def test_no_rows(spark):
    assert evidence.middle_values(spark.createDataFrame([], "k int, v long"), "k", "v") == {}


@pytest.mark.parametrize("top, passes", [(1 << 24, 2), (1 << 40, 3)])
def test_passes(spark, monkeypatch, top, passes):
    rng = random.Random(top)
    values = [rng.randrange(top // 2, top) for _ in range(999)]
    rows = spark.createDataFrame([(1, v) for v in values], "k int, v long")
    seen = []
    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: seen.append(1) or collect(self))
    assert evidence.middle_values(rows, "k", "v")[1] == middles(values)
    assert len(seen) <= passes
