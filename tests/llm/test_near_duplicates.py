import random

import numpy as np
import pytest

from ledgerlens.llm import bag_minhash as bm
from tests.llm import cases


def brute_classes(rows):
    """Class of each row number: rows without words alone, else components of
    rows with multiset Jaccard of at least 0.8."""
    shingles = bm.Shingles()
    bags = [shingles.bag((r[1] or "").encode()) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(bags[a][0]) and len(bags[b][0]) and bm.alike(bags[a], bags[b]):
                root[find(a)] = find(b)
    return [find(i) for i in range(len(rows))]


def partition(ids, classes):
    groups = {}
    for i, c in zip(ids, classes):
        groups.setdefault(c, []).append(-1 if i is None else i)
    return sorted(map(sorted, groups.values()))


def test_registers_are_unbiased_for_weighted_jaccard():
    a = (np.array([1, 2, 3], np.uint64), np.array([5, 100, 3]))
    b = (np.array([1, 2, 4], np.uint64), np.array([9, 60, 7]))
    reg = bm.signatures([a, b], 8192)
    assert abs((reg[0] == reg[1]).mean() - 65 / 119) < 0.03
    assert np.isfinite(reg).all()
    assert np.isinf(bm.signatures([(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 8)).all()
    # a bag's signature does not depend on the other bags
    assert (bm.signatures([a], 64) == bm.signatures([b, a], 64)[1]).all()


def test_classes_equal_brute_force(docs, empty):
    rows = bm.near_duplicates(docs).collect()
    want = cases.documents()
    assert len(rows) == len(want)
    keys = [(r.class_id, r.class_size) if r.class_size > 1 else (r.text_key, r.doc_id) for r in rows]
    assert partition([r.doc_id for r in rows], keys) == partition([r[0] for r in want], brute_classes(want))
    groups = {}
    for r, k in zip(rows, keys):
        groups.setdefault(k, []).append(r)
    for g in groups.values():
        assert sum(r.kept for r in g) == 1 and g[0].class_size == len(g)
        assert g[0].class_id == min((r.doc_id for r in g if r.doc_id is not None), default=None)
    assert bm.near_duplicates(empty).count() == 0


@pytest.fixture(scope="module")
def crowd():
    """A large group of near copies, some linked only through others, and
    documents that share one long passage without being alike."""
    rng = random.Random(8)
    base = cases.words(rng, 150)
    rows = []
    for _ in range(150):
        body = list(base)
        for _ in range(rng.randrange(1, 5)):
            body[rng.randrange(150)] = f"edit{rng.random()}"
        rows.append(" ".join(body))
    passage = cases.words(rng, 60)
    for _ in range(120):
        rows.append(" ".join(passage + cases.words(rng, 50)))
    return [(i, t) for i, t in enumerate(rows)]


def test_large_groups_keep_their_links(spark, crowd):
    got = bm.near_duplicates(spark.createDataFrame(crowd, "doc_id long, text string")).collect()
    want = brute_classes(crowd)
    mine = {r.doc_id: r.class_id for r in got}
    # no false link, and classes whole
    assert partition(*zip(*sorted(mine.items()))) == partition(range(len(crowd)), want)


def edited_crowd(n):
    """Copies of one text of 120 words, each with 3 edits: just under 0.8."""
    rng = random.Random(11)
    base = cases.words(rng, 120)
    rows = []
    for i in range(n):
        body = list(base)
        for at in rng.sample(range(120), 3):
            body[at] = f"edit{rng.random()}"
        rows.append((i, " ".join(body)))
    return rows


def test_a_crowd_under_the_threshold_has_few_pairs(spark, monkeypatch):
    made = []
    crowd_pairs = bm.crowd_pairs

    def counted(members, texts):
        pairs = bm.frozen(crowd_pairs(members, texts), "t")
        made[-1] += pairs.count()
        return pairs

    monkeypatch.setattr(bm, "crowd_pairs", counted)
    classes = {}
    for n in (600, 2400):
        made.append(0)
        got = bm.near_duplicates(spark.createDataFrame(edited_crowd(n), "doc_id long, text string")).collect()
        classes[n] = partition([r.doc_id for r in got], [r.class_id for r in got])
    assert all(pairs < n / 10 for pairs, n in zip(made, (600, 2400))), made
    assert classes[600] == partition(range(600), brute_classes(edited_crowd(600)))


def brute_links(sets):
    return {(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("seed", range(4))
def test_any_centre_gives_all_links(seed):
    """Pairs by prefixes of differences and those sure to be alike have the same
    components as all similar pairs, for good, bad and empty centres."""
    rng = random.Random(seed)
    base = list(range(100, 160))
    sets = []
    for i in range(90):
        kind = rng.randrange(3)
        s = set(base) if kind else set(rng.sample(range(100, 260), 60))
        for x in rng.sample(sorted(s), rng.randrange(0, 12)):
            s.discard(x)
            if kind == 2:
                s.add(1000 + rng.randrange(400))
        sets.append(s)
    want = components_of(len(sets), brute_links(sets))
    for centre in (set(base), set(), set(range(130, 300)), sets[7]):
        diffs = [np.array(sorted(s ^ centre), np.int64) for s in sets]
        score = [9 * len(d) - len(s) for d, s in zip(diffs, sets)]
        least = min(score)
        uses = np.zeros(1 << bm.SLOT_BITS, np.int64)
        for d in diffs:
            np.add.at(uses, bm.slot(3, d), 1)
        met, links = {}, {(i, score.index(least)) for i, s in enumerate(score) if s + least <= 0}
        for i, d in enumerate(diffs):
            for key in bm.prefix_rows(3, i, i, len(sets[i]), 60.0, least, d, uses)[0].tolist():
                met.setdefault(key, []).append(i)
        pairs = {(a, b) for some in met.values() for a in some for b in some if b < a}
        links |= {(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
        assert components_of(len(sets), links) == want


def components_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return partition(range(n), [find(i) for i in range(n)])


def test_passing_tables_are_dropped(spark, docs):
    import os

    from ledgerlens.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).replace("file:", "")
    before = set(os.listdir(folder))
    assert bm.near_duplicates(docs).count() == docs.count()
    assert sorted(d.split("-")[0] for d in set(os.listdir(folder)) - before) == ["classes", "named"]


def test_long_chain_of_links(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["class"] for r in bm.components(chain).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 501: 500}


def test_one_document_of_each_class_stays(docs):
    want = cases.documents()
    kept = bm.distinct_documents(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert kept.count() == len(set(brute_classes(want)))


def test_counter_table_counts_every_token(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 5, rng.integers(-(2**62), 2**62, int(rng.integers(0, 40))).tolist() + [7]) for k in range(300)] + [(1, [])]
    want = np.zeros(1 << bm.SLOT_BITS, np.int64)
    for crowd, tokens in rows:
        np.add.at(want, bm.slot(crowd, np.array(tokens, np.int64)), 1)
    diffs = spark.createDataFrame(rows, "crowd long, diff array<long>").repartition(7)
    assert (bm.slot_counts(diffs) == want).all()
    assert not bm.slot_counts(diffs.limit(0)).any()
