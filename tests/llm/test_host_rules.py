import re
from collections import Counter

import pytest

from ledgerlens.llm import host_rules
from tests.llm import cases


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {p for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w))


def test_measures_equal_brute_force(docs, empty):
    rows = host_rules.host_rules(docs).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_words) for r in rows)
    assert got == sorted((r[0] is None, r[0] or 0, *brute(r[1])) for r in cases.documents())
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert host_rules.host_rules(empty).count() == 0


@pytest.mark.parametrize("n", [7, 8, 9, 16, 17])
def test_repeated_windows_at_the_edges(n):
    words = [b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h"]
    text = (words * 3)[:n]
    assert host_rules.repeat_words(text) == brute(b" ".join(text).decode())[3]


def test_a_bad_host_loses_its_documents_and_a_small_one_is_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good + f" x{i}", "good") for i in range(200)]
    rows += [(1000 + i, "short", "bad") for i in range(95)] + [(1100 + i, good + f" y{i}", "bad") for i in range(5)]
    rows += [(2000, "short", "tiny"), (2001, good, "tiny"), (2002, "short", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in host_rules.host_rules(df).collect()}
    assert got[0].kept and got[0].host_rate < 0.1
    assert not got[1100].base_failed and not got[1100].kept and got[1100].host_rate > 0.8
    assert got[2001].host_rate < 2 / 3  # towards the mean


def test_prior_of_no_and_of_equal_hosts(spark):
    none = spark.createDataFrame([], "host string, n long, failed long")
    a, b = host_rules.beta_prior(none)
    assert a > 0 and b > 0
    same = spark.createDataFrame([("a", 100, 10), ("b", 100, 10)], "host string, n long, failed long")
    a, b = host_rules.beta_prior(same)
    assert a + b > 1000 and abs(a / (a + b) - 0.1) < 0.01
