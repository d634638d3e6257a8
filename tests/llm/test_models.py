import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import gated_lm, hd_language, rule_ensemble
from ledgerlens.llm.common import read_table
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# ---- language


def test_language_of_held_out_documents(spark):
    docs = read_table(spark, SF, "documents")
    rows = hd_language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_documents(docs, empty):
    rows = hd_language.identify(docs).collect()
    texts = [r[1] for r in cases.documents()]
    blank = sum(not any(c.isalpha() for c in t or "") for t in texts)
    assert len(rows) == len(texts) and sum(r.lang_pred == "und" for r in rows) == blank
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert hd_language.identify(empty).count() == 0
    # nothing to learn from
    unknown = hd_language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}
    kept = hd_language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts) - blank


def test_vectors_bind_and_bundle():
    grams = hd_language.Grams(256)
    numbers, counts = grams.count("abab")
    vector = grams.bundle(numbers, counts)
    assert counts.sum() == 4  # " ab", "aba", "bab", "ab "
    one = grams.matrix([numbers[0]])[0]
    assert set(np.unique(one)) == {-1.0, 1.0} and vector.shape == (256,)
    assert grams.count("12 ...") is None


# ---- quality


def test_quality_of_held_out_documents(spark):
    rows = rule_ensemble.classify(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"))
    rows = rows.join(read_table(spark, SF, "labels").select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in held) > 0.95 * len(held)


def test_compiled_rules_equal_the_rules(spark):
    rng = np.random.default_rng(1)
    x = rng.random((800, len(rule_ensemble.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.4) | (x[:, 5] > 0.9)).astype(float)
    model = rule_ensemble.fit(x, y)
    assert 0 < len(model.rules) < len(rule_ensemble.grow_paths(x, y))
    by_hand = 1 / (1 + np.exp(-(model.bias + sum(w * rule_ensemble.holds(r, x) for r, w in zip(model.rules, model.weights)))))
    assert ((by_hand > 0.5) == (y > 0)).mean() > 0.97
    df = spark.createDataFrame([(i, tuple(map(float, v))) for i, v in enumerate(x)], "i int, s struct<" + ", ".join(f"{s}: double" for s in rule_ensemble.STATISTICS) + ">")
    got = {r.i: r.score for r in df.select("i", model.score_column("s").alias("score")).collect()}
    assert np.allclose([got[i] for i in range(800)], by_hand)


def test_quality_of_odd_documents(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1), (3, None), (4, 0)], "doc_id long, quality int")
    n = len(cases.documents())
    for given in (none, labels, labels.where("quality = 1")):
        rows = rule_ensemble.classify(docs, given).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    assert rule_ensemble.classify(empty, labels).count() == 0
    kept = rule_ensemble.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in rule_ensemble.classify(docs, labels).collect())


# ---- language model


def scored(spark, rows):
    return gated_lm.score(spark.createDataFrame(rows, cases.SCHEMA), share=1).collect()


def test_base_score_equals_brute_force(spark, docs, empty):
    rows = gated_lm.score(docs, share=1).collect()
    given = cases.documents()
    words = [[*(t or "").encode().lower().split(), b""] for t in (r[1] for r in given)]
    held = [r[0] is not None and fold(r[0], 7) == 2 for r in given]
    counts = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (r[0] is None, r[0] or 0, h, len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), 4))
        for r, ws, h in zip(given, words, held)
    )
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)
    assert got == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert gated_lm.score(empty).count() == 0


def test_words_beyond_the_list_meet_their_counts_in_a_join(spark, docs, monkeypatch):
    whole = {(r.doc_id, r.n_tokens): (r.base_score, r.n_known) for r in gated_lm.score(docs, share=1).collect()}
    lexicon = gated_lm.lexicon
    monkeypatch.setattr(gated_lm, "lexicon", lambda counts: lexicon(counts, 20, 50))
    few = {(r.doc_id, r.n_tokens): (r.base_score, r.n_known) for r in gated_lm.score(docs, share=1).collect()}
    assert whole.keys() == few.keys()
    assert all(abs(whole[k][0] - few[k][0]) < 1e-6 * abs(whole[k][0]) and whole[k][1] == few[k][1] for k in whole)


@pytest.fixture(scope="module")
def network():
    mass = np.array([900.0, 500, 300, *([40] * 30), *([3] * 100)])
    return gated_lm.Network(mass), mass


def test_symbol_probabilities_sum_to_one(network):
    net, mass = network
    h = np.random.default_rng(0).normal(size=(3, net.hidden)).astype(np.float32)
    total = sum(np.exp(net.output(h, np.full(3, s))[0]) for s in range(len(mass)))
    assert np.allclose(total, 1, atol=1e-4)
    assert (np.diff(net.bounds) <= gated_lm.CLASS_SIZE).all()


def test_gradients_equal_differences(network):
    _, mass = network
    net = gated_lm.Network(mass, 5)
    for n in net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    rng = np.random.default_rng(2)
    given, target = rng.integers(0, len(mass), (2, 4, 3))
    keep = np.ones((4, 3))
    keep[2, 1] = 0
    state = rng.normal(size=(3, 5))

    def loss():
        s = net.forward(given, keep, state)
        return -net.output(s.reshape(-1, 5).astype(np.float64), target.ravel())[0].sum()

    trace, grads = [], {}
    s = net.forward(given, keep, state, trace)
    _, dh = net.output(s.reshape(-1, 5).astype(np.float64), target.ravel(), grads)
    net.backward(given, keep, trace, dh.reshape(4, 3, 5), grads)
    rows, gx = grads["x"]
    dense = np.zeros_like(net.x)
    dense[rows] = gx
    for name, at in (("u", (1, 7)), ("u", (0, 2)), ("x", (int(given[1, 0]), 3)), ("c", (0, 1)), ("w", (int(target[0, 0]), 2)), ("x", (int(given[0, 2]), 12))):
        p = getattr(net, name)
        g = (dense if name == "x" else grads[name])[at]
        old = p[at]
        eps = 1e-2
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * eps) - g) < 1e-2 * max(1, abs(g)), (name, at)


def test_state_is_carried_and_lanes_do_not_matter(network, monkeypatch):
    net, mass = network
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, len(mass), n).astype(np.int32) for n in (1, 100, 7, 250, 33, 64)]
    whole = gated_lm.run_lanes(net, docs, 0)
    monkeypatch.setattr(gated_lm, "LANES", 2)
    monkeypatch.setattr(gated_lm, "WINDOW", 7)
    assert np.allclose(whole, gated_lm.run_lanes(net, docs, 0), rtol=1e-4)
    assert np.allclose(whole[3], gated_lm.run_lanes(net, [docs[3]], 0)[0], rtol=1e-4)


def test_training_beats_counts_on_held_out_documents(spark):
    rows = gated_lm.score(read_table(spark, SF, "documents")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows["s"] > rows["b"]


def plain_log10(net, lex, counts, text):
    """log10 probability of a text, one token after the other, from the formulas."""
    n, state, before, total = net.hidden, np.zeros(net.hidden), lex.end, 0.0
    listed = {w: lex.symbol[i] for w, i in lex.listed.items()}
    bucket_words = Counter()
    bucket_tokens = Counter()
    for w, c in counts.items():
        s = lex.end if w == b"" else listed.get(w, lex.rest_symbol[gated_lm.rest_bucket(w)])
        bucket_words[int(s)] += 1
        bucket_tokens[int(s)] += c
    for w in [*text.encode().lower().split(), b""]:
        g, hu = net.x[before].astype(float), state @ net.u
        z, r = (1 / (1 + np.exp(-(g[k * n : k * n + n] + hu[k * n : k * n + n]))) for k in (0, 1))
        new = np.tanh(g[2 * n :] + r * hu[2 * n :])
        state = z * state + (1 - z) * new
        s = int(lex.end if w == b"" else listed.get(w, lex.rest_symbol[gated_lm.rest_bucket(w)]))
        of = int(net.class_of[s])
        classes = np.exp(net.c @ state + net.cb)
        lo, hi = net.bounds[of], net.bounds[of + 1]
        within = np.exp(net.w[lo:hi] @ state + net.wb[lo:hi])
        total += math.log10(classes[of] / classes.sum()) + math.log10(within[s - lo] / within.sum())
        if lex.is_rest[s]:
            total += math.log10((counts.get(w, 0) + 1) / (bucket_tokens[s] + bucket_words[s] + 1))
        before = s
    return total


def test_score_equals_a_step_by_step_reference(spark, docs, monkeypatch):
    held, train, lexicon = {}, gated_lm.train, gated_lm.lexicon
    monkeypatch.setattr(gated_lm, "lexicon", lambda counts: held.setdefault("lex", lexicon(counts, 20, 50)))
    monkeypatch.setattr(gated_lm, "train", lambda *a: held.setdefault("weights", train(*a)))
    given = [r for r in cases.documents() if r[1] != cases.LONG and r[0] is not None]
    got = {r.doc_id: r.score for r in scored(spark, given)}
    counts = Counter(w for r in given if fold(r[0], 7) != 2 for w in [*(r[1] or "").encode().lower().split(), b""])
    lex, net = held["lex"], gated_lm.Network(held["lex"].mass).load(held["weights"])
    assert set(lex.listed) < set(counts) and lex.is_rest[lex.rest_symbol].all()
    for r in given:
        assert got[r[0]] == pytest.approx(plain_log10(net, lex, counts, r[1] or ""), rel=1e-4)


def test_number_of_splits_moves_the_gain_little(spark):
    table = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    gains = []
    for n in (1, 8):
        r = gated_lm.score(table.repartition(n)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
        gains.append((r["s"] - r["b"]) / r["n"])
    assert min(gains) > 0 and abs(gains[0] - gains[1]) < 0.15, gains


def test_every_training_row_trains_the_weights_once(spark, monkeypatch):
    rows = [(i, f"{cases.ENGLISH} {i}") for i in range(60)] + [(i, cases.FRENCH) for i in range(60, 90)] + [(None, "no id")] * 2
    seen, known, train_round = [], {}, gated_lm.train_round
    learned = [t for i, t in rows if i is None or fold(i, 7) != 2]

    def kept(training, lex, *rest):
        known.update({gated_lm.packed(lex.encode(t.encode())[0]): t for t in learned})
        seen.append(Counter(known[bytes(r.symbols)] for r in training.collect()))
        return train_round(training, lex, *rest)

    monkeypatch.setattr(gated_lm, "train_round", kept)
    gated_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert len(known) == len(set(learned))
    assert sum(seen, Counter()) == Counter(learned)
    assert all(c[cases.FRENCH] for c in seen)  # copies under other ids are in every round


def small_lexicon(listed):
    symbol = np.array([2, 0, 4], np.int32)  # the third is of the first bucket
    mass = np.ones(6 + gated_lm.REST)
    is_rest = np.arange(len(mass)) > 3
    rest = np.flatnonzero(is_rest)[: gated_lm.REST].astype(np.int32)
    return gated_lm.Lexicon(listed, symbol, np.log10([9.0, 5.0, 3.0]), is_rest, rest, np.where(is_rest, 0.5, 0.0), mass, 1, 7, 100, 40)


class Asked(dict):
    """Notes what is looked up."""

    def __init__(self, *given):
        super().__init__(*given)
        self.asked = []

    def get(self, *given):
        self.asked.append(given[0])
        return super().get(*given)


def test_a_word_is_looked_up_once_for_the_texts_of_a_batch():
    words = Asked({b"a": 0, b"b": 1, b"c": 2})
    small_lexicon(words).encode(b"a B x " * 500)
    assert sorted(w for w in words.asked if w) == [b"a", b"b", b"x"]


def test_texts_encoded_together_equal_texts_word_by_word(monkeypatch):
    lex = small_lexicon({b"a": 0, b"b": 1, b"c": 2})
    texts = [b"", b" \t\x0b ", b" A b\r\nzz a  C\x1cd c ", "É a é\x85 b\u00a0c".encode(), b"\xff\xfe a", b"zz zz y c", b"a"]
    symbols, sizes, base, extra, known, (owner, words, counts) = lex.encode_all(texts)
    rare = Counter(dict(zip(zip(owner.tolist(), words.to_pylist()), counts.tolist())))
    at = 0
    for i, text in enumerate(texts):
        given = text.lower().split()
        places = [lex.listed.get(w) for w in given]
        want = [lex.rest_symbol[gated_lm.rest_bucket(w)] if p is None else lex.symbol[p] for w, p in zip(given, places)]
        assert symbols[at : at + sizes[i]].tolist() == [*want, lex.end]
        at += sizes[i]
        logs = [0 if p is None else lex.log_count[p] for p in places]
        assert base[i] == pytest.approx(sum(logs) + math.log10(8) - (len(given) + 1) * math.log10(141))
        assert extra[i] == pytest.approx(sum(x * lex.is_rest[s] - lex.log_rest[s] for x, s in zip(logs, want)), abs=1e-9)
        assert known[i] == 1 + sum(p is not None for p in places)
        assert {w: n for (j, w), n in rare.items() if j == i} == Counter(w for w, p in zip(given, places) if p is None)
    whole = b" ".join(texts)
    one = lex.encode(whole)
    assert whole[5:6].isspace()
    monkeypatch.setattr(gated_lm, "segments", lambda text: iter([text[:5], text[5:]]))
    parts = lex.encode(whole)
    assert one[0].tolist() == parts[0].tolist() and one[3:] == parts[3:]
    assert one[1:3] == pytest.approx(parts[1:3])
