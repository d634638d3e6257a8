import random

import pytest

from ledgerlens.llm import license_scan
from ledgerlens.llm.license_texts import OTHER, TEMPLATES
from tests.llm import cases


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return license_scan.Model([cases.words(rng, 12) for _ in range(300)] + [cases.ENGLISH.split()] * 5)


@pytest.fixture(scope="module", autouse=True)
def one_model(model):
    """The small model is fitted once for all tests."""
    patch = pytest.MonkeyPatch()
    patch.setattr(license_scan, "Model", lambda lines: model)
    yield
    patch.undo()


def scan(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in license_scan.scan(df).collect()}


def test_every_sentence_is_found_in_its_family(spark):
    texts = [(f, f"{cases.ENGLISH}\n{t.upper()}\nmore") for f, ts in TEMPLATES.items() for t in ts]
    got = scan(spark, [t for _, t in texts])
    right = [got[i].families == f and got[i].family == f and got[i].probability > 0.5 for i, (f, _) in enumerate(texts)]
    assert sum(right) >= len(right) - 1


def test_other_sentences_and_plain_text_have_no_licence(spark):
    got = scan(spark, [*OTHER, cases.ENGLISH, cases.FRENCH, "license", "the rights of all", "public general mit apache"])
    assert not [r for r in got.values() if r.families]


def test_damaged_sentences_are_still_found(spark):
    texts = [
        "licensed under the apache license version 2.0 today",
        "This work is licensed under the GNU General Public License version 3 only",
        "Released under MIT License",
    ]
    got = scan(spark, texts)
    assert [got[i].family for i in range(3)] == ["Apache-2.0", "GPL", "MIT"]


def test_several_licences_and_lines(spark):
    got = scan(spark, ["a\nReleased under the MIT License.\n\n \nLicensed under CC BY-NC 4.0.\nAll rights reserved."])[0]
    assert (got.n_lines, got.n_licence_lines, got.families) == (4, 3, "CC-BY-NC,MIT,reserved")


def test_odd_documents(docs, empty):
    rows = license_scan.scan(docs).collect()
    assert len(rows) == len(cases.documents()) and {r.families for r in rows} == {""}
    assert license_scan.scan(empty).count() == 0
    doubled = license_scan.scan(docs.selectExpr("7L as doc_id", "'All rights reserved.' as text")).collect()
    assert [(r.doc_id, r.families, r.n_licence_lines) for r in doubled] == [(7, "reserved", 1)] * len(rows)


def test_two_licences_in_one_long_line(spark):
    mit, apache = "Released under the MIT License", "licensed under the Apache License, Version 2.0"
    rng = random.Random(3)
    far = " ".join([*cases.words(rng, 300), mit, *cases.words(rng, 300), apache, *cases.words(rng, 300)])
    texts = [f"{mit} and {apache}.", far, "Licensed under CC BY 4.0. Parts are licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0."]
    got = scan(spark, texts)
    assert [got[i].families for i in range(4)] == ["Apache-2.0,MIT", "Apache-2.0,MIT", "CC-BY,CC-BY-NC", "CC-BY-NC"]
    assert {got[i].n_licence_lines for i in range(4)} == {1}


def test_sampled_lines_are_read_whole(spark):
    lines = ["the mit license", " ".join(["zzz"] * 1000 + ["Apache License"]), "zzz 1"]
    got = license_scan.sample_lines(spark.createDataFrame([(lines,)], "lines array<string>"), 10)
    known = set().union(*(license_scan.grams_of(license_scan.words_of(t)) for ts in TEMPLATES.values() for t in ts))
    want = [license_scan.grams_of(license_scan.words_of(x)) & known for x in lines]
    assert sorted(map(sorted, got)) == sorted(map(sorted, want)) and ("apache", "license") in set().union(*got)
