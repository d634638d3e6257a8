import hashlib
import re

from ledgerlens.llm import decontaminate
from tests.llm import cases

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def word_list(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, items, window=13):
    out = []
    for doc_id, text in rows:
        w, hit, found = word_list(text), set(), set()
        for item, body in items:
            b = word_list(body)
            k = min(window, len(b))
            wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
            for i in range(len(w) - k + 1) if k else []:
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((-1 if doc_id is None else doc_id, len(w), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


ITEMS = [
    (1, cases.ENGLISH),
    (10, cases.ENGLISH),  # equal items
    (2, "WORD5 of5 word6; of6 Word7"),  # short, other case
    (3, "a"),
    (4, ""),
    (5, None),
    (6, "same line same line"),
    (7, "the the the the the the the the the the the the the the the"),
    (8, cases.FRENCH.upper()),
    (9, "Ünïcode 東京"),
]


def test_equals_brute_force_by_broadcast_and_by_shuffle(spark, docs, empty):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, words string")
    want = brute([(r[0], r[1]) for r in cases.documents()], ITEMS)
    assert sum(r[5] for r in want) > 5 and sum(r[2] > 0 and not r[5] for r in want) > 0
    assert rows_of(decontaminate.decontaminate(docs, items)) == want
    assert rows_of(decontaminate.decontaminate(docs, items, broadcast_windows=0)) == want
    assert decontaminate.decontaminate(empty, items).count() == 0
    clean = decontaminate.decontaminate(docs, items.limit(0)).collect()
    assert len(clean) == len(want) and not any(r.n_hit for r in clean)


def test_window_in_the_very_first_and_last_place(spark):
    body = [f"w{i}" for i in range(20)]
    rows = [(0, " ".join(body[:13])), (1, "x " + " ".join(body[7:])), (2, " ".join(body[:12])), (3, " ".join(body[:13] * 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(body))], "item_id long, text string")
    assert rows_of(decontaminate.decontaminate(docs, items)) == brute(rows, [(1, " ".join(body))])


def test_one_item_text_repeated_many_times_by_both_joins(spark):
    body = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(body[:30])) for i in range(400)] + [(1000 + i, " ".join(body[i:])) for i in range(20)]
    rows = [(i, f"x{i} " + " ".join(body[i : i + 20])) for i in range(25)] + [(None, " ".join(body)), (None, "other"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert rows_of(decontaminate.decontaminate(docs, table)) == want
    assert rows_of(decontaminate.decontaminate(docs, table, broadcast_windows=0)) == want
    assert "items" not in decontaminate.windows_of(table.selectExpr("cast(item_id as string) as item_id", "split(text, ' ') as words"), 13)[0].columns


def test_keep_clean_of_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([(1, cases.ENGLISH)], "item_id long, text string")
    assert decontaminate.keep_clean(empty, items).count() == 0
    assert decontaminate.keep_clean(docs, items.limit(0)).count() == docs.count()


def test_keep_clean_drops_only_the_contaminated(spark, docs):
    items = spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id long, text string")
    dirty = [r[0] for r in brute([(r[0], r[1]) for r in cases.documents()], ITEMS) if r[5]]
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(
        i for i in (-1 if r[0] is None else r[0] for r in cases.documents()) if i not in dirty
    )
