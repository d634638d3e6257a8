"""Small tables that hold what operators must bear: nulls, empty and long
texts, repeated rows, ties, extra columns whose names clash with results."""

from __future__ import annotations

import random

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(30_000))
ENGLISH = "the cat and the dog went with the children to the river and then to the house of their mother in the evening"
FRENCH = "le chat et le chien sont allés avec les enfants à la rivière et puis à la maison de leur mère dans la soirée"
ODD = [
    None,
    "",
    " \n\t \x0b\x0c\r ",
    "a",
    "Ünïcode 東京 naïve space KK İstanbul ΣΟΦΟΣ égalité \U0001f600\U0001f600",
    "it's we'll I'd they've don't 'll ''s <|endoftext|>x<|startoftext|> <|ENDOFTEXT|>",
    "!!!??? ### $$$ 12345 6.7.8 a1b2 \x1c\x1f\x00\x7f",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa abababababababababab",
    "same line\nsame line\n\nsame line\nother",
    LONG,
]


def words(rng: random.Random, n: int) -> list[str]:
    return [f"{rng.choice('bcdfghklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(40)}" for _ in range(n)]


def documents(seed: int = 5) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, score, kept, class, words, shard)"""
    rng = random.Random(seed)
    texts = list(ODD)
    for base in range(6):
        body = words(rng, 120)
        texts.append(" ".join(body))
        near = list(body)
        near[60] = "changed"
        texts.append(" ".join(near))
        far = [w if i % 4 else "zzz" for i, w in enumerate(body)]
        texts.append(" ".join(far))
        texts += [" ".join(body)] * 2
    texts += [ENGLISH] * 3 + [FRENCH] * 3
    for k in range(12):
        texts.append(f"{ENGLISH} {' '.join(ENGLISH.split()[k:])}")
        texts.append(f"{FRENCH} {' '.join(FRENCH.split()[k:])}")
    rows = []
    for i, t in enumerate(texts):
        lang = None if i % 11 == 3 else "fr" if t and "chien" in t else "en"
        rows.append((i, t, lang, None if i % 7 == 0 else f"h{i % 3}", None if t is None else len(t), float(i), i % 2 == 0, "x", [1], -i))
    rows.append(rows[12])  # a repeated row
    rows.append((None, texts[14], None, None, None, None, None, None, None, None))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, class string, words array<int>, shard int"


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
