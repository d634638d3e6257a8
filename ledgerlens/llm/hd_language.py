"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds its
letters' vectors, permuted by place (a cyclic shift), by multiplication. A
text's vector bundles (adds) those of its n-grams, a language's prototype
bundles its training texts, and a text takes the language whose prototype has
the highest cosine. Bundling is linear, so training counts n-grams by language
in each task and adds one vector per language and task.

Letters are Unicode letters in lower case; every other run is one space, and
a text begins and ends with one.

Cases: ``und`` with score 0 if a text is null, empty or has no letter, or if
nothing was learned; null languages are not learned from; equal cosines go to
the language that sorts first; long texts are read whole; repeated rows repeat;
an empty table gives an empty result; only id, text and language columns are
read, and the language only to learn.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_bucket

DIMENSIONS = 1024
GRAM = 3
SEED = 20_24
FOLDS, HELD_OUT = 4, 2
KEPT_GRAMS = 16_000  # n-gram vectors that a worker keeps (4 * DIMENSIONS bytes each)
MAX_LANGUAGES = 10_000  # prototypes go to every task; more than this is an error
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class Grams:
    """n-gram vectors, made when first met."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letter = letters()
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.vectors = np.empty((KEPT_GRAMS, dimensions), np.float32)

    def letter_vector(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, self.dimensions, np.int8)
            self.letters[code] = bits * np.int8(2) - np.int8(1)
        return self.letters[code]

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct n-grams as numbers, and their counts; None without a letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        letter = self.letter[codes]
        if not letter.any():
            return None
        codes = np.where(letter, codes, 32)
        codes = np.concatenate(([32], codes, [32]))
        codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
        grams = np.zeros(len(codes) - GRAM + 1, np.int64)
        for k in range(GRAM):
            grams = (grams << 21) | codes[k : len(codes) - GRAM + 1 + k]
        return np.unique(grams, return_counts=True)

    def matrix(self, grams: list[int]) -> np.ndarray:
        """One row for each n-gram; at most KEPT_GRAMS at a time."""
        new = [g for g in grams if g not in self.place]
        if len(self.place) + len(new) > KEPT_GRAMS:
            self.place.clear()
            self.letters.clear()
            new = grams
        for g in new:
            vector = np.ones(self.dimensions, np.int8)
            for k in range(GRAM):
                vector = vector * np.roll(self.letter_vector((g >> (21 * (GRAM - 1 - k))) & 0x1FFFFF), GRAM - 1 - k)
            self.vectors[len(self.place)] = vector
            self.place[g] = len(self.place)
        return self.vectors[[self.place[g] for g in grams]]

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dimensions, np.float64)
        step = 4096
        for i in range(0, len(grams), step):
            out += counts[i : i + step].astype(np.float32) @ self.matrix(grams[i : i + step].tolist())
        return out


def prototypes(training: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language -> bundled vector, from rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(dimensions)
        sums: dict[str, np.ndarray] = {}
        held: dict[str, dict[int, int]] = {}

        def settle(lang: str) -> None:
            counted = held.pop(lang)
            numbers = np.fromiter(counted.keys(), np.int64, len(counted))
            amounts = np.fromiter(counted.values(), np.int64, len(counted))
            sums[lang] = sums.get(lang, 0) + np.rint(grams.bundle(numbers, amounts)).astype(np.int64)

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["t"].to_pylist()):
                if found := grams.count(text):
                    counted = held.setdefault(lang, {})
                    for g, c in zip(found[0].tolist(), found[1].tolist()):
                        counted[g] = counted.get(g, 0) + c
                    if len(counted) > KEPT_GRAMS or max(found[1]) > 1 << 20:
                        settle(lang)
            if len(held) > 64:
                for lang in list(held):
                    settle(lang)
        for lang in list(held):
            settle(lang)
        for lang, total in sums.items():
            columns = [pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "amount"])

    parts = training.mapInArrow(run, "lang string, place int, amount long")
    rows = parts.groupBy("lang", "place").agg(F.sum("amount").alias("amount")).groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("place", "amount"))).alias("v")
    )
    found = rows.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["lang"]: np.array([x["amount"] for x in r["v"]], np.float64) for r in found}


def language_column(text: Column, learned: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> Column:
    """struct(lang_pred, score) of a text."""
    names = sorted(learned)
    unit = np.array([learned[n] / max(np.linalg.norm(learned[n]), 1e-12) for n in names]).reshape(len(names), dimensions)

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams(dimensions)
        for batch in batches:
            langs, scores = [], []
            for text in batch.to_pylist():
                found = grams.count(text) if text and names else None
                if found is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                vector = grams.bundle(*found)
                cosine = unit @ vector / max(np.linalg.norm(vector), 1e-12)
                best = int(np.argmax(cosine))
                langs.append(names[best])
                scores.append(float(min(max(cosine[best], 0.0), 1.0)))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict(text)


def held_out_fold(doc_id: Column) -> Column:
    """Of the integer id, so that learning and predicting agree on ids like '007'."""
    return F.coalesce(id_bucket(doc_id.cast("long"), FOLDS) == HELD_OUT, F.lit(False))


def learn(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes from the rows whose id is outside the held-out fold."""
    usable = ~held_out_fold(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    return prototypes(documents.where(usable).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t")))


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row."""
    learned = learn(documents, id_col, text_col, lang_col)
    doc_id = F.col(id_col)
    rows = documents.select(doc_id.cast("long").alias("doc_id"), held_out_fold(doc_id).alias("held_out"), language_column(F.col(text_col), learned).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that take a language: all but those without a
    letter, if anything was learned."""
    learned = learn(documents, text_col=text_col)
    rows = documents.withColumn("__llm_p", language_column(F.col(text_col), learned))
    return rows.where(F.col("__llm_p.lang_pred") != UNKNOWN).drop("__llm_p")
