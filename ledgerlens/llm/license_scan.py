"""Licence scan: a trained paragraph classifier.

Paragraphs are the lines of a text. Features are word unigrams and bigrams that
occur in the families' texts; a lasso keeps few of them. Training paragraphs
are cuts of the families' texts with words lost and added, other sentences with
the same words, and, for the unknown class, ``SAMPLE_LINES`` lines of the
documents themselves (those that hash lowest; the only bounded sample), each
read whole and reduced to the families' n-grams before it is collected. The
unknown class has the logit 0; a part of the training paragraphs is kept back
to fit one temperature and one offset of the unknown class, so that
probabilities mean what they say.

Scanning covers every line of every text, in overlapping windows of ``WINDOW``
words, so that the n-grams of a long line do not add up and every sentence lies
whole in some window: words meet the broadcast features (a few hundred rows) and
weights are summed by window and family. A window whose best family is more
probable than ``THRESHOLD`` is compared with that family's sentences by shared
bigrams; one that holds most of a sentence, or lies mostly inside one, is
confirmed. Where the families together are more probable than that, every
family's sentences are compared place by place too: runs of words with most of
a sentence's bigrams compete for their words, the larger share wins them, and a
family whose run keeps most of its words is confirmed with its probability
against the unknown class alone. A line can so have several families.

Cases: null and empty texts have no paragraph and no licence; equal
probabilities go to the family that sorts first; repeated rows repeat; a null
id stays null; an empty table gives an empty result and the model then knows
the written examples only; only id and text columns are read. DataFrame
functions only; the small model is fitted on the driver.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import frozen
from ledgerlens.llm.license_texts import OTHER, TEMPLATES

FAMILIES = tuple(sorted(TEMPLATES))
SAMPLE_LINES = 3_000
CUTS = 60  # training cuts of each sentence
COMMON = 0.01  # n-grams in more of the unknown lines than this are no features
LASSO, STEPS = 2e-4, 200
THRESHOLD = 0.5
CONFIRMED = 0.6
SEED = 7
LONGEST = max(len(re.findall("[a-z0-9]+", t.lower())) for texts in TEMPLATES.values() for t in texts)
WINDOW = 2 * LONGEST  # words; windows start every LONGEST words


def words_of(line: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", line.lower()) if w]


def words_column(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), "[^a-z0-9]+"), "")


Gram = tuple[str, str]  # (word, next word or "")


def grams_of(words: list[str]) -> set[Gram]:
    return {*((w, "") for w in words), *zip(words, words[1:])}


def training_cuts(rng: random.Random) -> list[tuple[list[str], int]]:
    """(words, family number) of cut and damaged sentences; -1 is unknown."""
    rows = [(words_of(s), -1) for s in OTHER for _ in range(CUTS // 4)]
    every = sorted({w for texts in TEMPLATES.values() for t in texts for w in words_of(t)})
    for number, family in enumerate(FAMILIES):
        for sentence in TEMPLATES[family]:
            whole = words_of(sentence)
            for k in range(CUTS):
                size = len(whole) if k % 3 == 0 else max(min(len(whole), 4), round(len(whole) * rng.uniform(0.6, 1)))
                at = rng.randrange(len(whole) - size + 1)
                cut = [w for w in whole[at : at + size] if len(whole) < 8 or rng.random() > 0.06]
                if k % 4 == 1:
                    cut += rng.choice(OTHER).lower().split()[:3]
                rows.append((cut, number))
    # the families' words out of order, and single words, are unknown
    rows += [(rng.sample(every, rng.randrange(1, 9)), -1) for _ in range(20 * CUTS)]
    return rows


def softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


class Model:
    """Weights by n-gram and family, the unknown class at 0."""

    def __init__(self, lines: list[list[str] | set[Gram]]):
        """From unknown lines, as words or as the families' n-grams in them."""
        rng = random.Random(SEED)
        known = [grams_of(words_of(t)) for texts in TEMPLATES.values() for t in texts]
        rows = training_cuts(rng)
        vocabulary = set().union(*known)
        # a sampled line that holds a family's sentence is no example of the unknown
        plain = [g for g in (x if isinstance(x, set) else grams_of(x) for x in lines) if max(len(g & k) / len(k) for k in known) < 0.5]
        seen: dict[Gram, int] = {}
        for g in plain:
            for x in g & vocabulary:
                seen[x] = seen.get(x, 0) + 1
        self.grams = sorted(g for g in vocabulary if seen.get(g, 0) <= COMMON * max(len(plain), 1))
        place = {g: i for i, g in enumerate(self.grams)}
        bags = [(grams_of(w), y) for w, y in rows] + [(g, -1) for g in plain]
        rng.shuffle(bags)
        x = np.zeros((len(bags), len(place) + 1), np.float32)
        y = np.zeros((len(bags), len(FAMILIES) + 1), np.float32)
        for i, (bag, family) in enumerate(bags):
            x[i, [place[g] for g in bag if g in place]] = 1
            y[i, family] = 1  # -1: the last column
        x[:, -1] = 1
        kept_back = len(bags) // 5
        self.fit(x[kept_back:], y[kept_back:])
        self.calibrate(x[:kept_back], y[:kept_back])

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Lasso by accelerated proximal gradient, the unknown's logit fixed at 0."""
        n, w = len(x), np.zeros((x.shape[1], len(FAMILIES)))
        v = np.ones(x.shape[1])
        for _ in range(20):
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v)
        step = 2 * n / float(v @ (x.T @ (x @ v))) / 1.05
        u, t = w.copy(), 1.0
        for _ in range(STEPS):
            p = softmax(np.hstack([x @ u, np.zeros((n, 1))]))
            new = u - step * (x.T @ (p - y)[:, :-1]) / n
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * LASSO, 0)
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            u, w, t = new + (t - 1) / t_new * (new - w), new, t_new
        self.weights, self.bias = w[:-1], w[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Temperature and offset of the unknown class with the best likelihood
        on paragraphs not trained on."""
        logits = x[:, :-1] @ self.weights + self.bias
        best = (np.inf, 1.0, 0.0)
        for scale in np.geomspace(0.3, 3, 25):
            for offset in np.linspace(-2, 2, 17):
                p = softmax(np.hstack([scale * logits, np.full((len(x), 1), offset)]))
                loss = -np.log(np.maximum((p * y).sum(1), 1e-12)).mean()
                best = min(best, (loss, scale, offset))
        _, scale, self.unknown = best
        self.weights, self.bias = self.weights * scale, self.bias * scale

    def rows(self) -> list[tuple]:
        used = np.flatnonzero(np.abs(self.weights).max(1) > 1e-3)
        return [(*self.grams[i], [float(v) for v in self.weights[i]]) for i in used]


def sample_lines(documents: DataFrame, lines: int) -> list[set[Gram]]:
    """The families' n-grams in the lines with the lowest hashes. Equal lines count once, so that a line
    of many documents doesn't fill the sample; only hashes are shuffled."""
    rows = documents.select(F.explode("lines").alias("line")).where(F.col("line").rlike("[A-Za-z0-9]")).select("line", F.xxhash64("line").alias("h"))
    lowest = rows.select("h").distinct().orderBy("h").limit(lines)
    known = sorted({" ".join(g).strip() for texts in TEMPLATES.values() for t in texts for g in grams_of(words_of(t))})
    ws = words_column(F.col("line"))
    chosen = rows.join(F.broadcast(lowest), "h").select("h", ws.alias("ws"))
    # the word after the last is null and makes a null pair, which no family has
    pairs = F.zip_with("ws", F.slice("ws", 2, F.greatest(F.size("ws"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = F.array_sort(F.array_intersect(F.concat("ws", pairs), F.array(*map(F.lit, known))))
    held = chosen.select("h", grams.alias("grams")).groupBy("h").agg(F.min("grams").alias("grams"))
    return [{(g.partition(" ")[0], g.partition(" ")[2]) for g in r["grams"]} for r in sorted(held.collect(), key=lambda r: r["h"])]


def features(spark: SparkSession, model: Model) -> DataFrame:
    schema = "word string, next string, w array<double>"
    return spark.createDataFrame(model.rows(), schema)


def sentences(spark: SparkSession) -> DataFrame:
    rows = [(k, f, sorted(" ".join(g) for g in grams_of(words_of(t)) if g[1]), len(words_of(t)) - 1) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f]]
    return spark.createDataFrame(rows, "number int, of string, sentence array<string>, places int")


LINE = ["doc_id", "text_key", "line_no"]


def windows(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, at, ws): the words of each window, ``at``
    words from the line's start."""
    lines = documents.select("doc_id", "text_key", F.posexplode("lines").alias("line_no", "line")).withColumn("all", words_column(F.col("line")))
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - LONGEST - 1, F.lit(0)), F.lit(LONGEST))
    return lines.select(*LINE, "all", F.explode(starts).alias("at")).select(*LINE, "at", F.slice("all", F.col("at") + 1, WINDOW).alias("ws"))


def likely_windows(documents: DataFrame, model: Model) -> DataFrame:
    """Windows that are more probably of some family than unknown: best family
    and its probability, each family's against the unknown class, bigrams."""
    spark = documents.sparkSession
    words = windows(documents).select("*", F.posexplode("ws").alias("pos", "word"))
    following = F.coalesce(F.try_element_at("ws", F.col("pos") + 2), F.lit(""))
    hits = (
        words.withColumn("following", following)
        .join(F.broadcast(features(spark, model)), "word")
        .where("next = '' or next = following")
        .groupBy(*LINE, "at")
        # a gram counts once a window, as in training
        .agg(F.first("ws").alias("ws"), F.collect_set(F.struct("word", "next", "w")).alias("grams"))
    )
    sums = [F.expr(f"aggregate(grams, 0D, (a, g) -> a + g.w[{k}])").alias(f"s{k}") for k in range(len(FAMILIES))]
    scored = hits.select(*LINE, "at", "ws", *sums)
    logits = [F.col(f"s{k}") + float(b) for k, b in enumerate(model.bias)]
    unknown = F.lit(float(model.unknown))
    top = F.greatest(*logits, unknown)
    total = sum((F.exp(z - top) for z in logits), F.exp(unknown - top))
    # the best family: highest logit, then the name
    best = F.array_max(F.array(*[F.struct(z.alias("z"), F.lit(-k).alias("k")) for k, z in enumerate(logits)]))
    return (
        scored.withColumn("best", best)
        .where(1 - F.exp(unknown - top) / total > THRESHOLD)
        .select(
            *LINE,
            "at",
            F.element_at(F.array(*map(F.lit, FAMILIES)), 1 - F.col("best.k")).alias("family"),
            (F.exp(F.col("best.z") - top) / total).alias("probability"),
            F.array(*[1 / (1 + F.exp(unknown - z)) for z in logits]).alias("alone"),
            F.when(F.size("ws") > 1, F.zip_with(F.slice("ws", 1, F.size("ws") - 1), F.slice("ws", 2, F.size("ws")), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")).alias("pairs"),
        )
    )


def licence_lines(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_key, line_no, family, probability, confirmed): the best
    families of a line's windows and the other families confirmed in it."""
    likely = frozen(likely_windows(documents, model), "licence-windows").withColumn("distinct", F.array_distinct("pairs"))
    compared = likely.join(F.broadcast(sentences(documents.sparkSession))).withColumn("shared", F.size(F.array_intersect("pairs", "sentence")))
    most = F.col("shared") >= CONFIRMED * F.size("sentence")
    inside = (F.size("distinct") > 2) & (F.col("shared") >= CONFIRMED * F.size("distinct"))
    best = compared.where((F.col("of") == F.col("family")) & (F.col("probability") > THRESHOLD)).select(*LINE, "family", "probability", (most | inside).alias("confirmed"))
    # runs as long as the sentence that hold most of its bigrams
    runs = F.expr(
        """filter(transform(sequence(1, greatest(size(pairs) - places + 1, 1)), i -> struct(at + i as start,
        size(array_intersect(slice(pairs, i, places), sentence)) / size(sentence) as share)), """
        f"r -> r.share >= {CONFIRMED})"
    )
    run = [*LINE, "of", "places", "start"]
    held = (
        compared.where(most)
        .select(*LINE, "of", "places", F.element_at("alone", F.col("number") + 1).alias("alone"), F.inline(runs))
        .groupBy(*run)
        .agg(F.max("share").alias("share"), F.max("alone").alias("alone"))
    )
    placed = held.withColumn("place", F.explode(F.expr("sequence(start, start + places - 1)")))
    winner = F.max(F.struct("share", "places", "of")).over(Window.partitionBy(*LINE, "place"))
    others = (
        placed.withColumn("kept", winner["of"] == F.col("of"))
        .groupBy(*run)
        .agg(F.max("alone").alias("probability"), F.count_if("kept").alias("kept"))
        .where(F.col("kept") >= CONFIRMED * F.col("places"))
        .select(*LINE, F.col("of").alias("family"), "probability", F.lit(True).alias("confirmed"))
    )
    # the best family's probability stands where both find it
    both = best.withColumn("first", F.lit(True)).unionByName(others.withColumn("first", F.lit(False)))
    return both.groupBy(*LINE, "family").agg(
        F.coalesce(F.max(F.when(F.col("first"), F.col("probability"))), F.max("probability")).alias("probability"), F.max("confirmed").alias("confirmed")
    )


def scan(documents: DataFrame, sample: int = SAMPLE_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_licence_lines, families (confirmed, sorted, comma
    joined), family (the most probable confirmed one, or ``unknown`` if lines
    look like a licence but none is confirmed, or ``none``) and probability
    for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.split(text, "\n").alias("lines"))
    model = Model(sample_lines(docs, sample))
    found = licence_lines(docs, model)
    per_doc = found.groupBy("doc_id", "text_key").agg(
        F.size(F.collect_set("line_no")).cast("long").alias("n_licence_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.max(F.when(F.col("confirmed"), F.struct("probability", "family"))).alias("best"),
        F.max("probability").alias("highest"),
    )
    hits = frozen(per_doc, "licences").withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_key", "hit_key")
    blank = F.filter("lines", lambda x: F.trim(x) != "")
    rows = docs.select("doc_id", "text_key", F.size(blank).cast("long").alias("n_lines"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    return rows.join(hits, same, "left").select(
        "doc_id",
        "n_lines",
        F.coalesce("n_licence_lines", F.lit(0)).alias("n_licence_lines"),
        F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("best.family", F.when(F.col("n_licence_lines") > 0, F.lit("unknown")), F.lit("none")).alias("family"),
        F.coalesce("best.probability", "highest", F.lit(0.0)).alias("probability"),
    )
