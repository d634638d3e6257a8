"""Quality classifier: a sparse rule ensemble.

Texts become a row of statistics. Shallow boosted trees are grown on labelled
rows; every path from a root becomes a rule (a conjunction of comparisons), a
lasso logistic regression gives most rules the weight 0, and the rest is
compiled into one Spark column expression over the statistics.

Learning is the only bounded part: trees and weights are fitted on the
``SAMPLE_ROWS`` labelled training rows whose ids hash lowest (all of them if
there are fewer). Statistics and scores cover every row. Rows of the held-out
fold are never learned from; language, source, id and labels are no inputs.

Cases: null and empty texts have statistics 0 and a score like any other; a
null label or id isn't learned from; several labels of an id are all learned
from; without labelled rows, or with one class only, the score is the smoothed
share of label 1; repeated rows repeat; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import chunks, id_bucket

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, LEARNING_RATE, MIN_LEAF = 24, 3, 32, 0.3, 20
LASSO = 5e-4
STATISTICS = (
    "words",  # log(1 + number of words)
    "word_length",  # bytes a word
    "upper",  # A-Z among ASCII letters
    "symbols",  # of [#*$%&|<>] among bytes
    "marks",  # of ! and ? among bytes
    "digits",  # among bytes
    "distinct",  # distinct words among words
    "again",  # words equal to the one before
    "commonest",  # share of the commonest word
    "dup_lines",  # lines equal to an earlier one
    "line_words",  # log(1 + words a line)
    "stops",  # words that end in . , ; : among words
)
_SPACE = b" \t\n\x0b\x0c\r"
_KEEP = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "symbols": b"#*$%&|<>",
    "marks": b"!?",
    "digits": bytes(range(48, 58)),
}


def statistics(text: bytes) -> tuple[float, ...]:
    words = text.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    size, n = len(text), len(words)
    has = {k: size - len(text.translate(None, v)) for k, v in _KEEP.items()}
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    counts = Counter(words)
    return (
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        has["upper"] / max(1, has["upper"] + has["lower"]),
        has["symbols"] / size,
        has["marks"] / size,
        has["digits"] / size,
        len(counts) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        sum(map(lambda w: w[-1] in b".,;:", words)) / n,
    )


STATISTICS_TYPE = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])


def statistics_column(text: Column) -> Column:
    """The statistics as a struct. Only the text goes to Python; the row's other
    columns stay where they are."""

    @F.arrow_udf(STATISTICS_TYPE)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [statistics(t) for some in chunks(batch.to_pylist()) for t in some]
            table = np.array(rows, np.float64).reshape(len(rows), len(STATISTICS))
            yield pa.StructArray.from_arrays([pa.array(c) for c in table.T], list(STATISTICS))

    return measure(text.cast("binary"))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is above, threshold), ...


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score_column(self, stats: str) -> Column:
        """The whole model as an expression over the statistics in the struct
        column ``stats``."""
        terms = [
            f"if({' and '.join(f'{stats}.{STATISTICS[s]} {">" if above else "<="} {t!r}D' for s, above, t in rule)}, {w!r}D, 0D)"
            for rule, w in zip(self.rules, self.weights)
        ]
        return F.expr(f"1D / (1D + exp(-({' + '.join([f'{self.bias!r}D', *terms])})))")


def grow_paths(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """Rules: the paths to all nodes of trees boosted on the logistic loss."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin, rules = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p) + 1e-9
        level = [((), np.arange(len(y)))]
        for _ in range(depth):
            below = []
            for path, rows in level:
                g, h = grad[rows], hess[rows]
                best = (1e-6, None, None)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g, h, None))
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                    gain[(ns < MIN_LEAF) | (len(rows) - ns < MIN_LEAF)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
                if best[1] is None:
                    margin[rows] += LEARNING_RATE * g.sum() / (h.sum() + 1)
                    continue
                j, cut = best[1], best[2]
                left = binned[rows, j] <= cut
                for above, part in ((False, rows[left]), (True, rows[~left])):
                    longer = path + ((j, above, float(edges[j][cut])),)
                    rules.setdefault(tuple(sorted(longer)))
                    below.append((longer, part))
            level = below
        for _, rows in level:
            margin[rows] += LEARNING_RATE * grad[rows].sum() / (hess[rows].sum() + 1)
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, t in rule:
        out &= (x[:, j] > t) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient; the bias is free."""
    n = len(y)
    a = np.hstack([z, np.ones((n, 1))])
    v = np.ones(a.shape[1])
    for _ in range(12):  # largest eigenvalue, for the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(v @ (a.T @ (a @ v))) / 1.05
    w = np.zeros(a.shape[1])
    w[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    u, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ u, -30, 30)))
        new = u - step * (a.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if len(y) < 2 * MIN_LEAF or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble((), (), float(np.log(share / (1 - share))))
    rules = grow_paths(x, y)
    z = np.stack([holds(r, x) for r in rules], 1).astype(np.float64)
    shift, scale = z.mean(0), np.maximum(z.std(0), 1e-3)
    weights, bias = lasso_logistic((z - shift) / scale, y)
    weights = weights / scale
    kept = np.flatnonzero(weights)
    return Ensemble(tuple(rules[k] for k in kept), tuple(float(weights[k]) for k in kept), bias - float(weights @ shift))


def held_out_fold(doc_id: Column) -> Column:
    return F.coalesce(id_bucket(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def learn(
    documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Ensemble:
    """Fit on the ``sample_rows`` labelled training rows with the lowest id hash."""
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out_fold(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(sample_rows)
    )
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "doc_id")
    # repeated ids can give more rows than labels: the same bound again
    measured = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "label", statistics_column(F.col("t")).alias("s"))
    found = measured.orderBy("h", "doc_id", "label", "s").limit(sample_rows).select("label", "s.*").toPandas()
    x = found[list(STATISTICS)].to_numpy(np.float64).reshape(len(found), len(STATISTICS))
    return fit(x, (found["label"].to_numpy() > 0).astype(np.float64))


def classify(
    documents: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """doc_id, held_out, score, predicted and the statistics for every row."""
    model = learn(documents, labels, sample_rows, id_col, text_col, label_col)
    doc_id = F.col(id_col).cast("long")
    rows = documents.select(doc_id.alias("doc_id"), held_out_fold(doc_id).alias("held_out"), statistics_column(F.col(text_col)).alias("s"))
    scored = rows.withColumn("score", model.score_column("s"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "s.*")


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that are predicted to have label 1."""
    model = learn(documents, labels, text_col=text_col)
    rows = documents.withColumn("__llm_s", statistics_column(F.col(text_col)))
    return rows.where(model.score_column("__llm_s") >= threshold).drop("__llm_s")
