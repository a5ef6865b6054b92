"""3. Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic scores.

`statistics` takes a fixed list of figures from each whole text: sizes, word lengths, shares of letter, capital,
digit and single-sign bytes, repeated words and lines, byte entropy. They are written once and used by every step.
Standardised figures go through `FEATURES` random Fourier features (cosines of Gaussian projections), which approximate
a Gaussian kernel of width `WIDTH`. Every task sums its part of the normal equations; the sums are added by Spark, and
the driver solves a system of fixed size. The last training fold sets an isotonic map from ridge score to probability
over `BINS` equal steps of score.

Training: labels of documents whose fold is not 0. lang, source, doc_id and labels take no part in a score.

Edge cases: null text counts as empty; an empty text has figures like any other and gets a score. Null labels are not
used. Labels that repeat a doc_id count once each. No usable label, or one value only: every score is the mean label, or
0.5 without labels. Empty table: no rows.
"""

from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm import frames, words

FEATURES = 160
WIDTH = 3.0
RIDGE = 1e-3
BINS = 400
THRESHOLD = 0.3
SIGNS = b"!#$%&*+-./:;<=>?@[]_|~,'\"()"
NAMES = 21 + len(SIGNS)


def statistics(text: bytes) -> np.ndarray:
    """Figures of one text, each of moderate size whatever the length."""
    out = np.zeros(NAMES, np.float32)
    n = len(text)
    if not n:
        return out
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float64)
    upper, lower, digit, high = count[65:91].sum(), count[97:123].sum(), count[48:58].sum(), count[128:].sum()
    share = count[count > 0] / n
    w = text.split()
    lines = [x for x in text.split(b"\n") if x]
    k, distinct = len(w), len(set(w))
    sizes = np.fromiter(map(len, w), np.int64, k) if k else np.zeros(1)
    same = sum(map(eq, w, w[1:]))
    pairs = len(set(zip(w, w[1:], strict=False)))
    out[:21] = [
        np.log1p(n) / 4, np.log1p(k) / 3, sizes.mean() / 4, sizes.std() / 4, np.log1p(sizes.max()),
        4 * upper / n, 2 * lower / n, 4 * digit / n, 4 * high / n, upper / (upper + lower + 1),
        -(share * np.log2(share)).sum() / 2, distinct / (k + 1), 2 * np.log1p(k) * distinct / (k + 1) / 5, 3 * same / (k + 1), pairs / (k + 1),
        len(set(lines)) / (len(lines) + 1), np.log1p(len(lines)) / 2, np.log1p(n / (len(lines) + 1)) / 2,
        3 * (n - upper - lower - digit - high - count[32] - count[10]) / n, 3 * (count[32] + count[10]) / n, np.log1p(same),
    ]
    out[21:] = [np.log1p(1000 * count[c] / n) / 3 for c in SIGNS]
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and its figures, as a binary of float32."""

    def make():
        return lambda batch: [[statistics(t).tobytes() for t in words.texts(batch.column(batch.schema.get_field_index("text")))]]

    return frames.added(docs, make, {"_figures": "binary"})


def _figures(column):
    return np.stack([np.frombuffer(x, np.float32) for x in column.to_pylist()]).astype(np.float64) if len(column) else np.zeros((0, NAMES))


def _summed(rows: DataFrame, step) -> np.ndarray:
    """Sum over all rows of step(figures, labels), an array of fixed size: by task, then by position over tasks."""

    def make():
        total = []

        def add(batch):
            part = step(_figures(batch.column("_figures")), np.array(batch.column("_y").to_pylist(), float))
            total[:] = [part if not total else total[0] + part]

        return add, lambda: (np.arange(len(total[0])), total[0]) if total else None

    out = frames.emitted(rows.select("_figures", "_y"), make, "place int, part double").groupBy("place").agg(F.sum("part").alias("part"))
    found = {r["place"]: r["part"] for r in out.collect()}
    return np.array([found[i] for i in range(len(found))])


class Projection:
    def __init__(self, mean, spread):
        rng = np.random.default_rng(3)
        self.mean, self.spread = mean, spread
        self.w = rng.normal(0, 1 / WIDTH, (NAMES, FEATURES))
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x):
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.shift), np.ones((len(x), 1))], axis=1)


def isotonic(low_to_high):
    """Pool adjacent violators over (sum, weight) pairs; the non-decreasing fit for each."""
    blocks = []
    for total, weight in low_to_high:
        blocks.append([total, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + w, blocks[-1][2] + k]
    return np.concatenate([np.full(k, t / w if w else 0.5) for t, w, k in blocks])


def fit(figures: DataFrame, labels: DataFrame, label="quality"):
    """The model from (doc_id, _figures) and (doc_id, label); None or a number if there is nothing to learn."""
    marks = labels.filter(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("_y"))
    train = figures.select("doc_id", "_figures").filter(~frames.held_out()).join(marks, "doc_id")
    train = frames.stored(train.select("_figures", "_y", frames.fold().alias("_fold")), "labelled")
    first = _summed(train, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)]))
    if not len(first) or first[0] == 0:
        return 0.5
    n, positive = first[:2]
    if positive in (0, n):
        return positive / n
    mean = first[2:2 + NAMES] / n
    spread = np.sqrt(np.maximum(first[2 + NAMES:] / n - mean**2, 0)) + 1e-3
    project = Projection(mean, spread)
    upper = np.triu_indices(FEATURES + 1)

    def equations(x, y):
        z = project(x)
        return np.concatenate([(z.T @ z)[upper], z.T @ y])

    held = train.filter(f"_fold = {frames.FOLDS - 1}")
    part = train.filter(f"_fold <> {frames.FOLDS - 1}")
    sums = _summed(part, equations)
    if not len(sums):
        part = held
        sums = _summed(part, equations)
    gram = np.zeros((FEATURES + 1, FEATURES + 1))
    gram[upper] = sums[:len(upper[0])]
    gram += np.triu(gram, 1).T
    weights = np.linalg.solve(gram + RIDGE * n / FEATURES * np.eye(FEATURES + 1), sums[len(upper[0]):])

    def binned(x, y):
        at = np.clip((np.clip(project(x) @ weights, -0.5, 1.5) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    steps = _summed(held, binned)
    if not len(steps):
        steps = _summed(part, binned)
    # Half a neutral label in every step keeps empty steps in order.
    prior = 0.05
    levels = isotonic(zip(steps[:BINS] + prior * np.linspace(0, 1, BINS), steps[BINS:] + prior, strict=True))
    return {"project": project, "weights": weights, "levels": levels}


def probabilities(x, model):
    if not isinstance(model, dict):
        return np.full(len(x), float(model))
    raw = np.clip(model["project"](x) @ model["weights"], -0.5, 1.5)
    at = (raw + 0.5) / 2 * BINS - 0.5
    return np.clip(np.interp(at, np.arange(BINS), model["levels"]), 0, 1)


def scored(measured_docs: DataFrame, model) -> DataFrame:
    shared = measured_docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda batch: [probabilities(_figures(batch.column(batch.schema.get_field_index("_figures"))), shared.value)]

    return frames.added(measured_docs, make, {"_score": "double"}, drop=["_figures"])


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored at the threshold or above, columns as they were."""
    model = fit(frames.stored(measured(docs.select("doc_id", "text")).drop("text"), "figures"), labels)
    return scored(measured(docs), model).filter(F.col("_score") >= THRESHOLD).select(docs.columns)


def op3_quality_classifier(spark, sf_dir):
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    figures = frames.stored(measured(docs).drop("text"), "figures")
    out = scored(figures, fit(figures, frames.table(spark, sf_dir, "labels")))
    return out.select("doc_id", frames.held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
