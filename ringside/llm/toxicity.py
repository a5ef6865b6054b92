"""7. Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of three rows of a hashed table: of the whole word and of its first three and first five
bytes, so that unseen forms of a known stem still count. Filters of widths 1, 2 and 3 slide over the words, their
largest response in the whole text (max pooling) goes through a logistic layer. Texts are read in runs of words that
overlap by the filter width; no text is cut.

Training uses labels of documents whose fold is not 0, at most about `SAMPLE` rows of each label by a hash of the text
(about `SAMPLE_WORDS` words of training, half for either label, in the order of another hash), half of the gradient steps on either label. One fold is
kept back; all its labelled rows, not a sample, set a threshold per language from exact counts by bin of their score. The
languages are told from text alone, as the nearest of `LANGUAGES` trigram clusters of the sample, since lang may not be an input. A score is the probability moved so
that the threshold of its language lies at 0.5.

Edge cases: null or wordless texts score as the logistic layer's bias without any response. Null labels are not used.
No label, or one value only: every score is the mean label, or 0.5 without labels. Empty table: no rows.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm import frames, words
from ringside.llm.language_id import spherical_kmeans, unit

ROWS_BITS, DIM = 16, 12
WIDTHS, FILTERS = (1, 2, 3), 8
SAMPLE, SAMPLE_WORDS = 1500, 4_000_000
STEPS, BATCH, RATE = 800, 32, 0.02
LANGUAGES, PROFILE = 6, 512
THRESHOLD = 0.5
#: Steps of 0.015 in the logit between which a threshold may lie.
BINS = 4096
#: Words in one run of a long text.
RUN = 1 << 15


def word_rows(array, hasher):
    """(row, int32 matrix words x 3 of table rows) for every text, in order; without words, no rows."""
    shift = np.uint64(64 - ROWS_BITS)
    for first, data, offsets in words.chunks(array, 1 << 19):
        starts, ends, bounds = words.word_bounds(data, offsets, words.ALNUM_WORDS)
        hasher.load(data)
        parts = [hasher.ranges(starts, np.minimum(ends, starts + k)) ^ np.uint64(salt) for k, salt in ((1 << 40, 0), (3, 0x5851F42D), (5, 0x14057B7E))]
        ids = np.stack([(words.mix(p) >> shift).astype(np.int32) for p in parts], axis=1)
        yield first, ids, bounds


class Net:
    def __init__(self, seed=7):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((1 << ROWS_BITS, DIM), np.float32)  # unseen words add nothing
        self.filters = [rng.normal(0, np.sqrt(2 / (w * DIM)), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.full(FILTERS, 0.1, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.float32(0)

    def responses(self, ids, bounds):
        """Largest response of each filter in each text (never below 0), a matrix texts x filters."""
        vectors = self.table[ids[:, 0]] + self.table[ids[:, 1]] + self.table[ids[:, 2]]
        n, texts = len(vectors), len(bounds) - 1
        pooled = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
        for k, w in enumerate(WIDTHS):
            if n < w:
                continue
            r = sum(vectors[j:n - w + 1 + j] @ self.filters[k][j * DIM:(j + 1) * DIM] for j in range(w)) + self.bias[k]
            # A window that reaches into the next text is left out: each text's windows end w - 1 words earlier.
            last = bounds[1:] - (w - 1)
            some = np.flatnonzero(last > bounds[:-1])
            if len(some):
                cuts = np.stack([bounds[:-1][some], np.minimum(last[some], len(r))], axis=1).ravel()
                cuts = cuts[:-1] if cuts[-1] == len(r) else cuts
                pooled[some, k * FILTERS:(k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(r, cuts, axis=0)[::2], 0)
        return pooled

    def probabilities(self, ids, bounds):
        lengths = np.diff(bounds)
        if lengths.max(initial=0) <= 4 * RUN:
            return self._logistic(self.responses(ids, bounds))
        out = np.zeros(len(lengths))
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            best = np.zeros((1, len(WIDTHS) * FILTERS), np.float32)
            for s in range(a, max(b, a + 1), RUN):
                e = min(b, s + RUN + max(WIDTHS) - 1)
                best = np.maximum(best, self.responses(ids[s:e], np.array([0, e - s])))
            out[i] = self._logistic(best)[0]
        return out

    def _logistic(self, pooled):
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -30, 30)))

    def train(self, samples, labels):
        """Adagrad on balanced batches; gradients reach only the windows that were largest."""
        rng = np.random.default_rng(11)
        params = [self.table, *self.filters, *self.bias, self.out]
        seen = [np.full(p.shape, 1e-6, np.float32) for p in params]
        by = [np.flatnonzero(labels == v) for v in (0, 1)]
        for _ in range(STEPS):
            pick = np.concatenate([rng.choice(g, BATCH // 2) for g in by])
            ids = np.concatenate([samples[i] for i in pick])
            bounds = np.concatenate([[0], np.cumsum([len(samples[i]) for i in pick])])
            vectors = self.table[ids].sum(axis=1)
            pooled, at = np.zeros((BATCH, len(WIDTHS) * FILTERS), np.float32), np.full((BATCH, len(WIDTHS) * FILTERS), -1)
            for k, w in enumerate(WIDTHS):
                n = len(vectors) - w + 1
                if n <= 0:
                    continue
                r = sum(vectors[j:n + j] @ self.filters[k][j * DIM:(j + 1) * DIM] for j in range(w)) + self.bias[k]
                for t in range(BATCH):
                    a, b = bounds[t], bounds[t + 1] - w + 1
                    if b > a:
                        top = r[a:b].argmax(axis=0)
                        col = slice(k * FILTERS, (k + 1) * FILTERS)
                        pooled[t, col] = r[a + top, np.arange(FILTERS)]
                        at[t, col] = a + top
            live = (pooled > 0) & (at >= 0)
            pooled = np.where(live, pooled, 0)
            error = (self._logistic(pooled) - labels[pick]).astype(np.float32) / BATCH
            back = np.where(live, error[:, None] * self.out, 0)
            grads = [np.zeros_like(p) for p in params[1:]]
            grads[-1][:] = pooled.T @ error
            self.shift -= np.float32(RATE * error.sum())
            rows, row_grads = [], []
            for k, w in enumerate(WIDTHS):
                col = slice(k * FILTERS, (k + 1) * FILTERS)
                t, f = np.nonzero(live[:, col])
                g, p = back[:, col][t, f], at[:, col][t, f]
                np.add.at(grads[len(WIDTHS) + k], f, g)
                for j in range(w):
                    part = slice(j * DIM, (j + 1) * DIM)
                    np.add.at(grads[k].T, (f, part), g[:, None] * vectors[p + j])
                    rows.append(ids[p + j].ravel())
                    row_grads.append(np.repeat(g[:, None] * self.filters[k][part].T[f], 3, axis=0))
            rows, row_grads = np.concatenate(rows), np.concatenate(row_grads)
            at_rows, where = np.unique(rows, return_inverse=True)
            summed = np.zeros((len(at_rows), DIM), np.float32)
            np.add.at(summed, where, row_grads)
            seen[0][at_rows] += summed**2
            self.table[at_rows] -= RATE * summed / np.sqrt(seen[0][at_rows])
            for p, g, s in zip(params[1:], grads, seen[1:], strict=True):
                s += g * g
                p -= RATE * g / np.sqrt(s)
        return self


def profiles_of(array):
    """Unit trigram profiles of the rows."""
    for _, data, offsets in words.chunks(array):
        low = words.lowered(data)
        yield unit(np.sqrt(np.stack([words.ngram_counts(low[a:b], PROFILE) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])))


def placed(docs: DataFrame, net, centres) -> DataFrame:
    """doc_id, p (probability), tongue (nearest cluster) and bin (of the logit of p) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((net, centres))

    def make():
        hasher = words.Hasher()

        def step(batch):
            array, (model, near) = batch.column("text"), shared.value
            p = np.concatenate([model.probabilities(ids, bounds) for _, ids, bounds in word_rows(array, hasher)]).astype(float)
            tongue = np.concatenate([(v @ near.T).argmax(axis=1) for v in profiles_of(array)])
            q = np.clip(p, 1e-12, 1 - 1e-12)
            at = np.clip((np.log(q / (1 - q)) + 30) / 60 * BINS, 0, BINS - 1).astype(int)
            return batch.column("doc_id"), p, tongue, at

        return step, None

    return frames.emitted(docs.select("doc_id", "text"), make, "doc_id long, p double, tongue int, bin int")


def _counts(docs, marks, net, centres):
    """(tongue, bin, rows labelled 0, rows labelled 1, smallest p, largest p) over all labelled rows, in the order of p."""
    rows = placed(docs, net, centres).join(marks, "doc_id").groupBy("tongue", "bin").agg(
        F.count_if(F.col("_y") <= 0), F.count_if(F.col("_y") > 0), F.min("p"), F.max("p"))
    return np.array(sorted(tuple(r) for r in rows.collect()), float).reshape(-1, 6)  # at most LANGUAGES * BINS rows


def _best_cut(steps):
    """The threshold between two bins with most balanced hits, in the middle of the gap it lies in.

    A row of `steps` is a bin: rows labelled 0, rows labelled 1, smallest p, largest p; in the order of p.
    """
    if len(steps) < 2:
        return 0.5
    zeros, ones, low, high = steps.T
    good = np.cumsum(zeros)[:-1] / max(1, zeros.sum()) + (ones.sum() - np.cumsum(ones)[:-1]) / max(1, ones.sum())
    best = np.flatnonzero(good == good.max())
    wide = best[np.argmax(low[best + 1] - high[best])]
    return float(np.clip((high[wide] + low[wide + 1]) / 2, 0.02, 0.98))


def _merged(counts):
    """The bins of all clusters as one list of steps."""
    out = []
    for at in np.unique(counts[:, 1]):
        rows = counts[counts[:, 1] == at]
        out.append([rows[:, 2].sum(), rows[:, 3].sum(), rows[:, 4].min(), rows[:, 5].max()])
    return np.array(out).reshape(-1, 4)


def fit(docs: DataFrame, labels: DataFrame, label="toxic"):
    marks = labels.filter(F.col(label).isNotNull() & ~frames.held_out()).select("doc_id", F.col(label).cast("int").alias("_y"))
    per = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}
    if not per:
        return 0.5
    if not all(per.get(v) for v in (0, 1)):
        return float(next(v for v in per if per[v]) > 0)
    share = F.when(F.col("_y") == 1, min(1.0, SAMPLE / per[1])).otherwise(min(1.0, SAMPLE / per[0]))
    drawn = (F.xxhash64("doc_id", F.lit(7)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) < share
    chosen = marks.filter(drawn)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about 2 * SAMPLE rows at most

    def make():
        hasher = words.Hasher()

        def step(batch):
            array, out = batch.column("text"), []
            for _, ids, bounds in word_rows(array, hasher):
                out += [ids[a:b].astype(np.uint16).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            like = np.concatenate(list(profiles_of(array)))
            return batch.column("doc_id"), batch.column("_y"), out, [v.astype(np.float16).tobytes() for v in like]

        return step, None

    drawn = frames.emitted(texts, make, "doc_id long, y int, words binary, profile binary").withColumn("fold", frames.fold())
    # Each label has its share of the word budget, filled in the order of a hash of the id; the text that passes it is the last.
    upto = Window.partitionBy("y").orderBy(F.xxhash64("doc_id", F.lit(11)), "words").rowsBetween(Window.unboundedPreceding, -1)  # about SAMPLE rows
    spent = F.coalesce(F.sum(F.length("words") / 6).over(upto), F.lit(0.0))
    keep = drawn.withColumn("spent", spent).filter(F.col("spent") < SAMPLE_WORDS / 2).drop("spent").collect()
    keep.sort(key=lambda r: (len(r["words"]), bytes(r["words"]), r["y"]))
    y = np.array([r["y"] > 0 for r in keep], float)
    samples = [np.frombuffer(r["words"], np.uint16).reshape(-1, 3).astype(np.int32) for r in keep]
    check = np.array([r["fold"] == frames.FOLDS - 1 for r in keep])
    part = ~check if all((y[~check] == v).any() for v in (0, 1)) else np.ones(len(keep), bool)
    if not all((y[part] == v).any() for v in (0, 1)):
        return float(y.mean())
    net = Net().train([s for s, k in zip(samples, part, strict=True) if k], y[part])
    like = np.stack([np.frombuffer(r["profile"], np.float16) for r in keep]).astype(np.float32)
    centres = spherical_kmeans(like, LANGUAGES, np.random.default_rng(7))
    # Thresholds come from every labelled row of the fold that was kept back.
    last = frames.fold() == frames.FOLDS - 1
    counts = _counts(docs.filter(last), marks.filter(last), net, centres)
    if not all(counts[:, k].sum() for k in (2, 3)):
        counts = _counts(docs.filter(~frames.held_out()), marks, net, centres)
    cuts = np.full(len(centres), _best_cut(_merged(counts)))
    for g in range(len(centres)):
        mine = counts[counts[:, 0] == g]
        if min(mine[:, 2].sum(), mine[:, 3].sum()) >= 10:
            cuts[g] = _best_cut(mine[:, 2:])
    return {"net": net, "centres": centres, "cuts": cuts}


def scores(array, model, hasher):
    if not isinstance(model, dict):
        return np.full(len(array), float(model))
    p = [model["net"].probabilities(ids, bounds) for _, ids, bounds in word_rows(array, hasher)]
    tongue = [(v @ model["centres"].T).argmax(axis=1) for v in profiles_of(array)]
    if not p:
        return np.zeros(0)
    p, cut = np.concatenate(p).astype(float), model["cuts"][np.concatenate(tongue)]
    return np.clip(np.where(p < cut, 0.5 * p / cut, 0.5 + 0.5 * (p - cut) / (1 - cut)), 0, 1)


def scored(docs: DataFrame, model) -> DataFrame:
    """`docs` with _score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        hasher = words.Hasher()
        return lambda batch: [scores(batch.column(batch.schema.get_field_index("text")), shared.value, hasher)]

    return frames.added(docs, make, {"_score": "double"})


def op7_toxicity(spark, sf_dir):
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, frames.table(spark, sf_dir, "labels")))
    return out.select("doc_id", frames.held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
