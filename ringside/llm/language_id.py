"""6. Language identification: nearest of several clustered centroids per language, by cosine of TF-IDF n-grams.

A text's vector counts hashed byte trigrams of the letters of the whole text, lower-cased (`BUCKETS` buckets), damped by 1 + log,
weighted by inverse document frequency over all learning documents and normalised. For each language spherical
k-means on a bounded sample of learning documents gives `CLUSTERS` centroids. A text takes the language of the nearest
centroid. It is rejected when its cosine to it lies below what learning texts of that language and about that length
reach, less a margin (`REJECT_SHARE`, `REJECT_SLACK`), or when it has no letter.

Learning: documents whose fold is not 0 and whose lang is not null. lang, source and doc_id take no part in a
prediction. Document frequencies cover all learning documents; the sample holds about `SAMPLE` documents, shared
equally by languages and chosen by a hash of the text, at a rate by the distinct texts of a language.

Edge cases: null text, or no letter: `und`, score 0, rejected. Fewer than three bytes or no known trigram: the
language with the most learning documents, score 0, not rejected (too short to reject). No learning document at all: every text is
`und`. Empty table: no rows.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm import frames, words

BUCKETS = 4096
CLUSTERS = 3
#: Documents in the clustering sample, all languages together; it bounds what the driver holds (16 KB each).
SAMPLE = 4000
#: A text is rejected below REJECT_SLACK times the cosine that all but REJECT_SHARE of the sample reach at its length.
REJECT_SHARE, REJECT_SLACK = 0.01, 0.5
LENGTH_BINS = 12
UNKNOWN = "und"


def has_letter(text: bytes) -> bool:
    if text.isascii():
        return any(map(bytes.isalpha, (text[i:i + 1] for i in range(min(64, len(text)))))) or any(65 <= c <= 90 or 97 <= c <= 122 for c in text)
    return any(map(str.isalpha, text.decode("utf-8", "ignore")))


def counts_of(array, buckets=BUCKETS):
    """(first row, float32 matrix of 1 + log counts, byte lengths) for runs of rows."""
    for first, data, offsets in words.chunks(array):
        low, offsets = words.letters_only(data, offsets)
        for a in range(0, len(offsets) - 1, 512):
            rows = [words.ngram_counts(low[x:y], buckets) for x, y in zip(offsets[a:a + 512], offsets[a + 1:a + 513])]
            m = np.log1p(np.stack(rows))
            yield first + a, m, np.diff(offsets[a:a + len(rows) + 1])


def unit(m):
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def length_bin(lengths):
    return np.clip(np.log2(np.maximum(lengths, 1)), 0, LENGTH_BINS - 1).astype(int)


def _frequencies(learn: DataFrame):
    """Documents, and documents with each bucket, summed by task and then over tasks (a fixed number of rows)."""

    def make():
        df, n = np.zeros(BUCKETS, np.int64), np.zeros(1, np.int64)

        def step(batch):
            for _, m, lengths in counts_of(batch.column("text")):
                df[:] += (m > 0).sum(axis=0)
                n[:] += len(lengths)

        return step, lambda: (np.arange(-1, BUCKETS), np.concatenate([n, df]))

    rows = frames.emitted(learn.select("text"), make, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        out[r["bucket"] + 1] = r["n"]
    return int(out[0]), out[1:]


def spherical_kmeans(x, k, rng, rounds=12):
    """Centroids of unit rows; a cluster that loses all rows takes the row farthest from its centroid."""
    k = min(k, len(x))
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        c = np.vstack([c, x[[int(np.argmin((x @ c.T).max(axis=1)))]]])
    for _ in range(rounds):
        near = x @ c.T
        own = near.argmax(axis=1)
        c = unit(np.stack([x[own == j].sum(axis=0) if (own == j).any() else x[int(np.argmin(near.max(axis=1)))] for j in range(k)]))
    return c


def fit(docs: DataFrame):
    """The model, from doc_id, text and lang of the learning documents."""
    learn = docs.select("doc_id", "text", "lang").filter(~frames.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # The sample draws texts by hash, so its rate goes by distinct texts: copies must not thin it out.
    counted = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.xxhash64("text", F.lit(6))).alias("texts")).collect()
    per_lang = {r["lang"]: r["n"] for r in counted}
    if not per_lang:
        return None
    n, df = _frequencies(learn)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05)
    share = SAMPLE / len(per_lang)
    limit = F.lit(0.0)
    for r in counted:
        limit = F.when(F.col("lang") == r["lang"], min(1.0, share / r["texts"])).otherwise(limit)
    drawn = (F.xxhash64("text", F.lit(6)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) < limit
    weights = docs.sparkSession.sparkContext.broadcast(idf)

    def make():
        def step(batch):
            langs, vectors, sizes = batch.column("lang").to_pylist(), [], []
            for _, m, lengths in counts_of(batch.column("text")):
                vectors += [v.astype(np.float16).tobytes() for v in unit(m * weights.value)]
                sizes += list(lengths)
            return langs, vectors, sizes

        return step, None

    # Texts are ordered by hash, so that copies of one text cannot fill the sample unevenly and reruns agree.
    rows = frames.emitted(learn.filter(drawn).select("text", "lang").distinct(), make, "lang string, v binary, size long").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    langs, centroids, floors = [], [], []
    for lang in sorted(per_lang):
        mine = [r for r in rows if r["lang"] == lang]
        if not mine:
            continue
        x = np.stack([np.frombuffer(r["v"], np.float16) for r in mine]).astype(np.float32)
        c = spherical_kmeans(x, CLUSTERS, np.random.default_rng(6))
        near, bins = (x @ c.T).max(axis=1), length_bin(np.array([r["size"] for r in mine]))
        floor = np.zeros(LENGTH_BINS, np.float32)
        for b in range(LENGTH_BINS):
            like = near[np.abs(bins - b) <= 1]
            floor[b] = np.quantile(like, REJECT_SHARE) * REJECT_SLACK if len(like) >= 20 else 0
        langs += [lang] * len(c)
        centroids.append(c)
        floors += [floor] * len(c)
    if not langs:
        return None
    return {"idf": idf, "langs": langs, "centroids": np.concatenate(centroids).astype(np.float32), "floors": np.stack(floors),
            "common": max(sorted(per_lang), key=per_lang.get)}


def predict(array, model):
    """(languages, cosines, rejected) of the rows."""
    n = len(array)
    lang, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    if model is None:
        return lang, score, rejected
    texts = words.texts(array)
    weighted = (model["centroids"] * model["idf"]).T
    for first, m, lengths in counts_of(array):
        norm = np.sqrt(((m * model["idf"]) ** 2).sum(axis=1))
        near = np.divide(m @ weighted, norm[:, None], out=np.zeros((len(m), len(model["langs"])), np.float32), where=norm[:, None] > 0)
        best = near.argmax(axis=1)
        top = near[np.arange(len(m)), best]
        low = model["floors"][best, length_bin(lengths)]
        for i in range(len(m)):
            row = first + i
            if has_letter(texts[row]):
                lang[row] = model["langs"][best[i]] if top[i] > 0 else model["common"]
                score[row] = min(1.0, max(0.0, float(top[i])))
                rejected[row] = 0 < top[i] < low[i]
    return lang, score, rejected


def labelled(docs: DataFrame, model) -> DataFrame:
    """`docs` with _lang, _lang_score and _lang_rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda batch: predict(batch.column(batch.schema.get_field_index("text")), shared.value)

    return frames.added(docs, make, {"_lang": "string", "_lang_score": "double", "_lang_rejected": "boolean"})


def known(docs: DataFrame) -> DataFrame:
    """The documents in a language that is told with enough likeness, columns as they were."""
    return labelled(docs, fit(docs)).filter(~F.col("_lang_rejected")).select(docs.columns)


def op6_language_id(spark, sf_dir):
    docs = frames.table(spark, sf_dir, "documents")
    out = labelled(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", frames.held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_lang_score").alias("score"),
                      F.col("_lang_rejected").alias("rejected"))
