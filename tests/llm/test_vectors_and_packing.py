"""Whitening, hard negatives and packing against plain loops, on awkward rows and with small blocks."""

import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringside.llm import hard_negatives, packing, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, _v string, no string, component string"


def vector_rows(n=300, d=6, seed=3):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = [2.0, 1.0, 0.0, 0.0, 0.0, -1.0] if i % 3 == 0 else (rnd.normal(size=d) * 3).tolist()
        rows.append((i, v, int(rnd.integers(0, 4)), "a", "b", "c"))
    odd = [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (902, [float("nan")] + [0.0] * 5, 1), (903, [float("inf")] + [0.0] * 5, 2),
           (904, [], 1), (905, [1.0, 2.0], 1), (950, [1.0, 2.0], 1), (906, [0.0] * 6, 2), (None, [1.0] * 6, 1), (50, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0], 3), (7, [3.0] * 6, None)]
    return rows + [(*r, "a", "b", "c") for r in odd]


def exact(rows):
    """n, S and the centred integer matrix by loops over Python integers."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return x, n, s, [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def fits(v, d=6):
    return v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)


def test_scatter_is_exact():
    rnd = np.random.default_rng(1)
    for high in (1, 2, 5, 1 << 20, 1 << 45):
        u = rnd.integers(0, high, (131, 4))
        assert (whitening.scatter(u) == u.astype(object).T @ u.astype(object)).all()
        sums = whitening.Sums(4, block=50)
        for part in np.array_split(u - high // 2, 7):
            sums.add(part)
        sums.flush()
        v = (u - high // 2).astype(object)
        assert sums.n == 131 and (sums.s == v.sum(axis=0)).all() and (sums.x == v.T @ v).all()
    for value in (0, 5, -7, 1 << 130, -(1 << 130)):
        assert sum(limb << (whitening.LIMB * k) for k, limb in enumerate(whitening.limbs(value))) == value


def test_whitening(spark):
    rows = vector_rows()
    used = [(r[0], r[1]) for r in rows if fits(r[1])]
    x, n, s, c = exact(used)
    out = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    assert len(out) == len(used) * 6
    e, axes = np.linalg.eigh(np.array([[float(Fraction(v, n * n)) for v in r] for r in c]))
    e, axes = e[::-1], axes[:, ::-1]
    want = {}
    for (i, _), row in zip(used, x, strict=True):
        centred = np.array([float(Fraction(n * v - t, n)) for v, t in zip(row, s, strict=True)])
        want.setdefault(i, []).append((sum((n * v - t) ** 2 for v, t in zip(row, s, strict=True)), np.abs(centred @ axes / np.sqrt(e))))
    for r in out:
        assert r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-9
        assert any(int(r["deviation"]) == dev and abs(abs(r["whitened"]) - w[r["component"] - 1]) < 1e-9 for dev, w in want[r["vec_id"]])
    by = {}
    for r in out:
        by.setdefault((r["component"]), []).append(r["whitened"])
    assert all(abs(np.mean(v)) < 1e-9 and abs(np.var(v) - 1) < 1e-9 for v in by.values())


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    flat = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], schema)).collect()
    assert len(flat) == 4 and all(r["whitened"] == 0 and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 1 for r in flat)
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(40)], schema)).collect()
    assert {r["component"]: round(r["explained"], 9) for r in line} == {1: 1.0, 2: 0.0} and {r["whitened"] for r in line if r["component"] == 2} == {0.0}
    with pytest.raises(Exception, match="does not fit"):
        whitening.whitened(spark.createDataFrame([(1, [1e30])], schema)).collect()


def mined_by_loops(rows, anchor=lambda i: i % 50 == 0, positives=5, negatives=3):
    rows = [(i, label, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, label in rows if i is not None and label is not None and v and fits(v, len(v))]
    out = []
    for i, label, q in rows:
        if not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(q, p, strict=True)), j, other) for j, other, p in rows if j != i and len(p) == len(q)]
        mine = sorted((x for x in scored if x[2] == label), key=lambda x: x[:2])[:positives]
        for score, j, _ in mine:
            inside = sorted(x[:2] for x in scored if x[2] != label and 50 * -score <= 100 * -x[0] <= 95 * -score)
            out += [(i, j, k + 1, other, -score, -s) for k, (s, other) in enumerate(inside[:negatives])]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PACK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "LANE_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "ANCHOR_VALUES", 12)
    rows = vector_rows(600) + [(100, [2.0, 1.0, 0.0, 0.0, 0.0, -1.0], 1, "", "", "")] + [(33, [1.5, 1.0, 0.0, 0.0, 0.0, 0.0], k, "", "", "") for k in (0, 0, 1, 1, 1, 1, 1)]
    table = hard_negatives.usable(spark.createDataFrame(rows, VECTORS).repartition(7))
    got = hard_negatives.mined(table, table.filter("id % 50 = 0")).collect()
    assert sorted(map(tuple, got)) == mined_by_loops([r[:3] for r in rows])
    assert hard_negatives.mined(table.limit(0), table.limit(0)).collect() == []


def test_windows_and_large_scores(spark):
    def key(score, kind, row, no=1):
        import struct

        return struct.pack(hard_negatives.KEY, no + (1 << 63), (1 << 63) - 1 - score, kind, row + (1 << 63))

    # A score of 0 is inside the window of a positive of 0, whichever id comes first; a negative positive has no window.
    records = sorted([(key(0, 0, 9), 5), (key(0, 1, 2), 5), (key(-4, 0, 3), 5), (key(-3, 1, 4), 5), (key(100, 0, 1, no=2), 6), (key(95, 1, 8, no=2), 6), (key(96, 1, 7, no=2), 6)])
    assert list(hard_negatives.windows_of(records)) == [(5, 9, 1, 2, 0, 0), (6, 1, 1, 8, 100, 95)]
    big = np.array([[1 << 29, 3], [1 << 28, -5]])
    assert (hard_negatives.scores(big, big) == big @ big.T).all() and hard_negatives.scores(big, big).dtype == np.int64
    with pytest.raises(OverflowError):
        hard_negatives.scores(big << 4, big)


TEXTS = [(1, None, 7), (2, "", 7), (3, " \n\t", 7), (4, "A short text, it's fine.", 7), (4, "A short text, it's fine.", 7), (None, "no id", 7), (5, "word " * 5000, 7),
         (6, "x1y2 <|endoftext|> Ωμέγά 日本語 don't\x00stop\x1cnow", 7), (7, "one two three " * 40_000, 7)]


def test_pieces_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary())
    rows = packing.pieces(spark.createDataFrame(TEXTS, "doc_id long, text string, length int")).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = packing.pieces(docs).collect()
    texts = {i: t for i, t, _ in TEXTS} | {1000 + r["doc_id"]: r["text"] for r in docs.collect()}
    found = {}
    for r, shift in itertools.chain(((r, 0) for r in rows), ((r, 1000) for r in more)):
        found.setdefault(None if r["doc_id"] is None else r["doc_id"] + shift, []).append(r)
    assert set(found) == set(texts)
    for i, parts in found.items():
        whole = [*plain.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        want = [(no, at, min(2048, len(whole) - at), np.array(whole[at:at + 2048], "<u4").tobytes()) for no, at in enumerate(range(0, len(whole), 2048))]
        assert sorted((r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in parts) == sorted(want * (2 if i == 4 else 1))


def test_encoder_cache_and_spans():
    from tokenizers import Tokenizer

    rnd = random.Random(5)
    plain, small = Tokenizer.from_file(packing.vocabulary()), packing.Encoder(packing.vocabulary(), kept=5)
    signs = "abZ's09!<|>é́ßΣ字​\xa0　 \n\t"
    for _ in range(300):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(60)))
        assert np.frombuffer(small.encode(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    text = ("ab cd\n" * 50_000).encode()
    assert b"".join(text[a:b] for a, b in packing.spans(text, 1000)) == text and max(b - a for a, b in packing.spans(text, 1000)) < 1010


def least_bins(lengths, capacity):
    """The least number of bins of a small case by trying all ways."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in {fill: k for k, fill in enumerate(bins)}.values():
            if bins[k] + lengths[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1:]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_local_search():
    rnd = random.Random(2)
    for case in range(60):
        lengths = [rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 9))]
        bins = packing.pack(lengths, 20)
        assert sorted(itertools.chain(*bins)) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 20 for b in bins)
        assert len(bins) <= least_bins(lengths, 20) + (case % 10 == 0)  # at most a bin more, and seldom
    # From one document a bin, moves and swaps alone empty bins, and squared fill never falls.
    lengths = [rnd.randrange(1, 900) for _ in range(400)]
    alone = [[i] for i in range(400)]
    bins = packing.pack(lengths, 2048, alone)
    assert len(bins) <= -(-sum(lengths) // 2048) + 2
    search = packing.Search([b for b in packing.best_fit([6, 6, 5, 3], 10)], 10)
    search.run()
    assert sorted(b.fill for b in search.bins if b.fill) == [5, 6, 9]


def test_each_step_raises_squared_fill():
    rnd = random.Random(8)
    lengths = [rnd.randrange(300, 1300) for _ in range(300)]
    found = packing.best_fit(lengths, 2048)

    class Watched(packing.Search):
        def _apply(self, *step):
            before = sum(b.fill**2 for b in self.bins)
            super()._apply(*step)
            assert sum(b.fill**2 for b in self.bins) > before and max(b.fill for b in self.bins) <= 2048

    Watched(found, 2048).run()
    assert sum(b.fill for b in found) == sum(lengths)


def test_packing(spark):
    rnd = random.Random(4)
    rows = [(k, 1400 if k % 3 == 0 else 2048 if k % 50 == 1 else rnd.randrange(1, 2048), "x") for k in range(5000)]
    out = packing.packed(spark.createDataFrame(rows, "key long, length long, sequence_id_old string"), group_rows=500).collect()
    assert sorted((r["key"], r["length"]) for r in out) == [r[:2] for r in rows]
    by = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 2048 and len(by) <= len(packing.pack([r[1] for r in rows])) * 1.02
    assert packing.packed(spark.createDataFrame([], "key long, length long")).collect() == []


def test_sequences_and_query(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, sequence_id int")
    out = packing.sequences(docs).collect()
    parts = {(r["doc_id"], r["piece"], r["length"]): bytes(r["ids"]) for r in packing.pieces(docs).collect()}
    assert sum(len(r["docs"]) for r in out) == len(packing.pieces(docs).collect())
    for r in out:
        assert bytes(r["ids"]) == b"".join(parts[(d["doc_id"], d["piece"], d["length"])] for d in r["docs"]) and len(r["ids"]) <= 4 * 2048
    assert packing.sequences(docs.limit(0)).collect() == []
    made = packing.op13_best_fit_packing(spark, SF).collect()
    whole = {(r["doc_id"], r["piece"]): zlib.crc32(bytes(r["ids"])) for r in packing.pieces(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in made} == whole
    least = -(-sum(r["length"] for r in made) // 2048)
    assert len({r["sequence_id"] for r in made}) <= least + 2


def test_queries_keep_their_types(spark):
    assert dict(whitening.op11_embedding_whitening(spark, SF).dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert whitening.op11_embedding_whitening(spark, SF).groupBy("vec_id").agg(F.count("*").alias("c")).agg(F.min("c"), F.max("c")).first() == (32, 32)
