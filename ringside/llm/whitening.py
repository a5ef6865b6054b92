"""11. Embedding whitening: exact cross-products by bit-sliced scatter, centred as integers before the eigenproblem.

Entries become integers x = floor(64 c) + 1000000. A task takes its rows in blocks: each dimension is shifted by its smallest
value in the block, its bit planes are packed across rows into 64-bit words, and the popcount of two planes ANDed, weighted by
the planes' powers of two, adds up to the exact cross-product. The shift is undone in integers. Tasks give n, the sums S and the
cross-products X, cut in limbs of 40 bits that Spark adds up; n X - S S' is then an integer matrix, divided only at the end.

The driver receives one row for each pair of dimensions and solves one symmetric eigenproblem of that size; nothing there grows
with the rows. Three passes read the table: scatter, covariance of the whitened rows (for identity_error), result.

Edge cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped. Where vectors have several
lengths, those of the most frequent one are used (the greater of two as frequent) and the rest dropped. A null
or repeated id is kept as often as it is there. Directions without variance (one row, equal rows, fewer rows than dimensions) have
explained 0 and whitened 0, and identity_error is then 1, as it is read. Empty table: no rows. Entries beyond 2^62 / 64 do not
fit the integers and raise an error. Extra columns are not read.
"""

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm import frames

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK_ROWS = 1 << 14
LIMB = 40
LIMBS = 4


def integers(c: np.ndarray) -> np.ndarray:
    scaled = np.floor(SCALE * c)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("an entry does not fit a long after scaling")
    return scaled.astype(np.int64) + SHIFT


def planes(u: np.ndarray):
    """(dimension, bit, words) of all bit planes of non-negative integers; a plane has one bit per row, 64 to a word."""
    n, d = u.shape
    padded = np.zeros((-(-n // 64) * 64, d), np.int64)
    padded[:n] = u
    width = [int(x).bit_length() for x in u.max(axis=0)]
    dims, bits, words = [], [], []
    for b in range(max(width)):
        has = np.flatnonzero(np.array(width) > b)
        packed = np.packbits(((padded[:, has] >> b) & 1).astype(np.uint8), axis=0)
        words.append(np.ascontiguousarray(packed.T).view(np.uint64))
        dims.append(has)
        bits.append(np.full(len(has), b))
    if not words:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, len(padded) // 64), np.uint64)
    return np.concatenate(dims), np.concatenate(bits), np.concatenate(words)


def scatter(u: np.ndarray) -> np.ndarray:
    """Exact cross-products of the columns of `u` (non-negative integers), as Python integers in a symmetric matrix."""
    d = u.shape[1]
    dims, bits, words = planes(u)
    by_power = np.zeros((2 * int(bits.max(initial=0)) + 1, d, d), np.int64)
    for k in range(len(dims)):
        counts = np.bitwise_count(words[k] & words[k:]).sum(axis=1, dtype=np.int64)
        # Two planes of one dimension stand for two ordered pairs.
        counts[(dims[k:] == dims[k]) & (bits[k:] != bits[k])] *= 2
        low, high = np.minimum(dims[k], dims[k:]), np.maximum(dims[k], dims[k:])
        by_power[bits[k] + bits[k:], low, high] += counts
    total = sum((layer.astype(object) << p for p, layer in enumerate(by_power)), np.zeros((d, d), object))
    return np.triu(total) + np.triu(total, 1).T


class Sums:
    """n, sums and cross-products of integer rows, block after block."""

    def __init__(self, d, block=BLOCK_ROWS):
        self.block, self.waiting, self.held = block, [], 0
        self.n, self.s, self.x = 0, np.zeros(d, object), np.zeros((d, d), object)

    def add(self, rows):
        self.waiting.append(rows)
        self.held += len(rows)
        if self.held >= self.block:
            self.flush()

    def flush(self):
        if not self.held:
            return
        rows = np.concatenate(self.waiting)
        self.waiting, self.held = [], 0
        low = rows.min(axis=0)
        u = rows - low
        if (u < 0).any():
            raise OverflowError("the range of a dimension does not fit a long")
        m, low = len(rows), low.astype(object)
        su = (u & 0xFFFFFFFF).sum(axis=0).astype(object) + ((u >> 32).sum(axis=0).astype(object) << 32)
        self.n += m
        self.s += su + m * low
        self.x += scatter(u) + np.outer(low, su) + np.outer(su, low) + m * np.outer(low, low)


def limbs(value: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def totals(rows: DataFrame, vector: str) -> DataFrame:
    """(d, i, j, v0 .. v3): exact sums over all rows of each vector length; j = -1: sums of x, i = j = -1: row count."""

    def make():
        sums = {}

        def step(batch):
            for _, c in frames.matrices(batch.column(0)):
                sums.setdefault(c.shape[1], Sums(c.shape[1])).add(integers(c))

        def end():
            out = []
            for d, found in sums.items():
                found.flush()
                out.append((d, -1, -1, *limbs(found.n)))
                out += [(d, i, -1, *limbs(found.s[i])) for i in range(d)]
                out += [(d, i, j, *limbs(found.x[i, j])) for i in range(d) for j in range(i, d)]
            return list(zip(*out, strict=True)) if out else None

        return step, end

    schema = "d int, i int, j int, " + ", ".join(f"v{k} long" for k in range(LIMBS))
    parts = frames.emitted(rows.select(vector), make, schema)
    return parts.groupBy("d", "i", "j").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(LIMBS)])


class Model:
    """Mean as q + r / n in integers, eigenvalues by falling size, unit eigenvectors as columns (largest entry positive)."""

    def __init__(self, n, s, x, components):
        d = len(s)
        self.n, self.s, self.d = n, s, d
        centred = n * x - np.outer(s, s)
        covariance = np.array([[int(v) / (n * n) for v in row] for row in centred])
        e, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-e, kind="stable")[:components]
        trace = sum(int(centred[i, i]) for i in range(d)) / (n * n)
        self.e = np.where(e[order] > trace * d * 2.0**-50, e[order], 0.0)
        self.axes = vectors[:, order] * np.where(np.take_along_axis(vectors[:, order], np.abs(vectors[:, order]).argmax(axis=0)[None], 0) < 0, -1, 1)
        self.explained = [float(v) / trace if trace else 0.0 for v in self.e]
        self.whole = np.array([int(v) // n for v in s])
        self.part = np.array([(int(v) % n) / n for v in s])
        self.over_root = np.where(self.e > 0, 1 / np.sqrt(np.where(self.e > 0, self.e, 1.0)), 0.0)

    def whitened(self, x):
        return (((x - self.whole) - self.part) @ self.axes) * self.over_root

    def deviations(self, x):
        """Sum over dimensions of (n x - S)^2, exactly, as decimals."""
        away = x - self.whole
        most = (int(np.abs(away).max(initial=0)) + 1) * self.n
        if self.d * most * most < 1 << 63:
            y = away * self.n - np.array([int(v) % self.n for v in self.s])
            return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
        y = away.astype(object) * self.n - np.array([int(v) % self.n for v in self.s], object)
        return pa.array([Decimal(int(v)) for v in (y * y).sum(axis=1)], pa.decimal128(38, 0))


def fit(rows: DataFrame, vector="embedding", components=COMPONENTS) -> Model | None:
    """The model of all whole vectors of the most frequent length; None where there are none."""
    found = frames.stored(totals(rows.filter(frames.whole(rows, vector)), vector), "scatter")
    whole = sum(F.col(f"v{k}").cast("decimal(38,0)") * (1 << (LIMB * k)) for k in range(2))
    top = found.filter("i < 0").orderBy(whole.desc(), F.desc("d")).first()
    if top is None:
        return None
    d = top["d"]
    n, s, x = 0, np.zeros(d, object), np.zeros((d, d), object)
    for r in found.filter(F.col("d") == d).collect():  # one row for each pair of dimensions
        value = sum(int(r[f"v{k}"]) << (LIMB * k) for k in range(LIMBS))
        if r["i"] < 0:
            n = value
        elif r["j"] < 0:
            s[r["i"]] = value
        else:
            x[r["i"], r["j"]] = x[r["j"], r["i"]] = value
    return Model(n, s, x, components)


def projected(rows: DataFrame, model: Model, key="vec_id", vector="embedding") -> DataFrame:
    """(id, deviation decimal(38,0), whitened array<double>) of the rows that take part."""
    used = rows.filter(frames.whole(rows, vector) & (F.size(vector) == model.d))

    def make():
        def step(batch):
            x = integers(np.concatenate([c for _, c in frames.matrices(batch.column("_v"))])) if batch.num_rows else np.zeros((0, model.d), np.int64)
            w = model.whitened(x)
            lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], w.ravel())
            return [model.deviations(x), lists]

        return step

    return frames.added(used.select(F.col(key).alias("_id"), F.col(vector).alias("_v")), make, {"deviation": "decimal(38,0)", "whitened": "array<double>"}, drop=["_v"])


def identity_error(rows: DataFrame, model: Model, vector="embedding") -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, from the rows themselves."""
    used = rows.filter(frames.whole(rows, vector) & (F.size(vector) == model.d))
    k = len(model.e)

    def make():
        sums, products = np.zeros(k), np.zeros((k, k))

        def step(batch):
            for _, c in frames.matrices(batch.column(0)):
                w = model.whitened(integers(c))
                sums[:] += w.sum(axis=0)
                products[:] += w.T @ w

        def end():
            i, j = np.triu_indices(k)
            return [[*range(k), *i], [*[-1] * k, *j], [*sums, *products[i, j]]]

        return step, end

    found = frames.emitted(used.select(vector), make, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean, product = np.zeros(k), np.zeros((k, k))
    for i, j, v in found:
        if j < 0:
            mean[i] = v / model.n
        else:
            product[i, j] = product[j, i] = v / model.n
    return float(np.abs(product - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, key="vec_id", vector="embedding", components=COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each row used and component."""
    model = fit(rows, vector, components)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model, vector)
    explained = F.array(*[F.lit(v) for v in model.explained])
    out = projected(rows, model, key, vector).select("_id", "deviation", F.posexplode("whitened").alias("pos", "w"))
    return out.select(F.col("_id").alias(key), (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"),
                      explained[F.col("pos")].alias("explained"), F.lit(error if math.isfinite(error) else None).cast("double").alias("identity_error"))


def op11_embedding_whitening(spark, sf_dir):
    """deviation as a long: the cast raises an error where a table is so large that it does not fit."""
    return whitened(frames.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
