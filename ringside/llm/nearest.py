"""10. Approximate nearest neighbours: a vantage-point tree per shard, pruned by a relaxed triangle inequality.

Nearness is the largest inner product. With M the largest norm, x -> (x, sqrt(M^2 - |x|^2)) and q -> (q, 0) turn it into the
smallest Euclidean distance, where trees can prune: a subtree beyond the split radius mu of vantage point v holds nothing nearer
than |d(q, v) - mu|, so it is skipped when factor * |d(q, v) - mu| exceeds the query's k-th distance so far. Factor 1 is
exact search; a larger factor skips more. `FACTOR` is set by recall against brute force (README).

Vectors are dealt to shards of about `SHARD_ROWS` by a hash of vec_id, so that no cluster or run of equal vectors fills a
shard; the number of shards grows with the table. Queries meet a shard in blocks of about `QUERY_ROWS`: one task holds one shard
and one block. Each gives its `k` best, and a query's lists (one per shard) are ranked last. Equal vectors in a
shard share a tree node; only the k + 1 smallest ids of a node can be in a list, and these are exact.

Edge cases: vectors that are null, zero, or hold null or non-finite components neither ask nor answer. Vectors of
another length are never candidates of a query. Rows without vec_id take no part. A repeated vec_id is a candidate as
often as it is there, and no candidate of itself. Fewer than k candidates: all of them. Empty table: no rows.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm import frames

K = 20
EVERY = 20
SHARD_ROWS, QUERY_ROWS, LEAF = 8192, 8192, 128
FACTOR = 1.3


class Tree:
    """Rows are augmented vectors; nodes are (vantage row, radius, inside, outside) or arrays of leaf rows."""

    def __init__(self, rows, leaf=LEAF):
        self.rows, self.leaf = rows, leaf
        self.rng = np.random.default_rng(10)
        self.root = self._grow(np.arange(len(rows)))

    def _grow(self, at):
        if len(at) <= self.leaf:
            return at
        v = at[self.rng.integers(len(at))]
        d = _distances(self.rows[at], self.rows[v][None])[:, 0]
        mu = float(np.median(d))
        inside = d <= mu
        if inside.all():
            inside = d < mu
            if not inside.any():
                return at
        return v, mu, self._grow(at[inside]), self._grow(at[~inside])

    def search(self, queries, visit, bound, factor=FACTOR):
        """Call visit(query numbers, leaf rows) for all leaves that are not pruned; bound(numbers) gives their reach."""
        stack = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while stack:
            node, who, least = stack.pop()
            keep = factor * least <= bound(who)
            who, least = who[keep], least[keep]
            if not len(who):
                continue
            if isinstance(node, np.ndarray):
                visit(who, node)
                continue
            v, mu, near, far = node
            d = _distances(queries[who], self.rows[v][None])[:, 0]
            gap = np.abs(d - mu)
            within = d <= mu
            # The last pushed is searched first: each query takes its own side before the other.
            stack.append((near, who[~within], np.maximum(least, gap)[~within]))
            stack.append((far, who[within], np.maximum(least, gap)[within]))
            stack.append((near, who[within], least[within]))
            stack.append((far, who[~within], least[~within]))


def _distances(a, b):
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def inner(a, b):
    """Row by row, in double precision, summed from the first component to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def search_shard(ids, vectors, query_ids, queries, top, k=K, factor=FACTOR):
    """(query row, vec_id, score) of the k best of this shard for each query; top is the largest norm anywhere."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(ids)))
    distinct = vectors[first]
    norms = (distinct * distinct).sum(axis=1)
    rows = np.concatenate([distinct, np.sqrt(np.maximum(top * top - norms, 0))[:, None]], axis=1)
    asked = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    # Enough distinct vectors for k other ids: one node more, since a query may find itself. k-th distances bound the search.
    held = k + 1
    best_d = np.full((len(queries), held), np.inf)
    best_n = np.full((len(queries), held), -1)

    def visit(who, leaf):
        d = _distances(asked[who], rows[leaf])
        all_d = np.concatenate([best_d[who], d], axis=1)
        all_n = np.concatenate([best_n[who], np.broadcast_to(leaf, d.shape)], axis=1)
        if all_d.shape[1] > held:
            cut = np.argpartition(all_d, held - 1, axis=1)[:, :held]
            all_d, all_n = np.take_along_axis(all_d, cut, 1), np.take_along_axis(all_n, cut, 1)
        best_d[who], best_n[who] = all_d, all_n

    Tree(rows).search(asked, visit, lambda who: best_d[who].max(axis=1) * (1 + 1e-9) + 1e-9, factor)
    q, slot = np.nonzero(best_n >= 0)
    node = best_n[q, slot]
    take = np.minimum(size[node], k + 1)
    q = np.repeat(q, take)
    at = np.repeat(first[node], take) + (np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take))
    other = ids[at] != query_ids[q]
    q, at = q[other], at[other]
    score = inner(queries[q], vectors[at])
    order = np.lexsort((ids[at], -score, q))
    q, at, score = q[order], at[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = rank < k
    return q[keep], ids[at][keep], score[keep]


def usable(rows: DataFrame, key="vec_id", vector="embedding") -> DataFrame:
    """(id, v, dim) of the vectors that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(key).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"))


def neighbours(vectors: DataFrame, queries: DataFrame, k=K, factor=FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score) from two frames of `usable` rows."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    figures = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
    asked = queries.count()
    shards, blocks = max(1, math.ceil(figures["n"] / SHARD_ROWS)), max(1, math.ceil(asked / QUERY_ROWS))
    top = figures["top"] or 0.0

    def dealt(rows, n, seed):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")

    # A shard goes to every block of queries, and a block to every shard: each cell of this grid is one bounded group.
    shard = vectors.withColumn("s", dealt(vectors, shards, 1)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(False))
    block = queries.withColumn("b", dealt(queries, blocks, 2)).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))

    def cell(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, v = rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(float)
        q, found, score = search_shard(ids[~asks], v[~asks], ids[asks], v[asks], top, k, factor)
        return pd.DataFrame({"query_id": ids[asks][q], "vec_id": found, "score": score})

    both = shard.select("s", "b", "dim", "id", "v", "asks").unionByName(block.select("s", "b", "dim", "id", "v", "asks"))
    frames.reach(both)
    found = both.groupBy("s", "b", "dim").applyInPandas(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_neighbours(spark, sf_dir):
    vectors = usable(frames.table(spark, sf_dir, "embeddings"))
    return neighbours(vectors, vectors.filter(F.col("id") % EVERY == 0))
