"""12. Hard-negative mining: a secondary sort over (anchor, descending score, id), streamed through windows of positive scores.

Components become integers floor(256 x), so scores are exact inner products. An anchor's positives are its first `positives` other rows of
the same label, higher scores first and ties by smaller id. Each positive opens a window: rows of other labels whose score is between
50 and 95 hundredths of the positive's, of which the first `negatives` are returned.

Scores are made in cells. Anchors lie in blocks of about `ANCHOR_VALUES` components, rows in packs of up to `PACK_ROWS`; the packs are dealt to a few
lanes, and one task streams the packs of its lane past one block, so what it holds has a fixed size. Two passes: the first keeps each
anchor's best same-label rows, which fixes the windows; the second keeps, for each window, the best rows inside. A pair that is among
the first few of all is among the first few of its lane, so nothing that can be returned is dropped, and what leaves a
lane is bounded by anchors x (positives + positives x negatives), whatever a label or a run of equal vectors holds.

What is left goes to `repartitionAndSortWithinPartitions` under packed byte keys (anchor, descending score, positives before negatives, id). An
iterator walks each partition once: a positive opens its window, a negative is emitted for each open window that it lies in and that is
not full. Of an anchor it holds its open windows only.

Edge cases: rows with a null id, null label, or a vector that is null, empty or holds null or non-finite components take no part. Rows with the anchor's id
are the anchor itself, never its positive or negative; other repeated rows count as often as they are there, and a repeated
anchor gives its rows each time. Vectors of different lengths have no score together. No positive, or none
within the window: no rows. Labels are integers. Empty table: no rows. Scores beyond a long raise an error. Extra columns are not read.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm import frames

SCALE = 256
EVERY, RELABELLED, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH, WHOLE = 50, 95, 100
PACK_ROWS, ANCHOR_VALUES, LANE_ROWS = 512, 1 << 21, 4096
SLICE = 1024
NONE = -(1 << 62)
KEY = ">QQBQ"


def integers(c):
    scaled = np.floor(SCALE * c)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("a component does not fit a long after scaling")
    return scaled.astype(np.int64)


def scores(a, b):
    """All inner products of integer rows, exactly: in doubles where none can pass 2^53, else in longs."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    most = a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max())
    if most < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if most >= 1 << 62:
        raise OverflowError("a score may not fit a long")
    return a @ b.T


class Best:
    """The first k (score, id) of each slot: higher scores first, ties by smaller id."""

    def __init__(self, slots, k):
        self.k = k
        self.score = np.full((slots, k), NONE, np.int64)
        self.id = np.full((slots, k), np.iinfo(np.int64).max, np.int64)

    def beats(self, at, found, ids):
        """Which of `found` (slots x rows) would enter the list of its slot."""
        worst, its = self.score[at, -1][:, None], self.id[at, -1][:, None]
        return (found > worst) | ((found == worst) & (ids[None] < its))

    def put(self, slot, score, ids):
        touched = np.unique(slot)
        slots = np.concatenate([slot, np.repeat(touched, self.k)])
        score = np.concatenate([score.astype(np.int64), self.score[touched].ravel()])
        ids = np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((ids, -score, slots))
        slots, score, ids = slots[order], score[order], ids[order]
        rank = np.arange(len(slots)) - np.searchsorted(slots, slots)
        keep = rank < self.k
        self.score[slots[keep], rank[keep]], self.id[slots[keep], rank[keep]] = score[keep], ids[keep]

    def rows(self):
        slot, rank = np.nonzero(self.score > NONE)
        return slot, self.score[slot, rank], self.id[slot, rank]


class Block:
    """The anchors of one block that share a vector length: numbers, ids, labels, vectors and, in the second pass, windows."""

    def __init__(self, packs, k, width):
        self.no, self.id, self.label, self.v = (np.concatenate([p[x] for p in packs]) for x in ("no", "id", "label", "v"))
        self.best = Best(len(self.no) * width, k)
        if width > 1:
            p = np.concatenate([p["windows"] for p in packs])
            there = p > NONE
            whole, rest = np.divmod(p, WHOLE)
            # Smallest and largest score inside: 50 p <= 100 s <= 95 p, without leaving the range of a long.
            self.low = np.where(there, LOW * whole - (-LOW * rest) // WHOLE, 1)
            self.high = np.where(there, HIGH * whole + HIGH * rest // WHOLE, 0)

    def positives(self, rows):
        for label in np.intersect1d(self.label, rows["label"]):
            mine, theirs = np.flatnonzero(self.label == label), np.flatnonzero(rows["label"] == label)
            for at in np.array_split(mine, max(1, -(-len(mine) // SLICE))):
                found = scores(self.v[at], rows["v"][theirs])
                enter = self.best.beats(at, found, rows["id"][theirs]) & (self.id[at][:, None] != rows["id"][theirs][None])
                i, j = np.nonzero(enter)
                if len(i):
                    self.best.put(at[i], found[i, j], rows["id"][theirs][j])

    def negatives(self, rows, width):
        for start in range(0, len(self.no), SLICE):
            at = np.arange(start, min(start + SLICE, len(self.no)))
            found = scores(self.v[at], rows["v"])
            other = (self.label[at][:, None] != rows["label"][None]) & (self.id[at][:, None] != rows["id"][None])
            for w in range(width):
                inside = (found >= self.low[at, w][:, None]) & (found <= self.high[at, w][:, None])
                i, j = np.nonzero(inside & other & self.best.beats(at * width + w, found, rows["id"]))
                if len(i):
                    self.best.put(at[i] * width + w, found[i, j], rows["id"][j])


def usable(rows: DataFrame, key="vec_id", vector="embedding", label="label") -> DataFrame:
    """(id, label, v) of the rows that take part."""
    fine = F.col(key).isNotNull() & F.col(label).isNotNull() & frames.whole(rows, vector)
    return rows.filter(fine).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))


PACK = "pack long, dim int, no binary, id binary, label binary, v binary, kind string, windows binary"


def packs(rows: DataFrame, width=0) -> DataFrame:
    """Rows of `usable` in packs of one vector length: columns as bytes, vectors as the smallest integers that hold them.

    `no` numbers anchors and `windows` lists the scores of their positives, where these columns are there.
    """
    has_no, has_windows = "no" in rows.columns, "windows" in rows.columns

    def make():
        held, made = {}, [TaskContext.get().partitionId()]

        def pack(d):
            parts = held.pop(d)
            v = np.concatenate([p["v"] for p in parts])
            kind = next(k for k in ("i1", "i2", "i4", "i8") if np.abs(v).max() <= np.iinfo(k).max)
            made[0] += 1
            columns = {c: np.concatenate([p[c] for p in parts]).tobytes() for c in ("no", "id", "label", "windows")}
            return made[0], d, columns["no"], columns["id"], columns["label"], v.astype(kind).tobytes(), kind, columns["windows"]

        def step(batch):
            out = []
            for at, c in frames.matrices(batch.column(batch.schema.get_field_index("v"))):
                def taken(name, fill, at=at):
                    return batch.column(name).to_numpy(zero_copy_only=False)[at] if fill else np.zeros(0, np.int64)

                windows = np.zeros((0, width), np.int64)
                if has_windows:
                    windows = np.full((len(at), width), NONE, np.int64)
                    lists = batch.column("windows").take(pa.array(at))
                    sizes = np.diff(lists.offsets.to_numpy())
                    slot = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    windows[np.repeat(np.arange(len(at)), sizes), slot] = lists.flatten().to_numpy()
                d = c.shape[1]
                new = {"v": integers(c), "id": taken("id", True), "label": taken("label", True), "no": taken("no", has_no), "windows": windows}
                for start in range(0, len(at), PACK_ROWS):
                    part = {k: x[start:start + PACK_ROWS] for k, x in new.items()}
                    if sum(len(p["id"]) for p in held.get(d, [])) + len(part["id"]) > PACK_ROWS:
                        out.append(pack(d))
                    held.setdefault(d, []).append(part)
            return list(zip(*out, strict=True)) if out else None

        def end():
            out = [pack(d) for d in list(held)]
            return list(zip(*out, strict=True)) if out else None

        return step, end

    return frames.emitted(rows, make, PACK)


def _unpacked(batch, i, width):
    value = {c: batch.column(c)[i].as_py() for c in ("dim", "kind", "no", "id", "label", "v", "windows")}
    out = {c: np.frombuffer(value[c], np.int64) for c in ("no", "id", "label")}
    out["v"] = np.frombuffer(value["v"], value["kind"]).reshape(-1, value["dim"]).astype(np.int64)
    out["windows"] = np.frombuffer(value["windows"], np.int64).reshape(-1, max(1, width))
    return value["dim"], out


def cells(anchors: DataFrame, rows: DataFrame, blocks: int, lanes: int) -> DataFrame:
    """Each pack of rows once for each block, in one of its lanes; each pack of anchors once for each lane of its block."""
    block = F.pmod(F.col("pack"), F.lit(blocks))
    asked = anchors.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("cell", block * lanes + F.col("lane")).withColumn("asks", F.lit(0))
    given = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    given = given.withColumn("cell", F.col("block") * lanes + F.pmod(F.col("pack") + F.col("block"), F.lit(lanes))).withColumn("asks", F.lit(1))
    both = asked.drop("lane").unionByName(given.drop("block")).withColumn("cell", F.col("cell").cast("int"))
    return both.repartitionById(blocks * lanes, "cell").sortWithinPartitions("cell", "asks")


def streamed(both: DataFrame, k: int, width: int) -> DataFrame:
    """(no, anchor_id, score, id): first pass (width 0) the best k of the anchor's label, second pass the best k of each of its windows."""

    def make():
        cell, waiting, blocks = None, {}, {}

        def finish():
            out = []
            for b in blocks.values():
                slot, score, ids = b.best.rows()
                at = slot // max(1, width)
                if width:
                    # A row that several windows chose goes on once; repeated rows stay as many as the window that took most.
                    order = np.lexsort((slot, ids, -score, at))
                    at, slot, score, ids = at[order], slot[order], score[order], ids[order]
                    same = np.zeros(len(at), bool)
                    same[1:] = (at[1:] == at[:-1]) & (score[1:] == score[:-1]) & (ids[1:] == ids[:-1]) & (slot[1:] == slot[:-1])
                    run = np.flatnonzero(~same)
                    copy = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                    at, _, score, ids = np.unique(np.stack([at, copy, score, ids]), axis=1) if len(at) else (at, copy, score, ids)
                out.append((b.no[at], b.id[at], score, ids))
            waiting.clear()
            blocks.clear()
            return [np.concatenate(c) for c in zip(*out, strict=True)] if out else None

        def step(batch):
            nonlocal cell
            out = []
            for i in range(batch.num_rows):
                now = batch.column("cell")[i].as_py()
                if now != cell:
                    out.append(finish())
                    cell = now
                d, part = _unpacked(batch, i, width)
                if batch.column("asks")[i].as_py() == 0:
                    waiting.setdefault(d, []).append(part)
                    continue
                if d in waiting:
                    blocks[d] = Block(waiting.pop(d), k, max(1, width))
                if d in blocks:
                    blocks[d].negatives(part, width) if width else blocks[d].positives(part)
            out = [x for x in out if x is not None]
            return [np.concatenate(c) for c in zip(*out, strict=True)] if out else None

        return step, finish

    return frames.emitted(both, make, "no long, anchor_id long, score long, id long")


def keyed(found: DataFrame, kind: int):
    """RDD of (packed key, anchor id): bytes sort by anchor, falling score, kind and id."""

    def pack(rows):
        for r in rows:
            yield struct.pack(KEY, r["no"] + (1 << 63), (1 << 63) - 1 - r["score"], kind, r["id"] + (1 << 63)), r["anchor_id"]

    return found.rdd.mapPartitions(pack)


def windows_of(records, negatives=NEGATIVES):
    """Sorted records to (anchor, positive, rank, negative, scores); holds one anchor's open windows."""
    anchor, opened = None, []
    for key, name in records:
        no, score, kind, row = struct.unpack(KEY, key)
        score, row = (1 << 63) - 1 - score, row - (1 << 63)
        if no != anchor:
            anchor, opened = no, []
        if kind == 0:
            opened.append([row, score, 0])
            continue
        for w in opened:
            if w[2] < negatives and LOW * w[1] <= WHOLE * score <= HIGH * w[1]:
                w[2] += 1
                yield name, w[0], w[2], row, w[1], score


def mined(rows: DataFrame, anchors: DataFrame, positives=POSITIVES, negatives=NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from two frames of `usable` rows."""
    spark = rows.sparkSession
    asked = frames.stored(anchors.withColumn("no", F.monotonically_increasing_id()), "anchors")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    given = frames.stored(packs(rows), "packs")
    n = rows.count()
    blocks = max(1, -(-size["n"] * (size["d"] or 1) // ANCHOR_VALUES))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(1, min(-(-n // LANE_ROWS), -(-parts // blocks)))
    best = streamed(cells(packs(asked), given, blocks, lanes), positives, 0)
    order = Window.partitionBy("no").orderBy(F.desc("score"), "id")
    best = frames.stored(best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= positives).drop("r"), "positives")
    opened = best.groupBy("no").agg(F.collect_list("score").alias("windows"))  # at most `positives` of them
    second = packs(asked.join(opened, "no").select("no", "id", "label", "v", "windows"), positives)
    kept = streamed(cells(second, given, blocks, lanes), negatives, positives)
    pairs = keyed(best, 0).union(keyed(kept, 1))
    dealt = pairs.repartitionAndSortWithinPartitions(max(parts, lanes), lambda key: zlib.crc32(key[:8]))
    out = dealt.mapPartitions(lambda records: windows_of(records, negatives))
    return spark.createDataFrame(out, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op12_hard_negatives(spark, sf_dir):
    table = frames.table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = usable(table.withColumn("label", changed))
    return mined(rows, rows.filter(F.col("id") % EVERY == 0))


ORACLE_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY rank <= 3
"""
