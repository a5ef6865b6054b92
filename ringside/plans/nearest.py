"""Lookups along a time axis without pairing rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.plans.ordering import sorted_index
from ringside.plans.scan import last_of, max_of, null_safe, scan


def _stack(probes, marks, keys, probe_time, mark_time, payload):
    """Distinct probe times and one row per mark time, on one axis."""
    asked = probes.where(F.col(probe_time).isNotNull()).select(
        *keys, F.col(probe_time).cast("double").alias("_t")).distinct()
    known = marks.where(F.col(mark_time).isNotNull()).groupBy(
        *keys, F.col(mark_time).cast("double").alias("_t")).agg(payload.alias("_mark"))
    return (
        known.withColumn("_probe", F.lit(False))
        .unionByName(asked.withColumn("_probe", F.lit(True)), allowMissingColumns=True)
    )


def around(probes: DataFrame, marks: DataFrame, keys, probe_time, mark_time, payload, width=None) -> DataFrame:
    """For each distinct probe time: the nearest mark at or before, and at or after.

    `payload` is the aggregate that settles several marks at one time. Returns
    keys, `_t`, `before`, `after` as struct(t, mark).
    """
    axis = _stack(probes, marks, keys, probe_time, mark_time, payload)
    point = F.when(~F.col("_probe"), F.struct(F.col("_t").alias("t"), F.col("_mark").alias("mark")))
    indexed = sorted_index(axis, [*keys, "_t", "_probe"])
    forward = scan(indexed, keys, "_seq", {"before": last_of(point)}, width=width)
    both = scan(forward, keys, "_seq", {"_later": last_of(point)}, width=width, reverse=True)
    same = F.when(F.col("before.t") == F.col("_t"), F.col("before"))
    return both.where("_probe").select(
        *keys, "_t", "before", F.coalesce(same, F.col("_later")).alias("after"))


def attach(left: DataFrame, lookup: DataFrame, keys, left_time) -> DataFrame:
    """Join a per-time lookup back to the rows that asked for it."""
    renamed = lookup.select(
        *[F.col(k).alias(f"_n{j}") for j, k in enumerate(keys)],
        F.col("_t").alias("_nt"),
        *[c for c in lookup.columns if c not in [*keys, "_t"]],
    )
    same_key = null_safe(left, renamed, [(k, f"_n{j}") for j, k in enumerate(keys)])
    on = left[left_time].cast("double") == renamed["_nt"]
    joined = left.join(renamed, on if same_key is None else same_key & on, "left")
    return joined.drop("_nt", *[f"_n{j}" for j in range(len(keys))])


def best_within(probes: DataFrame, marks: DataFrame, keys, probe_time, mark_time, rank, reach, width=None) -> DataFrame:
    """For each distinct probe time: the greatest `rank` struct among marks within +-reach.

    The interval [t - reach, t + reach] is the tail of one block of length
    `reach`, one full block and the head of the next, so three running maxima
    answer it and no pair of rows is ever formed.
    """
    known = marks.where(F.col(mark_time).isNotNull()).select(
        *keys, F.col(mark_time).cast("double").alias("_t"), rank.alias("_rank"))
    known = known.groupBy(*keys, "_t").agg(F.max("_rank").alias("_rank"))
    block = lambda t: F.floor(t / reach).cast("bigint")
    asked = probes.where(F.col(probe_time).isNotNull()).select(
        *keys, F.col(probe_time).cast("double").alias("_ask")).distinct()

    full = known.groupBy(*keys, block(F.col("_t")).alias("_b")).agg(F.max("_rank").alias("_whole"))
    mid = asked.withColumn("_b", block(F.col("_ask")))
    mid = mid.join(full, [*keys, "_b"], "left").select(*keys, "_ask", F.col("_whole").alias("_best"))

    def edge(offset, reverse):
        at = asked.withColumn("_t", F.col("_ask") + F.lit(offset))
        # The edge block follows from the probe's own block, so rounding of
        # t +- reach cannot put it one block off.
        step = -1 if reverse else 1
        at = at.withColumn("_b", block(F.col("_ask")) + step).withColumn("_probe", F.lit(not reverse))
        rows = known.withColumn("_b", block(F.col("_t"))).withColumn("_probe", F.lit(reverse))
        axis = rows.unionByName(at, allowMissingColumns=True)
        indexed = sorted_index(axis, [*keys, "_b", "_t", "_probe"])
        done = scan(indexed, [*keys, "_b"], "_seq", {"_best": max_of(F.col("_rank"))}, width=width, reverse=reverse)
        return done.where(F.col("_ask").isNotNull()).select(*keys, "_ask", "_best")

    pieces = mid.unionByName(edge(-reach, True)).unionByName(edge(reach, False))
    return pieces.groupBy(*keys, F.col("_ask").alias("_t")).agg(F.max("_best").alias("best"))


