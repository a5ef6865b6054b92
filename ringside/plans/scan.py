"""Running values inside groups of any length.

A plain window sends a whole group to one task. Here a group is cut into
chunks of `width` consecutive order values, each chunk is scanned on its own,
and what earlier chunks leave behind is carried in from a table with one row
per chunk. Both read one exchange of the input, so scans over scans do not
multiply the work below them. The order column must be a non-negative integer with few rows per
value (an array position, a turn number, a `sorted_index`).
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCAN_WIDTH = 1 << 16


@dataclass(frozen=True)
class Run:
    kind: str
    value: Column
    inclusive: bool = True


def last_of(value, inclusive=True):
    """Latest non-null value."""
    return Run("last", value, inclusive)


def first_of(value, inclusive=True):
    """Earliest non-null value."""
    return Run("first", value, inclusive)


def sum_of(value, inclusive=True):
    return Run("sum", value, inclusive)


def count_of(condition=None, inclusive=True):
    value = F.lit(1) if condition is None else F.when(condition, 1).otherwise(0)
    return Run("sum", value.cast("bigint"), inclusive)


def max_of(value, inclusive=True):
    return Run("max", value, inclusive)


def min_of(value, inclusive=True):
    return Run("min", value, inclusive)


_WINDOWED = {
    "last": lambda v: F.last(v, ignorenulls=True),
    "first": lambda v: F.first(v, ignorenulls=True),
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
}

_COMBINED = {
    "last": lambda local, carried: F.coalesce(local, carried),
    "first": lambda local, carried: F.coalesce(carried, local),
    "sum": lambda local, carried: F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0)),
    "max": lambda local, carried: F.greatest(local, carried),
    "min": lambda local, carried: F.least(local, carried),
}


def _chunk_total(kind, value, order, reverse):
    """What one chunk leaves behind, as an aggregate with a map-side partial."""
    position = F.when(value.isNotNull(), F.col(order))
    latest, earliest = (F.min_by, F.max_by) if reverse else (F.max_by, F.min_by)
    if kind == "last":
        return latest(value, position)
    if kind == "first":
        return earliest(value, position)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def _hashable(kind) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def null_safe(left, right, pairs):
    """AND of null-safe equalities over (left name, right name) pairs."""
    condition = None
    for a, b in pairs:
        term = left[a].eqNullSafe(right[b])
        condition = term if condition is None else condition & term
    return condition


def scan(df: DataFrame, keys, order, runs, width=None, reverse=False) -> DataFrame:
    """Add one column per entry of `runs` (name -> Run), ordered by `order` inside `keys`."""
    width = width or SCAN_WIDTH
    keys = list(keys)
    names = list(runs)
    values = {f"_v{i}": runs[n].value for i, n in enumerate(names)}
    # Keys and chunk travel as one struct, which is never null though they may be; its hash comes first, as numbers sort faster than names.
    at = F.struct(*keys, F.expr(f"`{order}` div {int(width)}").alias("_chunk")).alias("_scan_at")
    chunked = df.select("*", at, *[v.alias(n) for n, v in values.items()]).withColumn("_scan_hash", F.xxhash64("_scan_at")).drop(*keys)

    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    # One exchange serves the running values, the totals and the join of both. It is shared only if both sides ask for the same
    # columns, so both depend on a hash of all of them, of which no bit is kept. That dependence must not be a join key: rows
    # would move again.
    place = ["_scan_hash", "_scan_at"]
    chunked = chunked.repartition(*place)
    whole = F.xxhash64(*chunked.columns).bitwiseAND(F.lit(0)) if _hashable(df.schema) else F.lit(0).cast("bigint")

    local_order = Window.partitionBy(*place).orderBy(direction(order))
    upto = local_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local_order.rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.withColumns({
        f"_l{i}": _WINDOWED[runs[n].kind](F.col(f"_v{i}")).over(upto if runs[n].inclusive else before)
        for i, n in enumerate(names)
    }).withColumn("_lw", whole)

    totals = chunked.groupBy(*place).agg(*[
        _chunk_total(runs[n].kind, F.col(f"_v{i}"), order, reverse).alias(f"_t{i}")
        for i, n in enumerate(names)
    ], F.max(whole).alias("_whole"))
    totals = totals.select("*", F.col("_scan_at._chunk"), *[F.col("_scan_at")[k].alias(f"_g{j}") for j, k in enumerate(keys)])
    by_chunk = Window.partitionBy(*[f"_g{j}" for j in range(len(keys))]).orderBy(direction("_chunk"))
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_seen", F.lag("_chunk").over(by_chunk))
    carried = carried.withColumns({
        f"_c{i}": _WINDOWED[runs[n].kind](F.col(f"_t{i}")).over(earlier) for i, n in enumerate(names)
    })
    carried = carried.where(F.col("_seen").isNotNull()).select(
        *[F.col(c).alias(f"_k{c}") for c in place], "_whole", *[f"_c{i}" for i in range(len(names))])

    same = (local["_scan_hash"] == carried["_k_scan_hash"]) & (local["_scan_at"] == carried["_k_scan_at"]) & (local["_lw"] <= carried["_whole"])
    joined = local.join(carried, same, "left")
    untouched = [c for c in df.columns if c not in runs]
    return joined.select(
        *[F.col("_scan_at")[c].alias(c) if c in keys else F.col(c) for c in untouched],
        *[_COMBINED[runs[n].kind](F.col(f"_l{i}"), F.col(f"_c{i}")).alias(n) for i, n in enumerate(names)],
    )
