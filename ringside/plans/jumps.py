"""Following pointers along a numbered table in a logarithmic number of rounds.

A rule such as "the next window starts at the first sample four seconds on" gives every row a successor, wherever the chain
that matters begins. Rows are cut into chunks of consecutive numbers; inside a chunk one expression finds where each
row's chain leaves the chunk. Only rows that a chain can enter a chunk at are joined, and their jumps double in
length each round. A last pass marks the reached rows inside each chunk. A chain of m chunks takes about log2(m) rounds, no
task holds more than a chunk, and no step depends on how rows are spread over groups.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.plans.ordering import materialise, sorted_index
from ringside.plans.scan import last_of, scan

JUMP_WIDTH = 1024


def reachable(nodes: DataFrame, width=None):
    """(numbers reached, rounds): the `at` of every node on a chain that begins at a root.

    `nodes` has at (unique, without gaps inside a chunk, as `sorted_index` gives), to (a larger `at`, or null at the end
    of a chain) and root.
    """
    width = int(width or JUMP_WIDTH)
    chunked = nodes.select("at", "to", "root", F.expr(f"at div {width}").alias("_chunk"))
    item = F.sort_array(F.collect_list(F.struct("at", "to", "root")))  # at most `width` rows
    chunks = chunked.groupBy("_chunk").agg(item.alias("_rows"))
    first, last = F.col("_rows")[0]["at"], F.col("_rows")[F.size("_rows") - 1]["at"]

    def twice(ways, _):
        return F.transform(ways, lambda to: F.when(to.isNull() | (to > last), to).otherwise(F.element_at(ways, (to - first + 1).cast("int"))))

    exits = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, (width - 1).bit_length()))), F.col("_rows.to"), twice)
    chunks = materialise(chunks.withColumn("_exit", exits))
    leaving = chunks.select(F.inline(F.arrays_zip(
        F.col("_rows.at").alias("at"), F.col("_rows.root").alias("root"), F.col("_exit").alias("to")))).where("to is not null")
    leaving = materialise(leaving)
    entries = leaving.select(F.col("to").alias("at")).distinct()
    # One table a round: the rows reached so far (`to` is null) and the jumps, twice as long as the round before.
    known = materialise(leaving.where("root").select(F.col("to").alias("at"), F.lit(None).cast("bigint").alias("to")).distinct().unionByName(
        leaving.join(entries, "at", "left_semi").select("at", "to")))
    rounds = 0
    while not known.where("to is not null").isEmpty():
        rounds += 1
        reached, jumps = known.where("to is null"), known.where("to is not null")
        onward = jumps.select(F.col("at").alias("to"), F.col("to").alias("_beyond"))
        more = reached.select("at").join(jumps, "at").select(F.col("to").alias("at"), F.lit(None).cast("bigint").alias("to"))
        known = materialise(reached.unionByName(more).distinct().unionByName(
            jumps.join(onward, "to").select("at", F.col("_beyond").alias("to"))))
    reached = known.select("at")

    entered = reached.groupBy(F.expr(f"at div {width}").alias("_chunk")).agg(F.collect_set("at").alias("_in"))
    none = F.array().cast("array<bigint>")
    begun = chunks.join(entered, "_chunk", "left").withColumn("_in", F.coalesce("_in", none))

    def walk(state, row):
        on = row["root"] | F.array_contains(F.col("_in"), row["at"]) | F.array_contains(state["ahead"], row["at"])
        ahead = F.filter(state["ahead"], lambda x: x > row["at"])
        ahead = F.when(on & row["to"].isNotNull(), F.array_union(ahead, F.array(row["to"]))).otherwise(ahead)
        return F.struct(ahead.alias("ahead"), F.when(on, F.concat(state["marked"], F.array(row["at"]))).otherwise(state["marked"]).alias("marked"))

    begin = F.struct(none.alias("ahead"), none.alias("marked"))
    marked = F.aggregate("_rows", begin, walk, lambda state: state["marked"])
    return begun.select(F.explode(marked).alias("at")), rounds


def first_beyond(rows: DataFrame, keys, number, time, gap, strict=False) -> DataFrame:
    """(at, to) for each row: `number` of the first row of its group whose time is at least (or, strict, more than) `gap` later.

    One running value over one time axis: probes stand before marks of the same time, or behind them where the gap must be passed.
    """
    mark, probe = (0, 1) if strict else (1, 0)
    at = F.col(time).cast("double")
    axis = rows.select(*keys, at.alias("_x"), F.lit(mark).alias("_kind"), F.col(number).alias("_no")).unionByName(
        rows.select(*keys, (at + F.lit(float(gap))).alias("_x"), F.lit(probe).alias("_kind"), F.col(number).alias("_no")))
    axis = sorted_index(axis, [*keys, "_x", "_kind", "_no"])
    found = scan(axis, keys, "_seq", {"to": last_of(F.when(F.col("_kind") == mark, F.col("_no")))}, reverse=True)
    return found.where(F.col("_kind") == probe).select(F.col("_no").alias("at"), "to")


def chained(rows: DataFrame, keys, time, gap, strict=False, width=None):
    """(rows on the chain, rounds): the first row of each group, then always the first one that far beyond.

    `rows` carries `_seq` of `sorted_index` over keys and time; the result has `_seq` only.
    """
    first = rows.groupBy(*keys).agg(F.min("_seq").alias("at")).select("at", F.lit(True).alias("root"))
    nodes = first_beyond(rows, keys, "_seq", time, gap, strict).join(first, "at", "left")
    marked, rounds = reachable(nodes.select("at", "to", F.coalesce("root", F.lit(False)).alias("root")), width)
    return marked.withColumnRenamed("at", "_seq"), rounds
