"""Order-dependent folds over groups of any length.

Rows of a group are numbered and cut into chunks of at most `width` rows, so no task ever holds more of a group; groups
shorter than one chunk take a single pass. What a chunk does to the state is a function, and functions compose: where a
group's states can be listed, each chunk of a longer group is tabulated over them, all chunks at once, and the
state before each chunk follows by pointer doubling in a logarithmic number of rounds. Where they cannot, chunks run one
after the other with the state left by the one before. Callers first split groups at points where the state is known.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.plans.jumps import reachable
from ringside.plans.ordering import materialise, sorted_index
from ringside.plans.scan import count_of, null_safe, scan

FOLD_WIDTH = 1024


def _folder(order, step, state_type, out_type):
    """Columns of `_rows` and a first state to struct(state, out)."""
    def over(rows, state):
        seed = F.struct(state.cast(state_type).alias("state"), F.array().cast(f"array<{out_type}>").alias("out"))

        def advance(acc, row):
            moved = step(acc["state"], row)
            return F.struct(
                moved["state"].cast(state_type).alias("state"),
                F.concat(acc["out"], F.array(moved["out"].cast(out_type))).alias("out"),
            )

        return F.aggregate(rows, seed, advance)

    return over


def _named(df, keys, prefix):
    return [F.col(k).alias(f"{prefix}{j}") for j, k in enumerate(keys)]


def entry_states(chunks: DataFrame, keys, states: DataFrame, start, over, state_type):
    """(keys as _e0.., _part, state before the chunk) for every chunk after the first, and the rounds taken.

    A chunk is tabulated: from each state its group may have to the state it leaves. (chunk, state) pairs then point to pairs of the
    next chunk, and the chain from the first chunk's start state is followed by doubling.
    """
    names = [f"_s{j}" for j in range(len(keys))]
    s = states.select(*_named(states, keys, "_s"), F.col("state").cast(state_type).alias("_from")).distinct()
    begin = chunks.where("_part = 0").select(*_named(chunks, keys, "_s"), start.cast(state_type).alias("_from"))
    s = materialise(s.unionByName(begin).distinct())
    table = chunks.join(s, null_safe(chunks, s, list(zip(keys, names, strict=True))))
    first = (F.col("_part") == 0) & F.col("_from").eqNullSafe(start.cast(state_type))
    table = table.select(*names, "_part", "_from", over(F.col("_rows"), F.col("_from"))["state"].alias("_to"), first.alias("root"))
    table = sorted_index(table, [*names, "_part", "_from"])
    ahead = table.select(*[F.col(n).alias(f"_t{j}") for j, n in enumerate(names)], (F.col("_part") - 1).alias("_tp"), F.col("_from").alias("_tf"), F.col("_seq").alias("to"))
    pairs = [*((n, f"_t{j}") for j, n in enumerate(names)), ("_part", "_tp"), ("_to", "_tf")]
    nodes = table.join(ahead, null_safe(table, ahead, pairs), "left").select(F.col("_seq").alias("at"), "to", "root")
    marked, rounds = reachable(nodes)
    held = table.join(marked.withColumnRenamed("at", "_seq"), "_seq", "left_semi").where("_part > 0")
    return held.select(*[F.col(n).alias(f"_e{j}") for j, n in enumerate(names)], F.col("_part").alias("_ep"), F.col("_from").alias("_carried")), rounds


def fold(df: DataFrame, keys, order, payload, start, step, state_type, out_type, width=None, states=None) -> DataFrame:
    """Fold rows in order; returns keys, `order` and `out`, one row per input row.

    `payload` is a list of columns kept for the step. `start` is the state
    before the first row. `step(state, row)` returns struct(state, out).
    `states(long)`, if given, lists (keys, state): all states of those groups longer than a chunk that have few. They take
    a logarithmic number of rounds; groups not listed hand their state from chunk to chunk.
    """
    width = width or FOLD_WIDTH
    keys = list(keys)
    over = _folder(order, step, state_type, out_type)
    numbered = scan(df.select(*keys, order, *payload), keys, order, {"_n": count_of()})
    numbered = materialise(numbered.withColumn("_part", F.expr(f"(_n - 1) div {int(width)}")))
    last_part = numbered.agg(F.max("_part")).first()[0] or 0
    item = F.struct(order, *payload)
    chunk = F.sort_array(F.collect_list(item)).alias("_rows")
    results = []
    rest = numbered
    if last_part and states is not None:
        long = numbered.where("_part > 0").select(*_named(numbered, keys, "_g")).distinct()
        of_long = numbered.join(long, null_safe(numbered, long, [(k, f"_g{j}") for j, k in enumerate(keys)]), "left_semi")
        may = materialise(states(of_long).select(*keys, F.col("state").cast(state_type).alias("state")).distinct())
        few = materialise(may.select(*_named(may, keys, "_g")).distinct())
        tabled = lambda rows, how: rows.join(few, null_safe(rows, few, [(k, f"_g{j}") for j, k in enumerate(keys)]), how)
        chunks = materialise(tabled(numbered, "left_semi").groupBy(*keys, "_part").agg(chunk))
        entry, _ = entry_states(chunks, keys, tabled(may, "left_semi"), start, over, state_type)
        held = chunks.join(entry, null_safe(chunks, entry, [*((k, f"_e{j}") for j, k in enumerate(keys)), ("_part", "_ep")]), "left")
        state = F.when(F.col("_part") == 0, start.cast(state_type)).otherwise(F.col("_carried"))
        results.append(_unrolled(held.withColumn("_acc", over(F.col("_rows"), state)), keys, order))
        rest = materialise(tabled(numbered, "left_anti"))
        last_part = rest.agg(F.max("_part")).first()[0] or 0

    carried = None
    for part in range(last_part + 1):
        grouped = rest.where(F.col("_part") == part).groupBy(*keys).agg(chunk)
        state = start.cast(state_type)
        if carried is not None:
            grouped = grouped.join(
                carried, null_safe(grouped, carried, [(k, f"_p{j}") for j, k in enumerate(keys)]), "left")
            state = F.coalesce(F.col("_carried"), state)
        folded = grouped.withColumn("_acc", over(F.col("_rows"), state))
        if last_part:
            folded = materialise(folded.select(*keys, "_rows", "_acc"))
            carried = folded.select(*_named(folded, keys, "_p"), F.col("_acc.state").alias("_carried"))
        results.append(_unrolled(folded, keys, order))
    return reduce(DataFrame.unionByName, results)


def _unrolled(folded, keys, order):
    zipped = F.arrays_zip(F.col(f"_rows.{order}").alias("o"), F.col("_acc.out").alias("v"))
    return folded.select(*keys, F.explode(zipped).alias("_z")).select(*keys, F.col("_z.o").alias(order), F.col("_z.v").alias("out"))
