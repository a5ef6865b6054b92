"""Pointer doubling, tabulated folds and what is built on them, against loops and on one very long group."""

import math
import random

from pyspark.sql import functions as F

from ringside.operators import clean, replay, signals
from ringside.plans import folds
from ringside.plans.folds import fold
from ringside.plans.jumps import chained, first_beyond, reachable
from ringside.plans.ordering import sorted_index


def test_reachable_against_a_loop(spark):
    rnd = random.Random(1)
    nodes = [(i, min(i + rnd.randrange(1, 9), 499) if i < 499 and rnd.random() < .97 else None, rnd.random() < .02) for i in range(500)]
    want = set()
    for at, _, root in nodes:
        while root and at is not None and at not in want:
            want.add(at)
            at = nodes[at][1]
    for width in (1, 7, 64, 4096):
        got, rounds = reachable(spark.createDataFrame(nodes, "at long, to long, root boolean"), width)
        assert sorted(r["at"] for r in got.collect()) == sorted(want)
        assert rounds <= 2 + math.log2(500 / width + 1)
    got, rounds = reachable(spark.createDataFrame([], "at long, to long, root boolean"))
    assert got.collect() == [] and rounds == 0


def test_first_beyond(spark):
    rnd = random.Random(2)
    rows = [("a" if rnd.random() < .8 else None, rnd.randrange(40) / 2, i) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, t double, no long")
    for strict in (False, True):
        got = {r["at"]: r["to"] for r in first_beyond(df, ["k"], "no", "t", 3.0, strict).collect()}
        for k, t, no in rows:
            after = [(x[1], x[2]) for x in rows if x[0] == k and (x[1] - t > 3 if strict else x[1] - t >= 3)]
            assert got[no] == (min(after)[1] if after else None)


def test_a_million_samples_in_one_group(spark):
    """The chain has 200,000 links in one group; rounds grow with the logarithm of the chunks."""
    rows = sorted_index(spark.range(1_000_000).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("t")), ["k", "t"])
    got, rounds = chained(rows, ["k"], "t", 5.0)
    assert rounds <= 10
    kept = rows.join(got, "_seq", "left_semi").agg(F.count("*"), F.sum("t")).first()
    assert tuple(kept) == (200_000, 5.0 * 199_999 * 200_000 / 2)


def test_a_million_repeats_of_one_event(spark):
    """One key, two actors that read the same text every half second: the rows of each keep three seconds clear."""
    actor = F.when(F.col("id") % 3 == 0, "player").otherwise("opponent")
    events = spark.range(1_000_000).select(
        F.lit("u").alias("user_id"), F.lit("j").alias("job_id"), F.lit(1).alias("match"), F.col("id").alias("event_idx"), F.lit("move_used").alias("event"),
        F.lit("X").alias("pokemon"), F.lit("text").alias("detail"), (F.col("id") / 2).alias("timestamp"), actor.alias("actor"))
    got = {r["actor"]: r["n"] for r in clean.dedupe_anchored(events).groupBy("actor").agg(F.count("*").alias("n")).collect()}
    want = {}
    for name, ids in (("player", range(0, 1_000_000, 3)), ("opponent", (i for i in range(1_000_000) if i % 3))):
        last = None
        for i in ids:
            if last is None or i - last > 6:
                last, want[name] = i, want.get(name, 0) + 1
    assert got == want


def test_tabulated_fold(spark, monkeypatch):
    """A group with few states takes table and doubling, one with many goes chunk by chunk; both agree with a loop."""
    rnd = random.Random(3)
    rows = [(k, i, rnd.randrange(5) if k == "few" else rnd.randrange(50)) for k in ("few", "many", None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v int")

    def step(state, row):
        moved = F.when(row["v"] >= state, row["v"]).otherwise(state - 1)
        return F.struct(moved.alias("state"), moved.alias("out"))

    def states(long):
        few = long.where("k = 'few'").select("k", F.explode(F.sequence(F.lit(-1), F.lit(5))).alias("state"))
        return few

    seen = []
    entry_states = folds.entry_states
    monkeypatch.setattr(folds, "entry_states", lambda *a: seen.append(entry_states(*a)) or seen[-1])
    got = {(r["k"], r["i"]): r["out"] for r in fold(df, ["k"], "i", ["v"], F.lit(0), step, "int", "int", width=8, states=states).collect()}
    for k in ("few", "many", None):
        state = 0
        for i in range(400):
            v = next(r[2] for r in rows[i::400] if r[0] == k)
            state = v if v >= state else state - 1
            assert got[(k, i)] == state
    assert len(seen) == 1 and seen[0][1] <= 3


def test_disguises(spark):
    """Decoys on two slots of a side, one stay after another, and the same name without a disguise."""
    log = "\n".join([
        "|player|p1|A|", "|player|p2|B|", "|gametype|doubles", "|switch|p1a: X|Decoy, L50|100/100", "|switch|p1b: Y|Other, L50|100/100", "|move|p1a: X|One|p2a: Z",
        "|replace|p1a: X|Fox, L50|100/100", "|move|p1a: X|Two|p2a: Z", "|switch|p1a: X|Decoy, L50|100/100", "|move|p1a: X|Three|p2a: Z", "|switch|p1b: Y|Fox, L50|100/100",
        "|move|p1b: Y|Four|p2a: Z", "|replace|p1b: Y|Wolf, L50|100/100", "|move|p1b: Y|Five|p2a: Z", "|switch|p2a: Z|Decoy, L50|100/100", "|move|p2a: Z|Six|p1a: X",
        "|replace|p1a: X|Fox, L50|100/100", "|move|p1a: X|Seven|p2a: Z"])
    lines = replay.replay_lines(spark.createDataFrame([("r", log, None)], "replay_id string, raw string, player string"))
    slots = replay.active_slot(lines)
    moves = {r["detail"]: r["pokemon"] for r in replay.illusion_fix(replay.slot_events(slots), slots).where("event = 'move_used'").collect()}
    assert moves == {"One": "Fox", "Two": "Fox", "Three": "Fox", "Four": "Wolf", "Five": "Wolf", "Six": "Decoy", "Seven": "Fox"}


def test_windows_of_a_skewed_table(spark):
    rnd = random.Random(9)
    rows, t = [], 0.0
    for i in range(300):
        t += rnd.choice([0.0, 0.5, 2.0, 6.0])
        rows.append(("hot" if i % 5 else "b", t, float(i), 30.0))
    got = sorted((r["v"], r["start"]) for r in signals.activity_windows(spark.createDataFrame(rows, "v string, t double, motion double, brightness double"), ["v"], width=5).collect())
    want = []
    for v in ("hot", "b"):
        start = None
        for _, t, _, _ in (r for r in rows if r[0] == v):
            if start is None or t - start >= 4.0:
                start = t
                want.append((v, t))
    assert got == sorted(want)
