"""Primitives against brute force, with chunks far smaller than the groups."""

import random

import pytest
from pyspark.sql import functions as F

from ringside.plans.folds import fold
from ringside.plans.nearest import around, attach, best_within
from ringside.plans.ordering import in_time_order, ranked, sorted_index
from ringside.plans.scan import count_of, first_of, last_of, max_of, min_of, scan, sum_of


def skewed_rows(seed, n=900):
    """Two thirds of the rows share one key; another key is NULL."""
    rnd = random.Random(seed)
    keys = ["hot"] * 8 + ["a", "b", None]
    return [(rnd.choice(keys), i, rnd.choice([None, rnd.randint(-5, 5)])) for i in range(n)]


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_scan_agrees_with_a_loop(spark, reverse, inclusive):
    rows = skewed_rows(1)
    df = spark.createDataFrame(rows, "k string, i long, v int")
    v = F.col("v")
    made = {"last": last_of, "first": first_of, "sum": sum_of, "max": max_of, "min": min_of}
    runs = {name: make(v, inclusive) for name, make in made.items()}
    runs["n"] = count_of(v.isNotNull(), inclusive)
    got = {r["i"]: r for r in scan(df, ["k"], "i", runs, width=7, reverse=reverse).collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        seen = []
        for _, i, value in sorted((r for r in rows if r[0] == key), key=lambda r: -r[1] if reverse else r[1]):
            upto = seen + [value] if inclusive else list(seen)
            known = [x for x in upto if x is not None]
            r = got[i]
            assert r["last"] == (known[-1] if known else None)
            assert r["first"] == (known[0] if known else None)
            assert r["sum"] == sum(known)
            assert r["max"] == (max(known) if known else None)
            assert r["min"] == (min(known) if known else None)
            assert r["n"] == len(known)
            seen.append(value)


def test_sorted_index_and_rank(spark):
    rows = skewed_rows(2, 500)
    df = spark.createDataFrame(rows, "k string, i long, v int")
    indexed = sorted_index(df, ["k", "v", "i"]).collect()
    order = lambda r: ((r["k"] is not None, r["k"] or ""), (r["v"] is not None, r["v"] or 0), r["i"])
    assert [r["i"] for r in sorted(indexed, key=lambda r: r["_seq"])] == [r["i"] for r in sorted(indexed, key=order)]
    for r in ranked(df, ["k"], ["v", "i"], width=5).collect():
        same = sorted((x for x in indexed if x["k"] == r["k"]), key=order)
        assert [x["i"] for x in same].index(r["i"]) + 1 == r["rank"]


def test_time_order_keeps_arrival_on_ties(spark):
    rows = [("u", "j", 1, i, t) for i, t in enumerate([5.0, 1.0, None, 1.0, 5.0])]
    df = spark.createDataFrame(rows, "user_id string, job_id string, match int, event_idx long, timestamp double")
    got = [r["event_idx"] for r in in_time_order(df).orderBy("time_idx").collect()]
    assert got == [2, 1, 3, 0, 4]


def test_fold_carries_state_over_chunks(spark):
    rows = skewed_rows(3, 300)
    df = spark.createDataFrame(rows, "k string, i long, v int").fillna(0, ["v"])

    def step(state, row):
        moved = F.when(F.abs(row["v"] - state) >= 3, row["v"]).otherwise(state)
        return F.struct(moved.alias("state"), moved.alias("out"))

    got = {r["i"]: r["out"] for r in fold(df, ["k"], "i", ["v"], F.lit(0), step, "int", "int", width=4).collect()}
    for key in {r[0] for r in rows}:
        state = 0
        for _, i, v in sorted(r for r in [(x[0], x[1], x[2] or 0) for x in rows if x[0] == key]) if key else [
                (x[0], x[1], x[2] or 0) for x in rows if x[0] is None]:
            state = v if abs(v - state) >= 3 else state
            assert got[i] == state


def test_nearest_and_best_within(spark):
    rnd = random.Random(4)
    marks = [("hot" if rnd.random() < .7 else "b", round(rnd.uniform(0, 60), 1), f"p{i}", i, rnd.random()) for i in range(200)]
    probes = [("hot" if rnd.random() < .7 else "b", rnd.choice([round(rnd.uniform(-5, 70), 1), 7.0]), i) for i in range(300)]
    m = spark.createDataFrame(marks, "k string, t double, path string, ord int, s double")
    p = spark.createDataFrame(probes, "k string, t double, id int")
    found = around(p, m, ["k"], "t", "t", F.min_by("path", "ord"), width=6)
    rows = {r["id"]: r for r in attach(p, found, ["k"], "t").collect()}
    best = best_within(p, m, ["k"], "t", "t", F.struct("s", "path"), 1.5, width=6)
    tops = {r["id"]: r for r in attach(p, best, ["k"], "t").collect()}
    for k, t, i in probes:
        mine = [x for x in marks if x[0] == k]
        before = [x[1] for x in mine if x[1] <= t]
        after = [x[1] for x in mine if x[1] >= t]
        assert (rows[i]["before"]["t"] if rows[i]["before"] else None) == (max(before) if before else None)
        assert (rows[i]["after"]["t"] if rows[i]["after"] else None) == (min(after) if after else None)
        near = [(x[4], x[2]) for x in mine if abs(x[1] - t) <= 1.5 + 1e-9]
        assert (tuple(tops[i]["best"]) if tops[i]["best"] else None) == (max(near) if near else None)


def test_scans_read_their_input_once(spark):
    """Running values and chunk totals share one exchange, also where a scan reads a scan and columns are dropped."""
    read = spark.sparkContext.accumulator(0)

    def row(i):
        read.add(1)
        return i % 3, i, i * 2

    df = spark.createDataFrame(spark.sparkContext.range(0, 1000, numSlices=4).map(row), "k long, i long, v long")
    for width in (50, None):
        for narrow in (True, False):
            before = read.value
            once = scan(df, ["k"], "i", {"n": count_of()}, width=width)
            twice = scan(once, ["k"], "i", {"s": sum_of(F.col("n"))}, width=width, reverse=True)
            out = (twice.select("s") if narrow else twice).collect()
            assert len(out) == 1000 and read.value - before == 1000
