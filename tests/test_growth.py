"""Steps whose time or memory must grow no faster than their input."""

import re

from pyspark.sql import functions as F

from ringside.functions import columns as c
from ringside.functions import fixed_values as fixed
from ringside.operators import clean, strategy, teams
from ringside.plans.ordering import materialise
from ringside.plans.scan import scan, sum_of


def test_weaknesses_evaluate_the_types_once_and_keep_every_multiplier(spark):
    plan = str(teams.weaknesses(F.col("the_types")))
    assert plan.count("the_types") == 1
    rows = [(["fire"],), (["water", "ground"],), (["steel", "flying"],), (["?", "ghost"],), ([None, "bug"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "types array<string>")
    one_by_one = F.filter(F.array(*[
        F.struct(F.lit(t).alias("type"), c.type_multiplier(F.lit(t), F.col("types")).alias("mult")) for t in fixed.TYPES]),
        lambda x: x["mult"] > 1)
    for row in df.select("types", teams.weaknesses(F.col("types")).alias("now"), one_by_one.alias("plain")).collect():
        assert row["now"] == row["plain"], row["types"]


def test_many_stored_keys_are_not_taken_for_a_table_small_enough_to_broadcast(spark, capsys):
    # 600,000 rows of keys that repeat: packed they take far less than the 10 MB up to which Spark broadcasts.
    keys = spark.range(600_000).select(
        F.concat(F.lit("u"), F.col("id") % 10).alias("user_id"), F.concat(F.lit("job-"), F.col("id").bitwiseAND(7)).alias("job_id"),
        (F.col("id") % 8).cast("int").alias("match"), (F.col("id") % 9).cast("int").alias("turn"))
    stored = materialise(keys)
    stored.join(stored.withColumnRenamed("turn", "since"), ["user_id", "job_id", "match"]).explain()
    assert "Broadcast" not in capsys.readouterr().out
    few = materialise(keys.limit(10))
    few.join(stored.withColumnRenamed("turn", "since"), ["user_id", "job_id", "match"]).explain()
    assert "Broadcast" in capsys.readouterr().out
    assert stored.count() == 600_000


def test_a_name_is_normalised_once_however_many_names_are_legal(spark):
    legal = [f"Species{i}" for i in range(40)] + ["Rotom", "Rotom-Wash"]
    plan = str(clean.species_base(F.col("the_name"), legal))
    assert plan.count("the_name") == 1
    df = spark.createDataFrame([("Rotom-Wash",), ("rotom heat",), ("Mew ",), ("",), (None,)], "name string")
    rows = df.select(clean.species_base(F.col("name"), legal), clean.is_banned(F.col("name"), legal)).collect()
    assert [tuple(r) for r in rows] == [("rotomwash", False), ("rotom", False), ("mew", True), ("", False), ("", None)]


def test_brought_lists_of_both_sides_come_from_one_reading_of_the_events(spark, tmp_path, capsys):
    none = "cast(null as array<string>)"
    rows = [("team_preview", "both", None, 0), ("pokemon_sent_out", "player", "Rotom", 1), ("pokemon_sent_out", "opponent", "Mew", 2),
            ("pokemon_sent_out", "opponent", "Gengar", 3), ("move_used", "player", "Snorlax", 4), ("pokemon_sent_out", "unknown", "Gengar", 5)]
    events = spark.createDataFrame(rows, "event string, actor string, pokemon string, event_idx long").selectExpr(
        "'u' as user_id", "'j' as job_id", "1 as match", "*", f"{none} as player_active", f"{none} as opponent_active")
    events.write.parquet(f"{tmp_path}/events")
    events = spark.read.parquet(f"{tmp_path}/events")
    teams_of = spark.sql("select 'u' as user_id, 'j' as job_id, m as match, array('Rotom', 'Snorlax') as player_team, array('Gengar') as opponent_team from values 1, 2 as t(m)")
    out = clean.derive_brought(events, teams_of, ["Rotom", "Gengar", "Snorlax"], bring=4, active=1)
    out.explain("formatted")
    assert len(re.findall(r"^\(\d+\) Scan parquet", capsys.readouterr().out, re.M)) == 1
    found = {r["match"]: (r["player_brought"], r["player_lead"], r["opponent_brought"], r["opponent_lead"]) for r in out.collect()}
    assert found == {1: (["Rotom", "Snorlax"], ["Rotom"], ["Gengar"], ["Gengar"]), 2: ([], [], [], [])}


def test_a_scan_moves_its_rows_once(spark, tmp_path, capsys):
    rows = [("a", i, i) for i in range(20)] + [(None, i, 1) for i in range(20)]
    spark.createDataFrame(rows, "k string, i long, v int").write.parquet(f"{tmp_path}/rows")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = scan(spark.read.parquet(f"{tmp_path}/rows"), ["k"], "i", {"s": sum_of(F.col("v"))}, width=5)
        out.explain()
        # The rows' own (planned for both readers, then shared) and two of the table with one row per chunk.
        assert capsys.readouterr().out.count("Exchange hashpartitioning") == 4
        found = {(r["k"], r["i"]): r["s"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert found == {("a", i): i * (i + 1) // 2 for i in range(20)} | {(None, i): i + 1 for i in range(20)}


def test_a_turn_adds_up_what_happens_in_it(spark):
    none = "cast(null as array<string>)"
    rows = [(0, "team_preview", "both", None, None, None, None), (1, "field_state", "both", None, None, None, 1),
            (2, "hp_change", "player", "Mew", None, 40.0, None), (3, "pokemon_fainted", "player", "Mew", None, 0.0, None),
            (4, "stat_change", "opponent", "Gengar", "Attack rose", None, None), (5, "field_state", "both", None, None, None, 3),
            (6, "hp_change", "opponent", "Gengar", None, 30.0, None), (7, "field_state", "both", None, None, None, 4)]
    events = spark.createDataFrame(rows, "event_idx long, event string, actor string, pokemon string, detail string, hp_percent double, turn int")
    teams_named = {"player_team": "array('Mew', 'Rotom')", "opponent_team": "array('Gengar')"}
    events = events.crossJoin(spark.createDataFrame([("u",), (None,)], "user_id string")).selectExpr(
        "*", "'j' as job_id", "1 as match", "'none' as tailwind", "false as trick_room", "'none' as weather", "'none' as terrain", "'none' as screens",
        *[f"{none} as {x}" for x in ("player_active", "opponent_active", "player_brought", "opponent_brought")],
        *[f"if(event = 'team_preview', {names}, null) as {x}" for x, names in teams_named.items()])
    found = strategy.strategy_of(events)
    got = {(r["user_id"], r["turn"]): (r["player_alive"], r["player_faints"], r["boosts"], r["player_hp"], r["opponent_hp"]) for r in found.timeline.collect()}
    # A match without a whole key has no turns; the faint counts from the next turn on.
    assert got == {("u", 1): (2, 1, 1, None, None), ("u", 3): (1, 0, 0, None, None), ("u", 4): (1, 0, 0, None, 30.0)}
