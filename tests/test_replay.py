"""One hand-written log with exact expectations."""

import json

from ringside.operators import replay

LOG = """|player|p1|Ann|1
|player|p2|Bo|2
|gametype|doubles
|poke|p1|Garchomp, L50, M|
|poke|p1|Zoroark-Hisui, L50|
|poke|p1|Bisharp, L50|
|poke|p2|Snorlax, L50|
|poke|p2|Smeargle, L50|
|t:|1000
|switch|p1a: Chompy|Garchomp, L50, M|100/100
|switch|p1b: Foxy|Kingambit, L50|100/100
|switch|p2a: Lax|Snorlax, L50|100/100
|-weather|SunnyDay
|-fieldstart|move: Grassy Terrain
|-sidestart|p2: Bo|Reflect
|-sidestart|p1: Ann|move: Tailwind
|turn|1
|t:|1010
|move|p1b: Foxy|Night Slash|p2a: Lax
|-damage|p2a: Lax|50/100 par|[from] item: Sticky Barb
|replace|p1b: Foxy|Zoroark-Hisui, L50
|-boost|p1b: Foxy|atk|2
|-fieldend|Misty Terrain
|-unboost|p2a: Lax|spe|1
|-fieldend|move: Grassy Terrain
|turn|2
|t:|1025
|faint|p2a: Lax
|move|p2a: Lax|Struggle|p1a: Chompy
|-enditem|p1a: Chompy|Sitrus Berry
|win|ann"""


def parse(spark, raw, player="ann"):
    df = spark.createDataFrame([("r", 1, raw, player, "u", "j")], "replay_id string, ord int, raw string, player string, user_id string, job_id string")
    return df, replay.replay_lines(df)


def test_wrapping_of_the_log(spark):
    wrapped = [LOG, json.dumps({"format": "x", "log": LOG}), f"<html>{json.dumps({'log': LOG})}</html>", LOG.replace("\n", "\\n")]
    counts = {parse(spark, w)[1].count() for w in wrapped}
    assert counts == {31}
    assert parse(spark, "nothing here")[1].count() == 0


def test_events_of_the_log(spark):
    _, lines = parse(spark, LOG)
    rows = replay.replay_events(lines).orderBy("event_idx").collect()
    said = [(r["event"], r["actor"], r["pokemon"], r["detail"]) for r in rows]
    assert said == [
        ("pokemon_sent_out", "player", "Garchomp", "switched in"),
        ("pokemon_sent_out", "player", "Zoroark-Hisui", "switched in"),
        ("pokemon_sent_out", "opponent", "Snorlax", "switched in"),
        ("field_state", "both", None, "Turn 1"),
        ("move_used", "player", "Zoroark-Hisui", "Night Slash"),
        ("hp_change", "opponent", "Snorlax", "HP: 50/100 par"),
        ("item_or_ability_activated", "opponent", "Snorlax", "item: Sticky Barb (recoil)"),
        ("pokemon_sent_out", "player", "Zoroark-Hisui", "Illusion revealed (was disguised as Kingambit)"),
        ("stat_change", "player", "Zoroark-Hisui", "Attack sharply rose"),
        ("stat_change", "opponent", "Snorlax", "Speed fell"),
        ("field_state", "both", None, "Turn 2"),
        ("pokemon_fainted", "opponent", "Snorlax", "fainted"),
        ("move_used", "opponent", "Lax", "Struggle"),
        ("item_or_ability_activated", "player", "Garchomp", "item: Sitrus Berry (consumed)"),
    ]
    one, two = [r for r in rows if r["event"] == "field_state"]
    assert (one["weather"], one["terrain"], one["tailwind"], one["screens"]) == ("sun", "grassy", "player", "opponent Reflect")
    assert (two["terrain"], two["player_active"], two["opponent_active"]) == ("none", ["Garchomp", "Zoroark-Hisui"], ["Snorlax"])
    assert one["player_active"] == ["Garchomp", "Kingambit"]
    assert [r["timestamp"] for r in rows if r["event"] == "move_used"] == [10.0, 25.0]


def test_preview_result_and_numbering(spark):
    df, _ = parse(spark, LOG)
    second = df.withColumn("replay_id", df["job_id"]).withColumn("ord", df["ord"] + 4)
    rows = replay.import_replays(df.unionByName(second), ["Garchomp", "Zoroark", "Kingambit", "Snorlax"], start=3)
    previews = {r["match"]: r for r in rows.where("event = 'team_preview'").collect()}
    assert set(previews) == {3, 4}
    p = previews[3]
    assert p["player_team"] == ["Garchomp", "Zoroark-Hisui", "Kingambit"] and p["opponent_team"] == ["Snorlax"]
    assert p["illegal_species_detected"] == ["Smeargle"]
    assert p["player_brought"] == ["Garchomp", "Zoroark-Hisui", "Kingambit"] and p["player_lead"] == ["Garchomp", "Zoroark-Hisui"]
    end = rows.where("event = 'battle_end' and match = 3").first()
    assert (end["winner"], end["detail"], end["timestamp"]) == ("player", "ann won", 25.0)
