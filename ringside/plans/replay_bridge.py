"""Replay logs derived from the match bridge: every row becomes protocol lines of its match.

A bridge match has exactly 40 rows by construction, so its log fits one row.
"""

from pyspark.sql import functions as F

_SLOT = "(case when actor = 'opponent' then 'p2' else 'p1' end || case when k % 3 = 0 then 'a' else 'b' end || ': Nick' || cast(k % 4 as string))"

LINES = {
    "team_preview": (
        "'|player|p1|Alice' || cast(job_no as string) || '|\n|player|p2|Bob|\n|gametype|' || case when match_id % 5 = 0 then 'singles' else 'doubles' end || '\n|t:|1700000000\n' || "
        "array_join(transform(player_team, x -> '|poke|p1|' || x || ', L50, M|'), '\n') || '\n' || array_join(transform(opponent_team, x -> '|poke|p2|' || x || ', L50|'), '\n')"
    ),
    "field_state": (
        "case when k % 5 = 1 then '|-weather|RainDance\n' when k % 5 = 2 then '|-weather|none\n' else '' end || "
        "case when k % 7 = 0 then '|-fieldstart|move: Trick Room\n' when k % 7 = 1 then '|-fieldend|move: Trick Room\n' when k % 7 = 2 then '|-fieldstart|move: Grassy Terrain\n' "
        "when k % 7 = 3 then '|-fieldend|move: Grassy Terrain\n' when k % 7 = 4 then '|-fieldend|Misty Terrain\n' else '' end || "
        "case when k % 6 = 0 then '|-sidestart|p1: Alice|move: Tailwind\n' when k % 6 = 1 then '|-sideend|p1: Alice|move: Tailwind\n' when k % 6 = 2 then '|-sidestart|p2: Bob|Reflect\n' "
        "when k % 6 = 3 then '|-sidestart|p1: Alice|move: Aurora Veil\n' when k % 6 = 4 then '|-sideend|p2: Bob|Reflect\n' else '' end || '|t:|' || cast(1700000000 + pos * 5 as string) || '\n|turn|' || cast(floor(pos / 5) + 1 as string)"
    ),
    "pokemon_sent_out": f"case when k % 4 = 3 then '|replace|' else '|switch|' end || {_SLOT} || '|' || pokemon || ', L50|100/100'",
    "move_used": f"'|move|' || {_SLOT} || '|' || detail || '|p2a: X'",
    "pokemon_fainted": f"'|faint|' || {_SLOT}",
    "hp_change": f"case when k % 2 = 0 then '|-damage|' else '|-heal|' end || {_SLOT} || '|' || cast(k as string) || '/120 par' || case when k % 3 = 0 then '|[from] item: Leftovers' else '' end",
    "stat_change": f"case when k % 2 = 0 then '|-boost|' else '|-unboost|' end || {_SLOT} || '|spa|' || cast(k % 3 as string)",
    "status_inflicted": f"'|-status|' || {_SLOT} || '|' || detail",
    "terastallized": f"'|-terastallize|' || {_SLOT} || '|Fire'",
    "item_or_ability_activated": (
        f"case k % 5 when 0 then '|-item|' || {_SLOT} || '|Choice Scarf' when 1 then '|-enditem|' || {_SLOT} || '|Sitrus Berry' when 2 then '|-activate|' || {_SLOT} || '|item: Focus Sash' "
        f"when 3 then '|-ability|' || {_SLOT} || '|Intimidate' else '|-mega|' || {_SLOT} || '|Garchompite' end"
    ),
    "battle_end": "case when k < 45 then '|win|alice' || cast(job_no as string) when k < 90 then '|win|Bob' else '|tie' end",
}


def line_text():
    out = F
    for event, text in LINES.items():
        out = out.when(F.col("event") == event, F.expr(text))
    return out


def replays(events):
    """One log per bridge match; every third as JSON, every third inside a page, the rest bare."""
    rows = events.withColumn("line", line_text())
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    logs = rows.groupBy("user_id", "job_id", "match", "match_id", "job_no").agg(F.array_join(ordered, "\n").alias("log"))
    as_json = F.to_json(F.struct(F.lit("gen9").alias("format"), F.col("log")))
    page = F.concat(F.lit("<html><script type='application/json'>"), as_json, F.lit("</script></html>"))
    kind = F.col("match_id") % 3
    return logs.select(
        "user_id", "job_id", F.col("match").alias("ord"), F.concat_ws("/", "job_id", "match").alias("replay_id"),
        F.when(kind == 0, as_json).when(kind == 1, page).otherwise(F.col("log")).alias("raw"),
        F.when(F.col("match_id") % 4 == 0, F.lit("p2")).when(F.col("match_id") % 4 == 1, F.concat(F.lit("ALICE"), F.col("job_no")))
        .when(F.col("match_id") % 4 == 2, F.lit("bob")).otherwise(F.lit("nobody")).alias("player"), "match_id")
