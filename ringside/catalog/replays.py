"""Queries over replay logs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ringside.catalog.cleaning import LEGAL
from ringside.catalog.registry import on_matches
from ringside.operators import replay as p
from ringside.plans.replay_bridge import replays

_SIDE = "CASE match_id % 4 WHEN 0 THEN 'p2' WHEN 2 THEN 'p2' ELSE 'p1' END"


def lines_of(ev):
    return p.replay_lines(replays(ev))


@on_matches("read_replays", "SELECT job_id || '/' || match AS replay_id, count(*) FILTER (WHERE event = 'move_used') AS moves FROM {ev} GROUP BY 1")
def read_replays(ev):
    """Moves counted in the extracted log text, whatever wraps it."""
    log = p.extract_log(F.col("raw"))
    return replays(ev).select("replay_id", F.size(F.regexp_extract_all(log, F.lit("(?m)^(\\|move\\|)"), F.lit(1))).cast("bigint").alias("moves"))


@on_matches("replay_lines", """SELECT job_id || '/' || match AS replay_id, count(*) FILTER (WHERE event = 'pokemon_fainted') AS faints, count(*) FILTER (WHERE event = 'field_state') AS turns,
  12::BIGINT AS pokes FROM {ev} GROUP BY 1""")
def replay_lines(ev):
    return lines_of(ev).groupBy("replay_id").agg(
        F.count_if(F.col("type") == "faint").alias("faints"), F.count_if(F.col("type") == "turn").alias("turns"),
        F.count_if(F.col("type") == "poke").alias("pokes"))


@on_matches("player_sides", f"SELECT job_id || '/' || match AS replay_id, {_SIDE} AS player_side, CASE WHEN match_id % 5 = 0 THEN 'singles' ELSE 'doubles' END AS gametype FROM {{ev}} WHERE pos = 0")
def player_sides(ev):
    return p.player_sides(lines_of(ev)).select("replay_id", "player_side", "gametype")


@on_matches("replay_clock", "SELECT job_id || '/' || match AS replay_id, (max(pos) FILTER (WHERE event = 'field_state') * 5.0)::DOUBLE AS seconds FROM {ev} GROUP BY 1")
def replay_clock(ev):
    return p.replay_clock(lines_of(ev)).groupBy("replay_id").agg(F.max_by("seconds", "line_no").alias("seconds"))


_ACT = """x AS (SELECT *, job_id || '/' || match rid, (CASE WHEN actor = 'opponent' THEN 'p2' ELSE 'p1' END) || (CASE WHEN k % 3 = 0 THEN 'a' ELSE 'b' END) slot FROM ev
  WHERE event NOT IN ('team_preview', 'battle_end', 'field_state')),
y AS (SELECT *, last_value(CASE WHEN event = 'pokemon_sent_out' THEN pokemon WHEN event = 'pokemon_fainted' THEN '' END IGNORE NULLS)
  OVER (PARTITION BY rid, slot ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) held FROM x)"""


@on_matches("active_slot", f"WITH {_ACT} SELECT rid AS replay_id, slot, detail AS move, nullif(held, '') AS before, 'Nick' || k % 4 AS nickname FROM y WHERE event = 'move_used'")
def active_slot(ev):
    rows = p.active_slot(lines_of(ev)).where("type = 'move'")
    return rows.select("replay_id", "slot", F.col("args")[1].alias("move"), "before", "nickname")


@on_matches("illusion_fix", f"""WITH {_ACT},
z AS (SELECT *, left(slot, 2) side, max(CASE WHEN event = 'pokemon_sent_out' THEN pos END) OVER (PARTITION BY rid, slot ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) since FROM y),
c AS (SELECT rid, side, since, pos AS "at", held decoy, pokemon "real" FROM z WHERE event = 'pokemon_sent_out' AND k % 4 = 3 AND held <> '' AND held <> pokemon AND since IS NOT NULL),
m AS (SELECT rid, side, pos, held AS name, row_number() OVER (PARTITION BY rid ORDER BY pos) n FROM z WHERE event = 'move_used' AND held <> ''),
j AS (SELECT m.rid, m.n, m.name, list(struct_pack("at" := c."at", decoy := c.decoy, "real" := c."real") ORDER BY c."at") FILTER (c."at" IS NOT NULL) q
  FROM m LEFT JOIN c ON m.rid = c.rid AND m.side = c.side AND c.since <= m.pos AND m.pos < c."at" GROUP BY ALL),
k1 AS (SELECT *, CASE WHEN q[1].decoy = name THEN q[1]."real" ELSE name END n1 FROM j)
SELECT rid AS replay_id, n::INT AS n, name AS shown, CASE WHEN q[2].decoy = n1 THEN q[2]."real" ELSE n1 END AS pokemon FROM k1""")
def illusion_fix(ev):
    """Every move with the species shown and the one behind it; most replace lines of the bridge end a decoy's stay."""
    slots = p.active_slot(lines_of(ev))
    shown = p.slot_events(slots)
    fixed = p.illusion_fix(shown, slots).where("event = 'move_used' and before is not null")
    upto = Window.partitionBy("replay_id").orderBy("line_no")  # a log of the bridge has 40 events
    return fixed.select("replay_id", F.row_number().over(upto).alias("n"), F.col("before").alias("shown"), "pokemon")


@on_matches("field_conditions", f"""WITH s AS (SELECT *, job_id || '/' || match rid, {_SIDE} ps FROM ev WHERE event = 'field_state'),
c AS (SELECT rid, ps, cast(floor(pos / 5) + 1 AS INT) turn,
  last_value(CASE k % 5 WHEN 1 THEN 'rain' WHEN 2 THEN 'none' END IGNORE NULLS) OVER w weather, last_value(CASE k % 7 WHEN 0 THEN true WHEN 1 THEN false END IGNORE NULLS) OVER w room,
  last_value(CASE k % 7 WHEN 2 THEN 'grassy' WHEN 3 THEN 'none' END IGNORE NULLS) OVER w terrain, last_value(CASE k % 6 WHEN 0 THEN true WHEN 1 THEN false END IGNORE NULLS) OVER w wind,
  last_value(CASE k % 6 WHEN 2 THEN true WHEN 4 THEN false END IGNORE NULLS) OVER w refl, last_value(CASE k % 6 WHEN 3 THEN true END IGNORE NULLS) OVER w veil
  FROM s WINDOW w AS (PARTITION BY rid ORDER BY pos))
SELECT rid AS replay_id, turn, coalesce(weather, 'none') AS weather, coalesce(terrain, 'none') AS terrain, coalesce(room, false) AS trick_room,
  CASE WHEN wind THEN CASE ps WHEN 'p1' THEN 'player' ELSE 'opponent' END ELSE 'none' END AS tailwind,
  coalesce(nullif(array_to_string(list_filter(CASE ps WHEN 'p1' THEN [CASE WHEN veil THEN 'player Aurora Veil' END, CASE WHEN refl THEN 'opponent Reflect' END]
    ELSE [CASE WHEN refl THEN 'player Reflect' END, CASE WHEN veil THEN 'opponent Aurora Veil' END] END, lambda q: q IS NOT NULL), ', '), ''), 'none') AS screens FROM c""")
def field_conditions(ev):
    lines = lines_of(ev)
    return p.field_conditions(lines, p.player_sides(lines)).drop("line_no", "player_active", "opponent_active")


@on_matches("replay_event_counts", """WITH x AS (SELECT job_id || '/' || match rid, event FROM ev WHERE event NOT IN ('team_preview', 'battle_end')
  UNION ALL SELECT job_id || '/' || match, 'item_or_ability_activated' FROM ev WHERE event = 'hp_change' AND k % 3 = 0)
SELECT rid AS replay_id, event, count(*) AS n FROM x GROUP BY 1, 2""")
def replay_event_counts(ev):
    return p.replay_events(lines_of(ev)).groupBy("replay_id", "event").agg(F.count("*").alias("n"))


@on_matches("replay_events")
def replay_events(ev):
    rows = p.replay_events(lines_of(ev))
    return rows.withColumns({x: F.array_join(x, ", ") for x in ("player_active", "opponent_active")})


@on_matches("import_replays", f"""SELECT user_id_text AS user_id, job_id, match, CASE WHEN k >= 90 THEN 'unknown' WHEN (k < 45) = ({_SIDE} = 'p1') THEN 'player' ELSE 'opponent' END AS winner FROM {{ev}} WHERE event = 'battle_end'""")
def import_replays(ev):
    rows = p.import_replays(replays(ev), LEGAL)
    return rows.where("event = 'battle_end'").select("user_id", "job_id", "match", "winner")


@on_matches("replay_previews")
def replay_previews(ev):
    lines = lines_of(ev)
    sides = p.player_sides(lines)
    rows = p.preview_and_result(lines, p.replay_events(lines, sides), sides, LEGAL).where("event = 'team_preview'")
    lists = ("player_team", "opponent_team", "player_brought", "opponent_brought", "player_lead", "opponent_lead", "illegal_species_detected")
    return rows.select("replay_id", *[F.array_join(x, ", ").alias(x) for x in lists])
