"""Queries over turns."""

from pyspark.sql import functions as F

from ringside.catalog.registry import on_matches
from ringside.catalog.snippets import names
from ringside.contracts import KEY
from ringside.operators import turns as t

# Turn at each event, and the turns of a match.
TAG = """
tg AS (SELECT *, user_id_text u, last_value(CASE WHEN event = 'field_state' THEN turn END IGNORE NULLS)
  OVER (PARTITION BY job_id, match ORDER BY event_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) tn FROM ev),
grid AS (SELECT DISTINCT u, job_id, match, tn FROM tg WHERE event = 'field_state' AND tn IS NOT NULL),
act AS (SELECT u, job_id, match, tn, actor side, event_idx, pokemon,
  CASE event WHEN 'pokemon_sent_out' THEN 'switch' WHEN 'move_used' THEN 'move' ELSE 'fainted' END ty,
  CASE WHEN event = 'move_used' THEN trim(regexp_replace(detail, '\\s*\\(failed\\)\\s*$', '')) END mv
  FROM tg WHERE event IN ('pokemon_sent_out', 'move_used', 'pokemon_fainted') AND actor IN ('player', 'opponent') AND tn IS NOT NULL)
"""


def key_sql(s):
    out = f"lower(regexp_replace({s}, '\\(.*?\\)', '', 'g'))"
    for pattern in ["^mega\\s+", "[\\s\\-]mega[\\s\\-][xy]$", "[\\s\\-]mega$",
                    "^(alolan|alola|galarian|galar|hisuian|hisui|paldean|paldea)\\s+",
                    "[\\s\\-](alolan|alola|galarian|galar|hisuian|hisui|paldean|paldea)$"]:
        out = f"regexp_replace({out}, '{pattern}', '')"
    return f"regexp_replace({out}, '[^a-z0-9]', '', 'g')"


SLOTS = TAG + f""",
sl AS (SELECT u, job_id, match, side, unnest(ns) pokemon, generate_subscripts(ns, 1) - 1 slot FROM (
  SELECT u, job_id, match, 'player' side, CASE WHEN player_brought <> '' THEN {names('player_brought')} ELSE {names('player_team')} END ns FROM tg WHERE event = 'team_preview'
  UNION ALL SELECT u, job_id, match, 'opponent', CASE WHEN opponent_brought <> '' THEN {names('opponent_brought')} ELSE {names('opponent_team')} END FROM tg WHERE event = 'team_preview')),
fl AS (SELECT job_id, match, side, {key_sql('pokemon')} sk, min(tn) ft FROM act WHERE ty = 'fainted' GROUP BY ALL),
slots AS (SELECT sl.*, {key_sql('sl.pokemon')} sk, fl.ft FROM sl LEFT JOIN fl ON fl.job_id = sl.job_id AND fl.match = sl.match AND fl.side = sl.side AND fl.sk = {key_sql('sl.pokemon')}),
av AS (SELECT g.u, g.job_id, g.match, g.tn, s.side, s.slot, s.pokemon, s.sk FROM grid g JOIN slots s USING (job_id, match) WHERE s.ft IS NULL OR s.ft >= g.tn),
cond AS (SELECT job_id, match, turn tn, arg_max({{'tailwind': tailwind, 'trick_room': trick_room, 'weather': weather, 'terrain': terrain, 'screens': screens}}, event_idx) c
  FROM ev WHERE event = 'field_state' AND turn IS NOT NULL GROUP BY ALL)
"""
K = "u AS user_id, job_id, match"


@on_matches("forward_fill_turn", "WITH " + TAG + f" SELECT {K}, event_idx, tn AS turn_now FROM tg")
def forward_fill_turn(ev):
    return t.forward_fill_turn(ev).select(*KEY, "event_idx", "turn_now")


@on_matches("turn_actions", "WITH " + TAG + f" SELECT {K}, tn AS turn, side, event_idx AS seq, ty AS type, pokemon, mv AS move_name FROM act")
def turn_actions(ev):
    return t.turn_actions(t.turns_of(ev))


@on_matches("turn_conditions", "WITH " + SLOTS + """ SELECT x.user_id, job_id, match, tn AS turn, c.tailwind AS tailwind,
  c.trick_room AS trick_room, c.weather AS weather, c.terrain AS terrain, c.screens AS screens
  FROM cond JOIN (SELECT DISTINCT user_id_text user_id, job_id FROM ev) x USING (job_id)""")
def turn_conditions(ev):
    return t.turn_conditions(t.turns_of(ev))


@on_matches("available", "WITH " + SLOTS + f" SELECT {K}, tn AS turn, side, cast(slot AS INT) AS slot, pokemon FROM av")
def available(ev):
    return t.available(t.turns_of(ev)).drop("species")


@on_matches("hp_at_start", "WITH " + SLOTS + f""",
hp AS (SELECT job_id, match, actor side, {key_sql('pokemon')} sk, tn, event_idx, hp_percent FROM tg
  WHERE event = 'hp_change' AND hp_percent IS NOT NULL AND tn IS NOT NULL AND actor IN ('player', 'opponent'))
SELECT {K}, tn AS turn, side, cast(slot AS INT) AS slot, pokemon,
  (SELECT arg_max(h.hp_percent, (h.tn, h.event_idx)) FROM hp h WHERE h.job_id = av.job_id AND h.match = av.match AND h.side = av.side AND h.sk = av.sk AND h.tn < av.tn) AS known_hp
FROM av""")
def hp_at_start(ev):
    return t.hp_at_start(t.turns_of(ev)).drop("species")


@on_matches("speed_tools", "WITH " + TAG + """, x AS (SELECT u, job_id, match, actor side, pokemon, trim(regexp_extract(detail, '(?i)^(ability|item):\\s*(.+)$', 2)) tool, tn
  FROM tg WHERE event = 'item_or_ability_activated' AND actor IN ('player', 'opponent') AND tn IS NOT NULL)
SELECT u AS user_id, job_id, match, side, pokemon, tool, min(tn) AS turn FROM x
WHERE lower(tool) IN ('choice scarf', 'booster energy', 'swift swim') GROUP BY ALL""")
def speed_tools(ev):
    return t.speed_tools(t.turns_of(ev))


@on_matches("first_reveals", "WITH " + TAG + """ SELECT u AS user_id, job_id, match, side, pokemon, mv AS move_name, min((tn, event_idx))[1] AS turn
FROM act WHERE ty = 'move' AND mv <> '' GROUP BY u, job_id, match, side, pokemon, mv""")
def first_reveals(ev):
    rows = t.first_reveals(t.turns_of(ev))
    return rows.withColumn("turn", F.col("first.turn")).drop("first")


@on_matches("stat_changes", "WITH " + TAG + """ SELECT u AS user_id, job_id, match, tn AS turn, actor AS side, event_idx AS seq, pokemon,
  regexp_extract(detail, '^(Attack|Defense|Sp\\. Atk|Sp\\. Def|Speed)', 1) AS stat, CASE WHEN detail LIKE '%rose' THEN 1 ELSE -1 END AS direction
FROM tg WHERE event = 'stat_change' AND tn IS NOT NULL AND actor IN ('player', 'opponent')
  AND regexp_matches(detail, '^(Attack|Defense|Sp\\. Atk|Sp\\. Def|Speed) (sharply rose|harshly fell|rose|fell)$')""")
def stat_changes(ev):
    return t.stat_changes(t.turns_of(ev))


@on_matches("turn_faints", "WITH " + TAG + f" SELECT {K}, tn AS turn, side, event_idx AS seq, pokemon FROM act WHERE ty = 'fainted'")
def turn_faints(ev):
    return t.turn_faints(t.turns_of(ev))


@on_matches("trick_room_setters", """SELECT DISTINCT user_id_text AS user_id, job_id, match, actor AS side FROM {ev}
WHERE event = 'move_used' AND detail IN ('Trick Room', 'Trick Room (failed)') AND actor IN ('player', 'opponent')""")
def trick_room_setters(ev):
    return t.trick_room_setters(t.turns_of(ev))


# Board by recursion over turn numbers: an independent statement of the carry and cap rule.
BOARD = SLOTS + f""",
upd AS (SELECT job_id, match, tn, 'player' side, arg_max(player_active, event_idx) a FROM tg WHERE event = 'field_state' AND tn IS NOT NULL AND player_active <> '' GROUP BY ALL
  UNION ALL SELECT job_id, match, tn, 'opponent', arg_max(opponent_active, event_idx) FROM tg WHERE event = 'field_state' AND tn IS NOT NULL AND opponent_active <> '' GROUP BY ALL),
arr AS (SELECT job_id, match, tn, side, list(pokemon ORDER BY event_idx) ns FROM act WHERE ty = 'switch' GROUP BY ALL),
fnt AS (SELECT job_id, match, side, list(struct_pack(n := pokemon, t := tn)) fs FROM (SELECT job_id, match, side, pokemon, min(tn) tn FROM act WHERE ty = 'fainted' GROUP BY ALL) GROUP BY ALL),
gs AS (SELECT g.u, g.job_id, g.match, s.side, g.tn, row_number() OVER (PARTITION BY g.job_id, g.match, s.side ORDER BY g.tn) rn,
    CASE WHEN upd.a IS NOT NULL THEN string_split(upd.a, ', ') END up, coalesce(arr.ns, []) ns, coalesce(fnt.fs, []) fs
  FROM grid g CROSS JOIN (VALUES ('player'), ('opponent')) s(side)
  LEFT JOIN upd ON upd.job_id = g.job_id AND upd.match = g.match AND upd.tn = g.tn AND upd.side = s.side
  LEFT JOIN arr ON arr.job_id = g.job_id AND arr.match = g.match AND arr.tn = g.tn AND arr.side = s.side
  LEFT JOIN fnt ON fnt.job_id = g.job_id AND fnt.match = g.match AND fnt.side = s.side),
st AS (
  SELECT job_id, match, side, 0::BIGINT rn, []::VARCHAR[] now, []::VARCHAR[] after FROM gs WHERE rn = 1
  UNION ALL
  SELECT job_id, match, side, rn, now, CASE WHEN len(ext) <= 2 THEN ext ELSE list_slice(kept, greatest(1, len(kept) - 1), len(kept)) END FROM (
    SELECT *, list_filter(ext, lambda x: NOT list_contains(list_slice(gone, 1, len(ext) - 2), x)) kept FROM (
      SELECT *, list_filter(ext, lambda x: len(list_filter(fs, lambda y: y.n = x AND y.t <= tn)) > 0) gone FROM (
        SELECT g.job_id, g.match, g.side, g.rn, g.tn, g.fs, coalesce(g.up, st.after) now,
          list_concat(coalesce(g.up, st.after), list_filter(g.ns, lambda x, i: NOT list_contains(coalesce(g.up, st.after), x)
            AND list_position(g.ns, x) = i)) ext
        FROM st JOIN gs g ON g.job_id = st.job_id AND g.match = st.match AND g.side = st.side AND g.rn = st.rn + 1)))),
bd AS (SELECT gs.u, gs.job_id, gs.match, gs.tn, gs.side, st.now board FROM gs JOIN st USING (job_id, match, side, rn)),
km AS (SELECT b.u, b.job_id, b.match, b.tn, b.side, f.pokemon, f.mv, f.f seq FROM
  (SELECT DISTINCT u, job_id, match, tn, side, unnest(board) pokemon FROM bd) b
  JOIN (SELECT job_id, match, side, pokemon, mv, min((tn, event_idx))[1] ft, min((tn, event_idx))[2] f FROM act WHERE ty = 'move' AND mv <> '' GROUP BY job_id, match, side, pokemon, mv) f
  ON f.job_id = b.job_id AND f.match = b.match AND f.side = b.side AND f.pokemon = b.pokemon AND f.ft < b.tn)
"""


@on_matches("board", "WITH RECURSIVE " + BOARD + f" SELECT {K}, side, tn AS turn, array_to_string(board, ', ') AS board FROM bd")
def board(ev):
    rows = t.board(t.turns_of(ev))
    return rows.withColumn("board", F.array_join("board", ", "))


@on_matches("known_moves", "WITH RECURSIVE " + BOARD + f" SELECT {K}, tn AS turn, side, pokemon, mv AS move_name, seq FROM km")
def known_moves(ev):
    return t.known_moves(t.turns_of(ev))


@on_matches("decision_windows", "WITH RECURSIVE " + BOARD + f""",
al AS (SELECT job_id, match, tn, side, list(pokemon ORDER BY slot) a FROM av GROUP BY ALL),
ch AS (SELECT job_id, match, tn, side, count(*) FILTER (WHERE ty = 'move') moves, count(*) FILTER (WHERE ty = 'switch') switches,
  string_agg(ty || ':' || pokemon || ':' || coalesce(mv, ''), ', ' ORDER BY event_idx) did FROM act WHERE ty <> 'fainted' GROUP BY ALL),
ks AS (SELECT job_id, match, tn, side, pokemon, string_agg(mv, '/' ORDER BY seq) ms FROM km GROUP BY ALL),
bp AS (SELECT job_id, match, tn, side, unnest(board) p, generate_subscripts(board, 1) place FROM bd),
kb AS (SELECT bp.job_id, bp.match, bp.tn, bp.side, string_agg(p || ': ' || coalesce(ms, ''), '; ' ORDER BY place) known
  FROM bp LEFT JOIN ks ON ks.job_id = bp.job_id AND ks.match = bp.match AND ks.tn = bp.tn AND ks.side = bp.side AND ks.pokemon = bp.p GROUP BY ALL)
SELECT {K}, tn AS turn, side, array_to_string(board, ', ') AS board, coalesce(array_to_string(a, ', '), '') AS available,
  coalesce(array_to_string(list_filter(a, lambda x: NOT list_contains(board, x)), ', '), '') AS switch_options,
  coalesce(moves, 0) AS moves, coalesce(switches, 0) AS switches, coalesce(did, '') AS chosen_actions, coalesce(known, '') AS known_moves
FROM bd LEFT JOIN al USING (job_id, match, tn, side) LEFT JOIN ch USING (job_id, match, tn, side) LEFT JOIN kb USING (job_id, match, tn, side)""")
def decision_windows(ev):
    rows = t.decision_windows(t.turns_of(ev))
    did = F.transform("chosen_actions", lambda x: F.concat(x["type"], F.lit(":"), x["pokemon"], F.lit(":"), F.coalesce(x["move"], F.lit(""))))
    known = F.transform("known_moves", lambda x: F.concat(x["pokemon"], F.lit(": "), F.array_join(x["moves"], "/")))
    rows = rows.withColumns({"chosen_actions": F.array_join(did, ", "), "known_moves": F.array_join(known, "; ")})
    return rows.withColumns({x: F.array_join(x, ", ") for x in ("board", "available", "switch_options")})
