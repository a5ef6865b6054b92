"""Queries over review queues and timelines."""

from pyspark.sql import functions as F

from ringside.catalog.registry import on_matches
from ringside.catalog.snippets import names
from ringside.catalog.strategy import TL
from ringside.contracts import KEY
from ringside.operators import review as v
from ringside.operators import strategy

KS = "user_id_text AS user_id, job_id, match"
NEED = "NOT coalesce(corrected, false) AND (confidence < 0.9 OR coalesce(roster_conflict, false))"
IDENT = "event <> 'team_preview' AND pokemon IS NOT NULL AND actor <> ''"


@on_matches("needs_clarification", f"SELECT event_id FROM {{ev}} WHERE {NEED}")
def needs_clarification(ev):
    return ev.where(v.needs_clarification()).select("event_id")


@on_matches("clarification_events", f"SELECT {KS}, CASE WHEN actor = 'opponent' THEN 'opponent' ELSE 'player' END AS side, pokemon AS guess, event_idx FROM {{ev}} WHERE {IDENT} AND {NEED}")
def clarification_events(ev):
    return v.clarification_events(ev).drop("confidence")


QUEUE = f"""
s AS (SELECT *, user_id_text u, CASE WHEN actor = 'opponent' THEN 'opponent' ELSE 'player' END side FROM ev WHERE {IDENT}),
d AS (SELECT u, job_id, match, side, pokemon, count(*) n, min(confidence) mc, arg_min(reference_frame, event_idx) FILTER (WHERE reference_frame IS NOT NULL) f,
  min(event_idx) FILTER (WHERE reference_frame IS NOT NULL) fi FROM s WHERE {NEED} GROUP BY u, job_id, match, side, pokemon),
b AS (SELECT job_id, match, side, pokemon, arg_min(reference_frame, event_idx) bf, min(event_idx) bi FROM s WHERE reference_frame IS NOT NULL GROUP BY ALL),
cf AS (SELECT job_id, match, side, pokemon, list(c ORDER BY ai) cs FROM (SELECT job_id, match, side, pokemon, roster_conflict_species c, min(event_idx) ai FROM s WHERE {NEED} AND roster_conflict_species <> '' GROUP BY ALL) GROUP BY ALL),
tp AS (SELECT job_id, match, {names('player_brought')} pb, {names('opponent_brought')} ob, reference_frame tf FROM ev WHERE event = 'team_preview'),
q AS (SELECT d.*, coalesce(f, bf) own, coalesce(fi, bi) own_i, coalesce(f, bf, tf) fr, list_concat([d.pokemon], coalesce(cs, []), CASE d.side WHEN 'player' THEN pb ELSE ob END) cand
  FROM d LEFT JOIN b USING (job_id, match, side, pokemon) LEFT JOIN cf USING (job_id, match, side, pokemon) LEFT JOIN tp USING (job_id, match) WHERE coalesce(f, bf, tf) IS NOT NULL)"""


@on_matches("clarification_queue", f"""WITH {QUEUE} SELECT u AS user_id, job_id, match, side, pokemon AS guess, n AS count, mc AS min_confidence, fr AS reference_frame, own_i AS reference_frame_idx, own IS NULL AS is_preview_fallback,
  array_to_string(list_filter(cand, lambda x, i: list_position(cand, x) = i), ', ') AS candidates FROM q""")
def clarification_queue(ev):
    return v.clarification_queue(ev).withColumn("candidates", F.array_join("candidates", ", ")).drop("shows_subject")


_WIN = """ends AS (SELECT job_id, match, count(*) n, bool_or(winner IN ('player', 'opponent')) kn FROM ev WHERE event = 'battle_end' GROUP BY ALL),
win AS (SELECT e.user_id_text u, e.job_id, e.match, n, arg_max(e.reference_frame, (e.timestamp, e.event_idx)) f FROM ev e JOIN ends USING (job_id, match) WHERE NOT kn AND e.event <> 'team_preview' AND e.reference_frame IS NOT NULL GROUP BY ALL)"""


@on_matches("winner_clarifications", f"WITH {_WIN} SELECT u AS user_id, job_id, match, n AS ends, f AS reference_frame FROM win")
def winner_clarifications(ev):
    return v.winner_clarifications(ev).select(*KEY, "ends", "reference_frame")


_GEN = f"gen AS (SELECT user_id_text u, * FROM ev WHERE event NOT IN ('team_preview', 'battle_end') AND {NEED} AND NOT ({IDENT}) AND reference_frame IS NOT NULL)"


@on_matches("generic_clarifications", f"WITH {_GEN} SELECT u AS user_id, job_id, match, event_idx, event, actor, timestamp, detail, confidence, reference_frame FROM gen")
def generic_clarifications(ev):
    return v.generic_clarifications(ev).drop("reference_frame_shows_subject")


@on_matches("open_questions", f"""WITH {QUEUE}, {_WIN}, {_GEN}, x AS (SELECT u, job_id, match FROM q UNION ALL SELECT u, job_id, match FROM win UNION ALL SELECT u, job_id, match FROM gen)
SELECT u AS user_id, job_id, match, count(*) AS questions FROM x GROUP BY ALL""")
def open_questions(ev):
    return v.open_questions(ev)


# The board after each event, one event after another; a board of more than two loses the first fainted, else the first.
BOARDS = f"""
ch AS (SELECT e.*, s.side, row_number() OVER (PARTITION BY job_id, match, s.side ORDER BY event_idx) rn,
    CASE WHEN event = 'team_preview' THEN CASE s.side WHEN 'player' THEN {names('player_lead')} ELSE {names('opponent_lead')} END
      WHEN event = 'field_state' AND s.side = 'player' AND player_active <> '' THEN {names('player_active')}
      WHEN event = 'field_state' AND s.side = 'opponent' AND opponent_active <> '' THEN {names('opponent_active')} END shown,
    CASE WHEN event NOT IN ('team_preview', 'field_state') AND actor = s.side AND pokemon IS NOT NULL THEN pokemon END came
  FROM ev e CROSS JOIN (VALUES ('player'), ('opponent')) s(side)),
ft AS (SELECT job_id, match, actor side, list({{'n': pokemon, 't': t}}) fs FROM (SELECT job_id, match, actor, pokemon, min(event_idx) t FROM ev WHERE event = 'pokemon_fainted' GROUP BY ALL) GROUP BY ALL),
cf2 AS (SELECT ch.*, coalesce(ft.fs, []) fs FROM ch LEFT JOIN ft USING (job_id, match, side)),
br AS (SELECT job_id, match, side, 0::BIGINT rn, []::VARCHAR[] b FROM cf2 WHERE rn = 1
  UNION ALL SELECT job_id, match, side, rn, CASE WHEN shown IS NOT NULL THEN shown WHEN came IS NULL OR list_contains(b0, came) THEN b0 WHEN len(ext) <= 2 THEN ext
      ELSE list_slice(kept, greatest(1, len(kept) - 1), len(kept)) END FROM (
    SELECT *, list_filter(ext, lambda x: NOT list_contains(list_slice(gone, 1, len(ext) - 2), x)) kept FROM (
      SELECT *, list_filter(ext, lambda x: len(list_filter(fs, lambda y: y.n = x AND y.t <= event_idx)) > 0) gone FROM (
        SELECT c.*, br.b b0, list_append(br.b, c.came) ext FROM br JOIN cf2 c ON c.job_id = br.job_id AND c.match = br.match AND c.side = br.side AND c.rn = br.rn + 1))))"""


@on_matches("timeline", f"""WITH RECURSIVE {BOARDS} SELECT c.user_id_text AS user_id, c.job_id, c.match, c.event_idx, array_to_string(p.b, ', ') AS player_board, array_to_string(o.b, ', ') AS opponent_board
FROM cf2 c JOIN br p ON p.job_id = c.job_id AND p.match = c.match AND p.side = 'player' AND p.rn = c.rn JOIN br o ON o.job_id = c.job_id AND o.match = c.match AND o.side = 'opponent' AND o.rn = c.rn WHERE c.side = 'player'""")
def timeline(ev):
    line = v.timeline(ev)
    return line.select(*KEY, "event_idx", F.array_join("player_board", ", ").alias("player_board"), F.array_join("opponent_board", ", ").alias("opponent_board"))


SPECIES = BOARDS + """,
sp AS (SELECT c.user_id_text u, c.job_id, c.match, c.event_idx, c.side, i - 1 place, br.b[i] species FROM cf2 c JOIN br USING (job_id, match, side, rn), unnest(generate_series(1, len(br.b))) g(i)),
um AS (SELECT job_id, match, actor side, pokemon species, event_idx, CASE WHEN event = 'pokemon_fainted' THEN 0.0::DOUBLE WHEN event = 'hp_change' THEN hp_percent END hp,
  CASE WHEN event = 'status_inflicted' THEN detail END st, event = 'terastallized' te, event = 'pokemon_fainted' fa FROM ev WHERE actor IN ('player', 'opponent') AND pokemon IS NOT NULL),
ss AS (SELECT sp.u, sp.job_id, sp.match, sp.event_idx, sp.side, sp.place, sp.species, coalesce(arg_max(um.hp, um.event_idx) FILTER (WHERE um.hp IS NOT NULL), 100) hp,
  arg_max(um.st, um.event_idx) FILTER (WHERE um.st IS NOT NULL) st, coalesce(bool_or(te), false) te, coalesce(bool_or(fa), false) fa
  FROM sp LEFT JOIN um ON um.job_id = sp.job_id AND um.match = sp.match AND um.side = sp.side AND um.species = sp.species AND um.event_idx <= sp.event_idx GROUP BY ALL)"""


@on_matches("timeline_species", f"WITH RECURSIVE {SPECIES} SELECT u AS user_id, job_id, match, event_idx, side, cast(place AS INT) AS place, species, hp, st AS status, te AS tera, fa AS fainted FROM ss")
def timeline_species(ev):
    return v.timeline_species(ev, v.timeline(ev))


@on_matches("frame_context", f"""WITH RECURSIVE {QUEUE}, {SPECIES}, lf AS (SELECT job_id, match, reference_frame, max(event_idx) li FROM ev WHERE reference_frame IS NOT NULL GROUP BY ALL)
SELECT q.u AS user_id, q.job_id, q.match, q.side, q.pokemon AS guess, max(ss.hp) FILTER (WHERE ss.species = q.pokemon) AS own_hp, max(ss.st) FILTER (WHERE ss.species = q.pokemon) AS own_status,
  count(*) FILTER (WHERE ss.species <> q.pokemon) AS partners FROM q JOIN lf ON lf.job_id = q.job_id AND lf.match = q.match AND lf.reference_frame = q.own
LEFT JOIN ss ON ss.job_id = q.job_id AND ss.match = q.match AND ss.side = q.side AND ss.event_idx = lf.li GROUP BY q.u, q.job_id, q.match, q.side, q.pokemon""")
def frame_context(ev):
    line = v.timeline(ev)
    rows = v.frame_context(v.clarification_queue(ev), line, v.timeline_species(ev, line))
    return rows.withColumn("partners", F.size("others").cast("bigint")).drop("others")


RECAP = ["team_preview", "pokemon_sent_out", "move_used", "pokemon_fainted", "status_inflicted", "terastallized",
         "item_or_ability_activated", "battle_end"]


@on_matches("match_recap", "WITH RECURSIVE " + TL + f"""
SELECT t.u AS user_id, t.job_id, t.match, t.event_idx, t.tn AS turn_now, score, tl.pos AS position, band FROM tg t LEFT JOIN tl ON tl.job_id = t.job_id AND tl.match = t.match AND tl.tn = t.tn
WHERE t.event IN ({', '.join(repr(x) for x in RECAP)})""")
def match_recap(ev):
    rows = v.match_recap(v.timeline(ev), strategy.strategy_of(ev).timeline, RECAP)
    return rows.select(*KEY, "event_idx", "turn_now", "score", "position", "band")
