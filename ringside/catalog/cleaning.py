"""Queries over cleaning and reconciliation."""

from pyspark.sql import functions as F

from ringside.catalog.registry import on_matches
from ringside.catalog.snippets import names
from ringside.catalog.turns import key_sql
from ringside.contracts import KEY
from ringside.functions import columns as c
from ringside.functions import fixed_values as fixed
from ringside.operators import clean as k

ID = "event_id"
KS = "user_id_text AS user_id, job_id, match"
LEGAL = ["Garchomp", "Incineroar", "Sylveon", "Kingambit", "Charizard", "Whimsicott", "Basculegion", "Sneasler",
         "Archaludon", "Sinistcha", "Rotom", "Ninetales", "Farigiraf", "Excadrill", "Talonflame", "Venusaur",
         "Metagross", "Swampert", "Snorlax", "Mawile", "Hydreigon", "Zoroark"]
_L = "[" + ", ".join(f"'{x.lower()}'" for x in sorted(LEGAL, key=lambda x: (-len(x), x))) + "]"
_norm = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def base_sql(x):
    key = key_sql(x)
    return f"(CASE WHEN list_contains({_L}, {key}) THEN {key} ELSE coalesce(list_filter({_L}, lambda q: starts_with({key}, q))[1], {key}) END)"


def banned_sql(x):
    return f"(NOT list_contains({_L}, {base_sql(x)}))"


@on_matches("species_base", f"SELECT event_id, {base_sql('pokemon')} AS base FROM {{ev}} WHERE pokemon IS NOT NULL")
def species_base(ev):
    return ev.where("pokemon is not null").select(ID, k.species_base(F.col("pokemon"), LEGAL).alias("base"))


@on_matches("flag_banned", f"SELECT event_id, pokemon FROM {{ev}} WHERE pokemon IS NOT NULL AND {banned_sql('pokemon')}")
def flag_banned(ev):
    return ev.where(k.is_banned(F.col("pokemon"), LEGAL)).select(ID, "pokemon")


@on_matches("reject_banned", f"""
WITH x AS (SELECT {KS}, list_transform(list_append({names('player_team')}, 'Bisharp'), lambda n: CASE WHEN n = 'Bisharp' THEN 'Kingambit' ELSE n END) ns FROM ev WHERE event = 'team_preview')
SELECT user_id, job_id, match, array_to_string(list_filter(ns, lambda n: NOT {banned_sql('n')}), ', ') AS clean,
  array_to_string(list_sort(list_distinct(list_filter(ns, lambda n: {banned_sql('n')}))), ', ') AS rejected FROM x""")
def reject_banned(ev):
    rows = ev.where("event = 'team_preview'")
    split = k.reject_banned(F.concat("player_team", F.array(F.lit("Bisharp"))), LEGAL)
    rows = rows.withColumn("s", split)
    return rows.select(*KEY, F.array_join("s.clean", ", ").alias("clean"), F.array_join("s.rejected", ", ").alias("rejected"))


ALLOWED = ["team_preview", "battle_end", "field_state", "move_used", "pokemon_fainted", "hp_change"]


@on_matches("strip_illegal_events", f"SELECT event_id, event IN ({', '.join(repr(x) for x in ALLOWED)}) AS kept FROM {{ev}}")
def strip_illegal_events(ev):
    kept, dropped = k.strip_illegal_events(ev, ALLOWED)
    return kept.select(ID, F.lit(True).alias("kept")).unionByName(dropped.select(ID, F.lit(False).alias("kept")))


_SHORT = "CASE k % 3 WHEN 0 THEN substr(pokemon, 1, 5) WHEN 1 THEN lower(pokemon) || ' l50' ELSE pokemon || '?' END"


@on_matches("canon_to_roster", f"""
WITH p AS (SELECT job_id, match, {names('player_team')} r FROM ev WHERE event = 'team_preview'),
x AS (SELECT e.event_id, {_SHORT} n, p.r FROM ev e JOIN p USING (job_id, match) WHERE pokemon IS NOT NULL),
y AS (SELECT *, {_norm('n')} q FROM x)
SELECT event_id, coalesce(list_filter(r, lambda a: {_norm('a')} = q)[-1], list_filter(r, lambda a: contains({_norm('a')}, q) OR contains(q, {_norm('a')}))[1], trim(n)) AS canon FROM y""")
def canon_to_roster(ev):
    teams = ev.where("event = 'team_preview'").select(*KEY, F.col("player_team").alias("r"))
    rows = ev.where("pokemon is not null").withColumn("n", F.expr(_SHORT)).join(teams, KEY)
    return rows.select(ID, k.canon_to_roster(F.col("n"), F.col("r")).alias("canon"))


_NICK = "CASE WHEN k % 5 = 0 THEN 'Zz' || (k % 7) WHEN k % 5 = 1 THEN substr(pokemon, 1, 6) ELSE pokemon END"
_KNOWN = "[" + ", ".join(f"'{x}'" for x in sorted(LEGAL)) + "]"


@on_matches("resolve_names", f"""
WITH x AS (SELECT event_id, confidence, detail, {_NICK} n FROM ev WHERE pokemon IS NOT NULL),
y AS (SELECT *, CASE WHEN n = 'Zz3' THEN 'Gengar' ELSE list_filter({_KNOWN}, lambda s: {_norm('s')} = {_norm('n')} OR (length({_norm('n')}) >= 4 AND (starts_with({_norm('s')}, {_norm('n')}) OR starts_with({_norm('n')}, {_norm('s')}))))[1] END g FROM x)
SELECT event_id, coalesce(g, n) AS pokemon, CASE WHEN g IS NULL THEN least(confidence, 0.3) ELSE confidence END::DOUBLE AS confidence,
  CASE WHEN g IS NULL THEN detail || ' [unresolved nickname: could not identify ''' || n || ''']' ELSE detail END AS detail FROM y""")
def resolve_names(ev):
    rows = ev.where("pokemon is not null").withColumn("pokemon", F.expr(_NICK))
    taught = ev.sparkSession.createDataFrame([("zz3", "Gengar")], "display_key string, species string")
    return k.resolve_names(rows, LEGAL, taught).select(ID, "pokemon", "confidence", "detail")


_LEARN = "SELECT DISTINCT regexp_replace(lower(pokemon), '[^a-z0-9]', '', 'g') sp, regexp_replace(lower(regexp_replace(detail, ' \\(failed\\)$', '')), '[^a-z0-9]', '', 'g') mv FROM ev WHERE event = 'move_used' AND job_no % 4 = 0 AND pokemon NOT IN ('Garchomp', 'Snorlax')"


@on_matches("flag_implausible_moves", f"""
WITH l AS ({_LEARN}), x AS (SELECT event_id, pokemon, confidence, detail, regexp_replace(detail, ' \\(failed\\)$', '') m FROM ev WHERE event = 'move_used'),
y AS (SELECT x.*, EXISTS (SELECT 1 FROM l WHERE l.sp = {_norm('x.pokemon')}) kn, EXISTS (SELECT 1 FROM l WHERE l.sp = {_norm('x.pokemon')} AND l.mv = {_norm('x.m')}) ok FROM x)
SELECT event_id, CASE WHEN kn THEN ok END AS plausible, CASE WHEN kn AND NOT ok THEN least(confidence, 0.3) ELSE confidence END::DOUBLE AS confidence,
  CASE WHEN kn AND NOT ok THEN detail || ' [' || m || ' is no known move of ' || pokemon || ']' ELSE detail END AS detail FROM y""")
def flag_implausible_moves(ev):
    learnsets = ev.where("event = 'move_used' and job_no % 4 = 0 and pokemon not in ('Garchomp', 'Snorlax')").select(
        c.norm("pokemon").alias("species"), c.norm(c.move_name(F.lit(None), "detail")).alias("move"))
    rows = ev.where("event = 'move_used'").withColumn("move", F.lit(None).cast("string"))
    return k.flag_implausible_moves(rows, learnsets).select(ID, "plausible", "confidence", "detail")


def _sources(ev):
    rows = ev.where("event not in ('team_preview', 'battle_end', 'field_state')").withColumns({
        "actor": F.when(F.col("actor") != "unknown", F.col("actor")),
        "pokemon": F.when(F.col("k") % 3 != 0, F.col("pokemon")),
        "timestamp": F.col("pos") * 1.0 + F.col("k") % 3})
    return rows.where("event_id % 3 = 0"), rows.where("event_id % 3 <> 0").withColumn(
        "timestamp", F.when(F.col("k") % 19 != 0, F.col("timestamp")))


_SRC = """x AS (SELECT event_id, job_id, match, event, CASE WHEN actor <> 'unknown' THEN actor END a, CASE WHEN k % 3 <> 0 THEN pokemon END p, (pos * 1.0 + k % 3)::DOUBLE t, k
  FROM ev WHERE event NOT IN ('team_preview', 'battle_end', 'field_state')),
o AS (SELECT * FROM x WHERE event_id % 3 = 0), v AS (SELECT * EXCLUDE (t), CASE WHEN k % 19 <> 0 THEN t END t FROM x WHERE event_id % 3 <> 0)"""


@on_matches("merge_ocr_vision", f"""WITH {_SRC} SELECT event_id FROM o UNION ALL SELECT event_id FROM v WHERE t IS NULL OR NOT EXISTS (
  SELECT 1 FROM o WHERE o.job_id = v.job_id AND o.match = v.match AND o.event = v.event AND o.p IS NOT DISTINCT FROM v.p AND abs(o.t - v.t) <= 4 AND (o.a IS NULL OR v.a IS NULL OR o.a = v.a))""")
def merge_ocr_vision(ev):
    ocr, vision = _sources(ev)
    return k.merge_ocr_vision(ocr, vision).select(ID)


# The greedy rule, one row after another per (event, species, detail).
@on_matches("dedupe_anchored", """
WITH RECURSIVE x AS (SELECT event_id, job_id, event, CASE WHEN actor <> 'unknown' THEN actor END a, (event_idx * 0.25)::DOUBLE t, event_idx,
    job_id || '|' || event || '|' || (k % 3) g FROM ev WHERE event NOT IN ('team_preview', 'battle_end', 'field_state')),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY event_idx) rn FROM x),
r AS (SELECT g, 0::BIGINT rn, 0::BIGINT event_id, false keep, []::STRUCT(t DOUBLE, a VARCHAR)[] kept FROM n WHERE rn = 1
  UNION ALL SELECT g, rn, event_id, ok, CASE WHEN ok THEN list_append(near, {'t': t, 'a': a}) ELSE near END FROM (
    SELECT *, len(list_filter(near, lambda y: y.a IS NULL OR a IS NULL OR y.a = a)) = 0 ok FROM (
      SELECT n.*, list_filter(r.kept, lambda y: n.t - y.t <= 3) near FROM r JOIN n ON n.g = r.g AND n.rn = r.rn + 1)))
SELECT event_id FROM r WHERE keep""")
def dedupe_anchored(ev):
    rows = ev.where("event not in ('team_preview', 'battle_end', 'field_state')").withColumns({
        "actor": F.when(F.col("actor") != "unknown", F.col("actor")),
        "timestamp": F.col("event_idx") * 0.25, "pokemon": F.lit(None).cast("string"),
        "detail": (F.col("k") % 3).cast("string")})
    return k.dedupe_anchored(rows, ["user_id", "job_id"]).select(ID)


_SEEN = f"""
s0 AS (SELECT user_id_text u, job_id, match, actor side, pokemon n, event_idx, 0 p FROM ev WHERE event IN ({', '.join(repr(x) for x in fixed.REVEALING_EVENTS)}) AND pokemon IS NOT NULL
  UNION ALL SELECT user_id_text, job_id, match, 'player', unnest({names('player_active')}), event_idx, generate_subscripts({names('player_active')}, 1) FROM ev WHERE event = 'field_state'
  UNION ALL SELECT user_id_text, job_id, match, 'opponent', unnest({names('opponent_active')}), event_idx, 10 + generate_subscripts({names('opponent_active')}, 1) FROM ev WHERE event = 'field_state'),
tm AS (SELECT user_id_text u, job_id, match, 'player' side, {names('player_team')} r FROM ev WHERE event = 'team_preview' UNION ALL SELECT user_id_text, job_id, match, 'opponent', {names('opponent_team')} FROM ev WHERE event = 'team_preview'),
s1 AS (SELECT s0.*, coalesce(list_filter(r, lambda a: {_norm('a')} = {_norm('n')})[-1], list_filter(r, lambda a: contains({_norm('a')}, {_norm('n')}) OR contains({_norm('n')}, {_norm('a')}))[1], n) canon FROM s0 JOIN tm USING (job_id, match, side))
"""


def _brought_sql(slot, where):
    return f"""WITH {_SEEN}, s2 AS (SELECT job_id, match, side, {slot} s, arg_min(canon, (event_idx, p)) c, min((event_idx, p)) f FROM s1 WHERE {where} GROUP BY ALL),
s3 AS (SELECT *, row_number() OVER (PARTITION BY job_id, match, side ORDER BY f) rn FROM s2),
b AS (SELECT job_id, match, side, array_to_string(list(c ORDER BY rn) FILTER (WHERE rn <= 4), ', ') br, array_to_string(list(c ORDER BY rn) FILTER (WHERE rn <= 2), ', ') le FROM s3 GROUP BY ALL)
SELECT m.user_id, m.job_id, m.match, coalesce(p.br, '') AS player_brought, coalesce(p.le, '') AS player_lead, coalesce(o.br, '') AS opponent_brought, coalesce(o.le, '') AS opponent_lead
FROM (SELECT {KS} FROM ev WHERE event = 'team_preview') m LEFT JOIN b p ON p.job_id = m.job_id AND p.match = m.match AND p.side = 'player' LEFT JOIN b o ON o.job_id = m.job_id AND o.match = m.match AND o.side = 'opponent'"""


def _flat(df, *columns):
    return df.select(*KEY, *[F.array_join(x, ", ").alias(x) for x in columns])


LISTS = ("player_brought", "player_lead", "opponent_brought", "opponent_lead")


@on_matches("derive_brought", _brought_sql(base_sql("n"), f"NOT {banned_sql('n')}"))
def derive_brought(ev):
    teams = ev.where("event = 'team_preview'").select(*KEY, "player_team", "opponent_team")
    return _flat(k.derive_brought(ev, teams, LEGAL), *LISTS)


@on_matches("repair_brought", _brought_sql("canon", "true"))
def repair_brought(ev):
    return _flat(k.repair_brought(ev), *LISTS)


@on_matches("roster_sparsity", f"""SELECT {KS}, len({names('player_brought')}) AS player_n, 6 AS opponent_n, least(len({names('player_brought')}), 6) AS sparsity FROM {{ev}} WHERE event = 'team_preview'""")
def roster_sparsity(ev):
    rows = ev.where("event = 'team_preview'").select(*KEY, F.col("player_brought").alias("player_team"), "opponent_team")
    return k.roster_sparsity(rows).select(*KEY, "player_n", "opponent_n", "sparsity")


def _previews(ev):
    return ev.where("event = 'team_preview'")


@on_matches("merge_rosters", f"""
WITH x AS (SELECT {KS}, {names('player_brought')} a, {names('opponent_team')} b FROM ev WHERE event = 'team_preview'),
y AS (SELECT *, list_concat(a, list_filter(b, lambda n, i: NOT list_contains(list_transform(a, lambda z: {base_sql('z')}), {base_sql('n')}) AND NOT list_contains(list_transform(list_slice(b, 1, i - 1), lambda z: {base_sql('z')}), {base_sql('n')}))) m FROM x)
SELECT user_id, job_id, match, array_to_string(list_slice(m, 1, 6), ', ') AS roster FROM y""")
def merge_rosters(ev):
    return _previews(ev).select(*KEY, F.array_join(k.merge_rosters(F.col("player_brought"), F.col("opponent_team"), LEGAL), ", ").alias("roster"))


@on_matches("merge_brought", f"""
WITH x AS (SELECT {KS}, {names('player_lead')} a, {names('opponent_team')} b, {names('player_team')} r FROM ev WHERE event = 'team_preview'),
y AS (SELECT *, list_filter(b, lambda n: NOT {banned_sql('n')}) f FROM x),
z AS (SELECT *, list_concat(a, list_transform(list_filter(f, lambda n: NOT list_contains(list_transform(a, lambda z: {base_sql('z')}), {base_sql('n')})), lambda n: coalesce(list_filter(r, lambda q: {_norm('q')} = {_norm('n')})[-1], n))) m FROM y)
SELECT user_id, job_id, match, array_to_string(list_slice(m, 1, 4), ', ') AS brought, array_to_string(list_filter(b, lambda n: {banned_sql('n')}), ', ') AS rejected FROM z""")
def merge_brought(ev):
    rows = _previews(ev).withColumn("m", k.merge_brought(F.col("player_lead"), F.col("opponent_team"), F.col("player_team"), LEGAL))
    return rows.select(*KEY, F.array_join("m.brought", ", ").alias("brought"), F.array_join("m.rejected", ", ").alias("rejected"))


def _missed(ev):
    return k.missed_species(ev, LEGAL)


_MISSED = f"""x AS (SELECT user_id_text u, job_id, match, {base_sql('roster_conflict_species')} b, count(*) n, arg_min(roster_conflict_species, event_idx) sp FROM ev
  WHERE roster_conflict AND actor = 'opponent' AND roster_conflict_species <> '' GROUP BY ALL HAVING count(*) >= 2)"""


@on_matches("missed_species", f"WITH {_MISSED} SELECT u AS user_id, job_id, match, sp AS species, n FROM x")
def missed_species(ev):
    return _missed(ev)


@on_matches("apply_missed_species", f"""
WITH p AS (SELECT {KS}, list_slice({names('opponent_team')}, 1, 4 + match % 3) t, list_slice({names('opponent_brought')}, 1, 3) b, list_sort(list_slice({names('player_team')}, 1, 3)) m FROM ev WHERE event = 'team_preview'),
q AS (SELECT *, list_filter(m, lambda n: NOT list_contains(list_transform(t, lambda z: {base_sql('z')}), {base_sql('n')})) fresh FROM p),
r AS (SELECT *, list_slice(fresh, 1, greatest(0, 6 - len(t))) added, list_slice(fresh, greatest(0, 6 - len(t)) + 1, len(fresh)) ovr FROM q),
s AS (SELECT *, list_filter(m, lambda n: NOT list_contains(ovr, n) AND NOT list_contains(list_transform(b, lambda z: {base_sql('z')}), {base_sql('n')})) nb FROM r)
SELECT user_id, job_id, match, array_to_string(list_concat(t, added), ', ') AS team, array_to_string(list_concat(b, list_slice(nb, 1, greatest(0, 4 - len(b)))), ', ') AS brought, array_to_string(ovr, ', ') AS overflow FROM s""")
def apply_missed_species(ev):
    rows = _previews(ev)
    team = F.expr("slice(opponent_team, 1, 4 + match % 3)")
    fixed_rows = rows.withColumn("m", k.apply_missed_species(
        team, F.slice("opponent_brought", 1, 3), F.array_sort(F.slice("player_team", 1, 3)), LEGAL))
    return fixed_rows.select(*KEY, *[F.array_join(f"m.{x}", ", ").alias(x) for x in ("team", "brought", "overflow")])


@on_matches("flag_roster_conflicts", """SELECT event_id, CASE WHEN event = 'hp_change' AND k % 13 = 6 THEN 'Mew' ELSE '' END AS named FROM {ev} WHERE event = 'hp_change'""")
def flag_roster_conflicts(ev):
    rows = k.flag_roster_conflicts(ev.where("event = 'hp_change'").drop("roster_conflict", "roster_conflict_species"), LEGAL + ["Mew"])
    return rows.select(ID, F.coalesce(F.array_join("roster_conflict_species", ", "), F.lit("")).alias("named"))


@on_matches("reconcile_rosters", f"""
WITH p AS (SELECT user_id_text u, job_id, match, event_idx, player_team, array_to_string(list_sort(list_distinct(list_transform({names('player_team')}, lambda n: {base_sql('n')}))), '|') ky FROM ev WHERE event = 'team_preview'),
t AS (SELECT job_id, ky, count(*) n, min(event_idx) f, arg_min(player_team, event_idx) tm FROM p GROUP BY ALL),
d AS (SELECT *, sum(n) OVER (PARTITION BY job_id) a FROM t QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC, f) = 1)
SELECT u AS user_id, p.job_id, match, CASE WHEN a >= 3 AND a - d.n = 1 AND p.ky <> d.ky THEN tm ELSE player_team END AS player_team, a >= 3 AND a - d.n = 1 AND p.ky <> d.ky AS corrected FROM p JOIN d USING (job_id)""")
def reconcile_rosters(ev):
    return k.reconcile_rosters(ev, LEGAL).select(*KEY, F.array_join("player_team", ", ").alias("player_team"), "corrected")


_PIX = "SELECT job_id || '/' || match || '/' || reference_frame f, actor a, max(k) / 100.0::DOUBLE bar FROM ev WHERE reference_frame IS NOT NULL AND actor IN ('player', 'opponent') AND pos % 2 = 0 GROUP BY ALL"


def _framed(ev):
    """Frame names repeat in every match, so the readings below carry the match key."""
    return ev.where("reference_frame is not null")


@on_matches("cross_check_hp", f"""WITH b AS ({_PIX}), x AS (SELECT event_id, event, hp_percent, confidence, bar FROM ev e LEFT JOIN b ON b.f = e.job_id || '/' || e.match || '/' || e.reference_frame AND b.a = e.actor WHERE e.reference_frame IS NOT NULL)
SELECT event_id, CASE WHEN event = 'hp_change' AND abs(hp_percent - round_even(bar * 100, 0)) > 8 THEN least(confidence, 0.5) ELSE confidence END::DOUBLE AS confidence,
  coalesce(event = 'hp_change' AND abs(hp_percent - round_even(bar * 100, 0)) > 8, false) AS noted FROM x""")
def cross_check_hp(ev):
    rows = _framed(ev)
    pixels = rows.where("actor in ('player', 'opponent') and pos % 2 = 0").groupBy(*KEY, "reference_frame", "actor").agg((F.max("k") / 100).alias("hp_fraction"))
    return k.cross_check_hp(rows, pixels).select(ID, "confidence", F.coalesce(F.col("detail").contains("[bar in the frame"), F.lit(False)).alias("noted"))


@on_matches("cross_check_status", """WITH i AS (SELECT job_id || '/' || match || '/' || reference_frame f, max(CASE WHEN k % 4 = 1 THEN 'burn' END) ic FROM ev WHERE reference_frame IS NOT NULL AND k % 3 <> 0 GROUP BY 1)
SELECT event_id, CASE WHEN event = 'status_inflicted' AND actor = 'opponent' AND status = 'burn' AND f IS NOT NULL AND ic IS NULL THEN least(confidence, 0.5) ELSE confidence END::DOUBLE AS confidence
FROM ev e LEFT JOIN i ON i.f = e.job_id || '/' || e.match || '/' || e.reference_frame WHERE e.reference_frame IS NOT NULL""")
def cross_check_status(ev):
    rows = _framed(ev)
    icons = rows.where("k % 3 <> 0").select(*KEY, "reference_frame", F.when(F.col("k") % 4 == 1, "burn").alias("icon"))
    return k.cross_check_status(rows, icons).select(ID, "confidence")


@on_matches("cross_check_visibility", f"""WITH t AS (SELECT job_id || '/' || match || '/' || reference_frame f, max('Lv50 ' || pokemon || ' here') tx FROM ev WHERE reference_frame IS NOT NULL AND pokemon IS NOT NULL GROUP BY 1),
x AS (SELECT e.*, t.tx, event <> 'battle_end' AND pokemon IS NOT NULL AND actor IN ('player', 'opponent') ask FROM ev e JOIN t ON t.f = e.job_id || '/' || e.match || '/' || e.reference_frame),
y AS (SELECT *, len(list_filter(string_split(tx, ' '), lambda w: length({_norm('w')}) >= 4 AND (starts_with({_norm('w')}, {_norm('pokemon')}) OR starts_with({_norm('pokemon')}, {_norm('w')})
  OR (roster_conflict_species <> '' AND (starts_with({_norm('w')}, {_norm('roster_conflict_species')}) OR starts_with({_norm('roster_conflict_species')}, {_norm('w')})))))) > 0 vis FROM x)
SELECT event_id, CASE WHEN ask THEN vis ELSE reference_frame_shows_subject END AS reference_frame_shows_subject, CASE WHEN ask AND NOT vis THEN least(confidence, 0.5) ELSE confidence END::DOUBLE AS confidence FROM y""")
def cross_check_visibility(ev):
    rows = _framed(ev)
    text = rows.where("pokemon is not null").select(*KEY, "reference_frame", F.concat(F.lit("Lv50 "), "pokemon", F.lit(" here")).alias("text"))
    framed = rows.join(text.select(*KEY, "reference_frame").distinct(), [*KEY, "reference_frame"], "left_semi")
    return k.cross_check_visibility(framed, text).select(ID, "reference_frame_shows_subject", "confidence")


@on_matches("apply_type_override", f"""
WITH x AS (SELECT {KS}, k, {names('opponent_team')} o, {names('player_team')} p FROM ev WHERE event = 'team_preview'),
a AS (SELECT *, CASE WHEN list_contains(o, p[1]) THEN o ELSE list_concat(list_slice(o, 1, k % 6), [p[1]], list_slice(o, k % 6 + 2, 6)) END o1 FROM x),
b AS (SELECT *, CASE WHEN k % 2 = 1 OR list_contains(o1, p[2]) THEN o1 ELSE list_concat(list_slice(o1, 1, (k + 1) % 6), [p[2]], list_slice(o1, (k + 1) % 6 + 2, 6)) END o2 FROM a)
SELECT user_id, job_id, match, array_to_string(o2, ', ') AS opponent_team FROM b""")
def apply_type_override(ev):
    hint = lambda row, badges, *names_: F.struct(F.expr(row).alias("row"), F.expr(badges).alias("num_badges_found"), F.array(*names_).alias("candidates"))
    p = lambda i: F.get("player_team", F.lit(i))
    hints = F.array(hint("k % 6", "2", p(0)), hint("(k + 1) % 6", "2 - k % 2", p(1)), hint("(k + 2) % 6", "2", p(2), p(3)))
    return _previews(ev).select(*KEY, F.array_join(k.apply_type_override(F.col("opponent_team"), hints), ", ").alias("opponent_team"))


def _corrections(ev):
    """Chains of renames: first name to A, A to B on every second match, an unused rename, and one on the other side."""
    rows = ev.where("event = 'team_preview'")
    p = lambda i: F.get("player_team", F.lit(i))
    fix = lambda seq, actor, old, new: F.struct(F.lit(seq).alias("seq"), F.lit(actor).alias("actor"), old.alias("old_name"), new.alias("new_name"))
    listed = F.array(
        fix(1, "player", p(0), F.lit("Ditto")), fix(2, "player", F.lit("Nobody"), F.lit("Eevee")),
        fix(3, "player", F.when(F.col("match") % 2 == 0, "Ditto").otherwise("Xyz"), F.lit("Mew")),
        fix(4, "opponent", F.get("opponent_team", F.lit(1)), F.lit("Zapdos")), fix(5, "player", F.lit("Mew"), F.lit("Mewtwo")))
    return rows.select(*KEY, F.inline(listed))


_FIXN = "(CASE WHEN match % 2 = 0 THEN 'Mewtwo' ELSE 'Ditto' END)"


@on_matches("final_names", f"""WITH p AS (SELECT {KS}, {names('player_team')} p, {names('opponent_team')} o FROM ev WHERE event = 'team_preview')
SELECT user_id, job_id, match, 'player' AS actor, p[1] AS old_name, {_FIXN} AS final_name FROM p UNION ALL SELECT user_id, job_id, match, 'player', 'Nobody', 'Eevee' FROM p
UNION ALL SELECT user_id, job_id, match, 'player', CASE WHEN match % 2 = 0 THEN 'Ditto' ELSE 'Xyz' END, 'Mewtwo' FROM p
UNION ALL SELECT user_id, job_id, match, 'player', 'Mew', 'Mewtwo' FROM p UNION ALL SELECT user_id, job_id, match, 'opponent', o[2], 'Zapdos' FROM p""")
def final_names(ev):
    return k.final_names(_corrections(ev))


def _swap(column, side):
    old, new = ("q.p[1]", _FIXN.replace("match", "e.match")) if side == "player" else ("q.o[2]", "'Zapdos'")
    return f"array_to_string(list_transform({names('e.' + column)}, lambda n: CASE WHEN n = {old} THEN {new} ELSE n END), ', ')"


@on_matches("apply_corrections", f"""WITH q AS (SELECT job_id, match, {names('player_team')} p, {names('opponent_team')} o FROM ev WHERE event = 'team_preview')
SELECT e.event_id, CASE WHEN e.actor = 'player' AND e.pokemon = q.p[1] THEN {_FIXN.replace('match', 'e.match')} WHEN e.actor = 'opponent' AND e.pokemon = q.o[2] THEN 'Zapdos' ELSE e.pokemon END AS pokemon,
  {_swap('player_active', 'player')} AS player_active, {_swap('player_team', 'player')} AS player_team, {_swap('opponent_brought', 'opponent')} AS opponent_brought,
  coalesce(e.corrected, false) OR coalesce(e.actor = 'player' AND e.pokemon = q.p[1], false) OR coalesce(e.actor = 'opponent' AND e.pokemon = q.o[2], false)
   OR list_contains({names('e.player_active')}, q.p[1]) OR list_contains({names('e.opponent_active')}, q.o[2]) OR e.event = 'team_preview' AS corrected
FROM ev e JOIN q USING (job_id, match)""")
def apply_corrections(ev):
    rows = k.apply_corrections(ev, _corrections(ev))
    return rows.select(ID, "pokemon", *[F.array_join(x, ", ").alias(x) for x in ("player_active", "player_team", "opponent_brought")], "corrected")


@on_matches("replace_matches", """SELECT event_id, CASE WHEN match IN (2, 5) THEN 'new' ELSE 'old' END AS version FROM {ev} WHERE match NOT IN (2, 5) OR pos % 2 = 0""")
def replace_matches(ev):
    old = ev.select(*KEY, ID, F.lit("old").alias("version"))
    new = ev.where("match in (2, 5) and pos % 2 = 0").select(*KEY, ID, F.lit("new").alias("version"))
    return k.replace_matches(old, new).select(ID, "version")


@on_matches("append_renumbered", """SELECT event_id, match FROM {ev} UNION ALL SELECT event_id, cast(m + match / 2 AS INT) FROM ev JOIN (SELECT job_id, max(match) m FROM ev GROUP BY 1) USING (job_id) WHERE match % 2 = 0""")
def append_renumbered(ev):
    columns = ["user_id", "job_id", "match", ID]
    """Every second match of an upload arrives once more, after all that are there."""
    return k.append_renumbered(ev.select(*columns), ev.where("match % 2 = 0").select(*columns)).select(ID, "match")


@on_matches("upsert_grades", """SELECT job_id, match, CASE WHEN match % 3 = 0 THEN 'graded again' ELSE 'graded' END AS notes FROM {ev} WHERE event = 'battle_end'""")
def upsert_grades(ev):
    ends = ev.where("event = 'battle_end'").select(*KEY, F.lit("graded").alias("notes"))
    # Only some uploads are graded again; the same match number of the others keeps its grade.
    again = ends.where("match % 3 = 0").withColumn("notes", F.lit("graded again"))
    return k.upsert_grades(ends, again).select("job_id", "match", "notes")


@on_matches("revealed_items", """SELECT user_id_text AS user_id, job_id, match, actor, pokemon, arg_max(item, event_idx) AS item
FROM (SELECT *, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN '' ELSE 'Item ' || k % 5 END AS item, CASE WHEN event = 'move_used' THEN 'item_or_ability_activated' ELSE event END AS kind
  FROM (SELECT * EXCLUDE (item) FROM {ev})) WHERE kind = 'item_or_ability_activated' AND item <> '' AND actor <> '' AND pokemon <> '' GROUP BY ALL""")
def revealed_items(ev):
    rows = ev.withColumn("event", F.when(F.col("event") == "move_used", "item_or_ability_activated").otherwise(F.col("event")))
    rows = rows.withColumn("item", F.when(F.col("k") % 4 == 1, "").when(F.col("k") % 4 > 1, F.concat(F.lit("Item "), (F.col("k") % 5).cast("string"))))
    return k.revealed_items(rows)


@on_matches("remember_last_rooms", """WITH x AS (SELECT user_id, props || event_type room_id, max(event_id) m FROM {ev} GROUP BY 1, 2)
SELECT user_id, room_id, m AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY m DESC) AS rank FROM x QUALIFY rank <= 100""", raw=True)
def remember_last(ev):
    rooms = ev.select("user_id", F.concat("props", "event_type").alias("room_id"), ID)
    return k.remember_last(rooms, ["user_id"], ID)


@on_matches("within_video", """WITH w AS (SELECT job_id, match, min(event_idx) * 5.0 s, job_no FROM ev GROUP BY job_id, match, job_no)
SELECT job_id, match FROM w WHERE job_no % 3 = 0 OR s < 1000 + job_no * 7""")
def within_video(ev):
    windows = ev.groupBy("job_id", "match").agg((F.min("event_idx") * 5.0).alias("start_seconds"))
    lengths = ev.where("job_no % 3 <> 0").select("job_id", (F.col("job_no") * 7 + 1000).cast("double").alias("video_seconds")).distinct()
    return k.within_video(windows, lengths).select("job_id", "match")
