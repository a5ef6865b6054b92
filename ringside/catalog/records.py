"""Queries over match summaries."""

from pyspark.sql import functions as F

from ringside.catalog.registry import on_matches
from ringside.catalog.snippets import DECIDED, PM, names
from ringside.contracts import KEY
from ringside.operators import record as r

USER = ["user_id"]
JOB = ["user_id", "job_id"]
AS_KEY = "u AS user_id, j AS job_id, m AS match"


def text(*columns):
    return [F.array_join(x, ", ").alias(x) for x in columns]


@on_matches("per_match", f"""
WITH {PM} SELECT {AS_KEY}, winner, array_to_string(p_lead, ', ') AS player_lead,
  array_to_string(o_lead, ', ') AS opponent_lead, array_to_string(p_brought, ', ') AS player_brought,
  array_to_string(o_brought, ', ') AS opponent_brought, p_faints, o_faints, margin, first_ko, was_ahead, tera_n
FROM pm""")
def per_match(ev):
    return r.per_match(ev).select(
        *KEY, "winner", *text("player_lead", "opponent_lead", "player_brought", "opponent_brought"),
        "p_faints", "o_faints", "margin", "first_ko", "was_ahead", "tera_n")


@on_matches("knockouts", f"""
WITH {PM} SELECT {AS_KEY}, event_idx, scored_by, cast(diff AS BIGINT) AS ko_diff,
  row_number() OVER (PARTITION BY u, j, m ORDER BY event_idx) AS ko_no FROM ko""")
def knockouts(ev):
    return r.knockouts(ev).drop("pokemon")


@on_matches("record", f"""
WITH {PM} SELECT u AS user_id, count(*) FILTER (WHERE winner <> 'unknown') AS matches, count(*) AS total_games,
  count(*) FILTER (WHERE winner = 'unknown') AS undetermined, count(*) FILTER (WHERE won) AS wins,
  count(*) FILTER (WHERE winner = 'opponent') AS losses,
  cast(coalesce(round_even(100.0 * count(*) FILTER (WHERE won) / nullif(count(*) FILTER (WHERE winner <> 'unknown'), 0), 1), 0) AS DOUBLE) AS win_rate
FROM pm WHERE winner <> 'unknown' OR len(p_brought) > 0 GROUP BY u""")
def record(ev):
    return r.record(r.per_match(ev), USER)


@on_matches("real_and_decided_matches", f"""
WITH {PM} SELECT u AS user_id, count(*) FILTER (WHERE winner <> 'unknown' OR len(p_brought) > 0) AS real_n,
  count(*) FILTER (WHERE winner IN ('player', 'opponent')) AS decided_n FROM pm GROUP BY u""")
def real_and_decided(ev):
    m = r.per_match(ev)
    real = r.real_matches(m).groupBy("user_id").agg(F.count("*").alias("real_n"))
    return real.join(r.decided(m).groupBy("user_id").agg(F.count("*").alias("decided_n")), "user_id")


def _table(source, key):
    return f"""WITH {PM} SELECT u AS user_id, {key} AS name, count(*) FILTER (WHERE won) AS wins, count(*) AS total,
  cast(round_even(100.0 * count(*) FILTER (WHERE won) / count(*), 1) AS DOUBLE) AS win_pct FROM ({source}) GROUP BY 1, 2"""


@on_matches("winrate_by_lead", _table(f"SELECT * FROM ({DECIDED}) WHERE len(p_lead) > 0", "array_to_string(p_lead, ' + ')"))
def winrate_by_lead(ev):
    return r.by_lead(r.per_match(ev), USER).drop("first_seen")


@on_matches("winrate_by_opponent_lead", _table(f"SELECT * FROM ({DECIDED}) WHERE len(o_lead) > 0", "array_to_string(o_lead, ' + ')"))
def winrate_by_opponent_lead(ev):
    return r.by_lead(r.per_match(ev), USER, "opponent").drop("first_seen")


@on_matches("winrate_by_bring", _table(f"SELECT u, won, unnest(list_distinct(p_brought)) x FROM ({DECIDED})", "x"))
def winrate_by_bring(ev):
    return r.by_bring(r.per_match(ev), USER).drop("first_seen")


@on_matches("winrate_by_matchup", _table(f"SELECT u, won, unnest(list_distinct(o_brought)) x FROM ({DECIDED})", "x"))
def winrate_by_matchup(ev):
    return r.matchups(r.per_match(ev), USER).drop("first_seen")


@on_matches("toughest_matchups", f"""
WITH {PM}, t AS (SELECT u, x, count(*) FILTER (WHERE won) w, count(*) n, min(seen) s
  FROM (SELECT u, won, seen, unnest(list_distinct(o_brought)) x FROM ({DECIDED})) GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT u AS user_id, x AS name, w AS wins, n AS total, row_number() OVER (PARTITION BY u ORDER BY w * 1.0 / n, n DESC, s, x) AS rank
FROM t QUALIFY rank <= 8""")
def toughest_matchups(ev):
    return r.toughest_matchups(r.per_match(ev), USER).drop("first_seen", "win_pct")


@on_matches("combat_summary", f"""
WITH {PM} SELECT u AS user_id, cast(sum(o_faints) AS BIGINT) AS kos_in_decided, cast(sum(p_faints) AS BIGINT) AS lost_in_decided,
  cast(round_even(avg(o_faints - p_faints), 2) AS DOUBLE) AS ko_differential_avg,
  cast(round_even(coalesce(avg(margin) FILTER (WHERE won), 0), 1) AS DOUBLE) AS avg_winning_margin,
  cast(round_even(coalesce(100.0 * count(*) FILTER (WHERE won AND first_ko = 'player') / nullif(count(*) FILTER (WHERE first_ko = 'player'), 0), 0), 1) AS DOUBLE) AS first_ko_win_rate
FROM ({DECIDED}) GROUP BY u""")
def combat_summary(ev):
    return r.combat_summary(r.per_match(ev), USER)


@on_matches("knockout_totals", """
SELECT user_id_text AS user_id, count(*) FILTER (WHERE actor = 'opponent') AS kos_landed,
  count(*) FILTER (WHERE actor = 'player') AS pokemon_lost FROM {ev} WHERE event = 'pokemon_fainted' GROUP BY 1""")
def knockout_totals(ev):
    return r.knockout_totals(ev, USER)


_TERA = """WITH {pm} SELECT u AS user_id, count(*) FILTER (WHERE tera_n > 0) AS matches_with, count(*) FILTER (WHERE tera_n = 0) AS matches_without,
  cast(round_even(coalesce(100.0 * count(*) FILTER (WHERE won AND tera_n > 0) / nullif(count(*) FILTER (WHERE tera_n > 0), 0), 0), 1) AS DOUBLE) AS win_rate_with,
  cast(round_even(coalesce(100.0 * count(*) FILTER (WHERE won AND tera_n = 0) / nullif(count(*) FILTER (WHERE tera_n = 0), 0), 0), 1) AS DOUBLE) AS win_rate_without
FROM ({decided}) {where} GROUP BY u"""


@on_matches("tera_split", _TERA.format(pm=PM, decided=DECIDED, where=""))
def tera_split(ev):
    return r.tera_split(r.per_match(ev), USER)


@on_matches("tera_split_gated", _TERA.format(pm=PM, decided=DECIDED, where="WHERE false"))
def tera_split_gated(ev):
    """The rules of the format forbid the mechanic, so its figures are hidden."""
    return r.tera_split(r.per_match(ev), USER, tera_legal=False)


@on_matches("lead_predictability", f"""
WITH {PM}, d AS ({DECIDED}),
p AS (SELECT u, array_to_string(p_lead, ' + ') l, count(*) n, min(seen) s FROM d WHERE len(p_lead) > 0 GROUP BY 1, 2),
o AS (SELECT u, array_to_string(o_lead, ' + ') l, count(*) n, count(*) FILTER (WHERE won) w, min(seen) s FROM d WHERE len(o_lead) > 0 GROUP BY 1, 2),
pt AS (SELECT *, sum(n) OVER (PARTITION BY u) a FROM p QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, s) = 1),
ot AS (SELECT *, sum(n) OVER (PARTITION BY u) a FROM o QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, s) = 1)
SELECT pt.u AS user_id, pt.l AS most_common, cast(round_even(100.0 * pt.n / pt.a, 1) AS DOUBLE) AS predictability_pct,
  ot.l AS opponent_most_common, cast(round_even(100.0 * ot.n / ot.a, 1) AS DOUBLE) AS opponent_predictability_pct,
  cast(round_even(100.0 * ot.w / ot.n, 1) AS DOUBLE) AS win_rate_vs_opponent_most_common, ot.n AS vs_opponent_most_common_n
FROM pt JOIN ot USING (u)""")
def lead_predictability(ev):
    return r.lead_predictability(r.per_match(ev), USER)


@on_matches("throws", f"""
WITH {PM} SELECT u AS user_id, count(*) FILTER (WHERE was_ahead) AS throws, count(*) AS losses
FROM pm WHERE winner = 'opponent' GROUP BY u""")
def throws(ev):
    return r.throws(r.per_match(ev), USER)


_FLAGS = """WITH {pm}, d AS ({decided}), t AS (SELECT {by}, count(*) n FROM d GROUP BY ALL),
l AS (SELECT {by}, array_to_string(p_lead, ' + ') l, count(*) n, min(seen) s FROM d WHERE len(p_lead) > 0 GROUP BY ALL),
lt AS (SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY {by}) p FROM l QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY n DESC, s) = 1),
b AS (SELECT {by}, x, count(*) n, 100.0 * count(*) FILTER (WHERE won) / count(*) p, min(seen) s
  FROM (SELECT {by}, won, seen, unnest(list_distinct(p_brought)) x FROM d) GROUP BY ALL),
te AS (SELECT {by}, count(*) FILTER (WHERE tera_n > 0) a, count(*) FILTER (WHERE tera_n = 0) b,
  100.0 * count(*) FILTER (WHERE won AND tera_n > 0) / nullif(count(*) FILTER (WHERE tera_n > 0), 0) x,
  100.0 * count(*) FILTER (WHERE won AND tera_n = 0) / nullif(count(*) FILTER (WHERE tera_n = 0), 0) y FROM d GROUP BY ALL),
f AS (
  SELECT {by}, 'predictable_lead' kind, l subject, 'Predictable leads - ' || cast(round_even(p, 0) AS INT) || '% of games open with ' || l || '.' flag
    FROM lt JOIN t USING ({by}) WHERE t.n >= 3 AND p >= 50
  UNION ALL SELECT {by}, 'tera_not_helping', '', 'Tera not helping - ' || cast(round_even(x, 0) AS INT) || '% win with Tera vs ' || cast(round_even(y, 0) AS INT) || '% without.'
    FROM te WHERE a >= 3 AND b >= 3 AND x < y - 10
  UNION ALL SELECT {by}, 'low_value_bring', x, 'Low-value bring: ' || x || ' - ' || cast(round_even(p, 0) AS INT) || '% win across ' || n || ' brings.'
    FROM (SELECT * FROM b WHERE n >= 3 AND p < 40 {cap})
  UNION ALL SELECT {by}, 'underused_asset', x, 'Underused asset: ' || x || ' - ' || cast(round_even(p, 0) AS INT) || '% win but only brought ' || n || 'x.'
    FROM (SELECT b.* FROM b JOIN t USING ({by}) WHERE b.n >= 2 AND b.n < greatest(2, t.n * 0.3) AND p >= 65 {capb})
  UNION ALL SELECT {by}, 'throws', '', count(*) || ' likely thrown game(s) - lost after being ahead in KOs.' FROM d WHERE winner = 'opponent' AND was_ahead GROUP BY ALL)
SELECT {out}, kind, subject, flag FROM f
UNION ALL SELECT {out}, 'none', '', 'No strong patterns yet - need more matches for confident coaching signals.'
FROM (SELECT DISTINCT {by} FROM pm WHERE winner <> 'unknown' OR len(p_brought) > 0) q WHERE NOT EXISTS (SELECT 1 FROM f WHERE {same})"""


@on_matches("coaching_flags", _FLAGS.format(
    pm=PM, decided=DECIDED, by="u, j", cap="", capb="", out="u AS user_id, j AS job_id", same="f.u = q.u AND f.j = q.j"))
def coaching_flags(ev):
    return r.coaching_flags(r.per_match(ev), JOB)


@on_matches("coaching_flags_text_report", _FLAGS.format(
    pm=PM, decided=DECIDED, by="u",
    cap="QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, s, x) <= 5",
    capb="QUALIFY row_number() OVER (PARTITION BY u ORDER BY b.n DESC, s, x) <= 5",
    out="u AS user_id", same="f.u = q.u"))
def coaching_flags_text(ev):
    return r.coaching_flags(r.per_match(ev), USER, per_kind=5)


_USAGE = f"""
WITH x AS (
  SELECT user_id_text u, 'move' kind, detail name, event_idx FROM {{ev}} WHERE event = 'move_used' AND actor = 'player'
  UNION ALL SELECT user_id_text, 'move_user', pokemon, event_idx FROM ev WHERE event = 'move_used' AND actor = 'player'
  UNION ALL SELECT user_id_text, 'on_field', unnest({names('player_active')}), event_idx FROM ev WHERE event = 'field_state'
  UNION ALL SELECT user_id_text, 'brought', unnest({names('player_brought')}), event_idx FROM ev WHERE event = 'team_preview'
  UNION ALL SELECT user_id_text, 'lead', unnest({names('player_lead')}), event_idx FROM ev WHERE event = 'team_preview'
  UNION ALL SELECT user_id_text, 'tera', pokemon, event_idx FROM ev WHERE event = 'terastallized' AND actor = 'player'),
c AS (SELECT u, kind, name, count(*) n, min(event_idx) s FROM x WHERE name <> '' GROUP BY 1, 2, 3)"""


@on_matches("usage_counts", _USAGE + "SELECT u AS user_id, kind, name, n FROM c")
def usage_counts(ev):
    return r.usage_counts(ev, USER).drop("first_seen")


@on_matches("top_usage", _USAGE + """
SELECT u AS user_id, kind, name, n, row_number() OVER (PARTITION BY u, kind ORDER BY n DESC, s, name) AS rank FROM c QUALIFY rank <= 5""")
def top_usage(ev):
    counts = r.usage_counts(ev, USER)
    order = [-F.col("n"), F.col("first_seen"), F.col("name")]
    return r.top_n(counts, ["user_id", "kind"], order, 5).drop("first_seen")


SCORES = """
d AS (SELECT *, {by_cols} FROM ({source})),
le AS (SELECT {by}, CASE WHEN sum(c) <= 1 OR count(*) <= 1 THEN 0 ELSE greatest(0, least(100, -sum((c / t) * ln(c / t)) / ln(count(*)) * 100)) END h
  FROM (SELECT {by}, array_to_string(p_lead, ' + ') x, count(*) c, sum(count(*)) OVER (PARTITION BY {by}) t FROM d WHERE len(p_lead) > 0 GROUP BY {by}, x) GROUP BY {by}),
be AS (SELECT {by}, CASE WHEN sum(c) <= 1 OR count(*) <= 1 THEN 0 ELSE greatest(0, least(100, -sum((c / t) * ln(c / t)) / ln(count(*)) * 100)) END h
  FROM (SELECT {by}, array_to_string(list_sort(list_distinct(p_brought)), '|') x, count(*) c, sum(count(*)) OVER (PARTITION BY {by}) t FROM d WHERE len(p_brought) > 0 GROUP BY {by}, x) GROUP BY {by}),
s0 AS (SELECT {by}, count(*) n, avg(o_faints - p_faints) kd, count(*) FILTER (WHERE first_ko = 'player') / count(*) fk,
  coalesce(sum(o_faints) / nullif(sum(o_faints) + sum(p_faints), 0), 0.5) eff,
  coalesce(count(*) FILTER (WHERE winner = 'opponent' AND was_ahead) / nullif(count(*) FILTER (WHERE winner = 'opponent'), 0), 0) thr,
  coalesce(count(*) FILTER (WHERE won AND was_ahead) / nullif(count(*) FILTER (WHERE was_ahead), 0), 0) conv,
  coalesce(avg(margin / brought_n) FILTER (WHERE won), 0) mg FROM d GROUP BY {by}),
s1 AS (SELECT s0.*, greatest(0, least(100, 0.5 * greatest(0, least(100, (kd + 2) / 4 * 100)) + 0.5 * fk * 100)) tempo,
  greatest(0, least(100, 0.5 * coalesce(le.h, 0) + 0.5 * coalesce(be.h, 0))) adaptability,
  greatest(0, least(100, 0.7 * eff * 100 + 0.3 * (1 - thr) * 100)) execution,
  greatest(0, least(100, 0.6 * conv * 100 + 0.4 * mg * 100)) closing
  FROM s0 LEFT JOIN le USING ({by}) LEFT JOIN be USING ({by})),
scores AS (SELECT {by}, n AS matches_analyzed,
  CASE WHEN n >= 100 THEN 'Exceptional' WHEN n >= 50 THEN 'Strong' WHEN n >= 25 THEN 'Good understanding' ELSE 'Provisional (building)' END AS tier,
  cast(CASE WHEN n >= 100 THEN NULL WHEN n >= 50 THEN 100 - n WHEN n >= 25 THEN 50 - n ELSE 25 - n END AS BIGINT) AS matches_to_next_tier,
  cast(round_even(round(tempo, 9), 1) AS DOUBLE) AS tempo, cast(round_even(round(adaptability, 9), 1) AS DOUBLE) AS adaptability,
  cast(round_even(round(execution, 9), 1) AS DOUBLE) AS execution, cast(round_even(round(closing, 9), 1) AS DOUBLE) AS closing,
  cast(round_even(round((tempo + adaptability + execution + closing) / 4, 9), 1) AS DOUBLE) AS overall FROM s1)"""


@on_matches("skill_scores", "WITH " + PM + ", " + SCORES.format(by="user_id", by_cols="u AS user_id", source=DECIDED)
            + " SELECT * FROM scores")
def skill_scores(ev):
    return r.skill_scores(r.per_match(ev), USER)


@on_matches("lead_entropy", "WITH " + PM + ", " + SCORES.format(by="user_id", by_cols="u AS user_id", source=DECIDED)
            + " SELECT user_id, round(h, 6) AS lead_entropy FROM le")
def lead_entropy(ev):
    games = r.decided(r.per_match(ev)).select("user_id", r.lead_choice().alias("o")).where("o is not null")
    return r.entropy(games, USER, "o", "lead_entropy").withColumn("lead_entropy", F.round("lead_entropy", 6))


_META = f"""
WITH {PM}, x AS (
  SELECT u, won, seen, 'leads' part, array_to_string(p_lead, ' + ') name FROM pm WHERE len(p_lead) > 0
  UNION ALL SELECT u, won, seen, 'pokemon_usage', unnest(list_distinct(p_brought)) FROM pm
  UNION ALL SELECT u, won, seen, 'opponent_threats', unnest(list_distinct(o_brought)) FROM pm),
t AS (SELECT u, part, name, count(*) FILTER (WHERE won) wins, count(*) total, min(seen) s FROM x GROUP BY 1, 2, 3)"""


@on_matches("own_meta", _META + """ SELECT u AS user_id, part, name, wins, total,
  cast(round_even(100.0 * wins / total, 1) AS DOUBLE) AS win_pct FROM t""")
def own_meta(ev):
    return r.own_meta(r.per_match(ev), USER).drop("first_seen")


@on_matches("worst_matchups", _META + """ SELECT u AS user_id, name, wins, total,
  row_number() OVER (PARTITION BY u ORDER BY round_even(100.0 * wins / total, 1), total DESC, s, name) AS rank
  FROM t WHERE part = 'opponent_threats' QUALIFY rank <= 6""")
def worst_matchups(ev):
    return r.worst_matchups(r.per_match(ev), USER).select("user_id", "name", "wins", "total", "rank")


@on_matches("profile_summary", _META + f""",
ll AS (SELECT u, string_agg(name || ' ' || wins || '/' || total, '; ' ORDER BY total DESC, s, name) t FROM
  (SELECT * FROM t WHERE part = 'leads' QUALIFY row_number() OVER (PARTITION BY u ORDER BY total DESC, s, name) <= 6) GROUP BY u),
bb AS (SELECT u, string_agg(name || ' ' || wins || '/' || total, '; ' ORDER BY total DESC, s, name) t FROM
  (SELECT * FROM t WHERE part = 'pokemon_usage' QUALIFY row_number() OVER (PARTITION BY u ORDER BY total DESC, s, name) <= 10) GROUP BY u),
g AS (SELECT u, count(*) FILTER (WHERE won) w, count(*) n, count(*) FILTER (WHERE won AND tera_n > 0) tw, count(*) FILTER (WHERE tera_n > 0) tn,
  count(*) FILTER (WHERE won AND tera_n = 0) nw, count(*) FILTER (WHERE tera_n = 0) nn FROM ({DECIDED}) GROUP BY u)
SELECT u AS user_id, 'RECORD: ' || w || '-' || (n - w) || ' (' || cast(round_even(100.0 * w / n, 0) AS INT) || '%) over ' || n || ' matches.' || chr(10)
  || 'LEADS (win rate): ' || ll.t || chr(10) || 'BRINGS (wins/brought): ' || bb.t || chr(10)
  || 'TERA: with ' || tw || '/' || tn || ', without ' || nw || '/' || nn || '.' AS profile
FROM g JOIN ll USING (u) JOIN bb USING (u)""")
def profile_summary(ev):
    return r.profile_summary(r.per_match(ev), USER)


@on_matches("match_list", f"""
WITH {PM} SELECT {AS_KEY}, winner, array_to_string(p_lead, ', ') AS player_lead, array_to_string(p_brought, ', ') AS player_brought,
  array_to_string(o_brought, ', ') AS opponent_brought, array_to_string(p_team, ', ') AS player_team, array_to_string(o_team, ', ') AS opponent_team,
  p_faints, o_faints, illegal AS illegal_species_detected, len(p_brought) >= 4 AS player_team_known, len(o_brought) >= 4 AS opponent_team_known,
  len(p_brought) >= 4 AND illegal = '' AS complete_data FROM pm""")
def match_list(ev):
    lists = ["player_lead", "player_brought", "opponent_brought", "player_team", "opponent_team",
             "illegal_species_detected"]
    rows = r.match_list(r.per_match(ev))
    return rows.withColumns({x: F.array_join(x, ", ") for x in lists})


@on_matches("completeness_counts", f"""
WITH {PM} SELECT u AS user_id, j AS job_id, count(*) FILTER (WHERE NOT (len(p_brought) >= 4 AND illegal = '') OR winner = 'unknown') AS incomplete,
  count(*) FILTER (WHERE illegal <> '') AS with_illegal_species FROM pm GROUP BY 1, 2""")
def completeness_counts(ev):
    return r.completeness_counts(r.per_match(ev), JOB)


@on_matches("system_read", f"""
WITH {PM} SELECT {AS_KEY}, array_to_string(p_team, ', ') AS player_team, array_to_string(p_brought, ', ') AS player_brought, winner, winner_detail FROM pm""")
def system_read(ev):
    return r.system_read(r.per_match(ev)).select(*KEY, *text("player_team", "player_brought"), "winner", "winner_detail")


@on_matches("failure_runs", f"""
WITH {PM}, x AS (SELECT u, j, m, winner = 'unknown' OR len(p_brought) = 0 bad FROM pm),
y AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY u, j ORDER BY m) g FROM x)
SELECT user_id, job_id, max(n) AS longest_run, max(n) >= 3 AS stops
FROM (SELECT u AS user_id, j AS job_id, g, count(*) n FROM y WHERE bad GROUP BY ALL) GROUP BY ALL""")
def failure_runs(ev):
    bad = (F.col("winner") == "unknown") | (F.size("player_brought") == 0)
    return r.failure_runs(r.per_match(ev), JOB, "match", bad)


@on_matches("segment_by_marker", """
SELECT user_id_text AS user_id, job_id, event_idx, cast(greatest(1, count(*) FILTER (WHERE event = 'team_preview' AND event_idx >= 7)
  OVER (PARTITION BY job_id ORDER BY event_idx)) AS INT) AS match FROM {ev}""")
def segment_by_marker(ev):
    """Match numbers found again from the previews alone; the first preview of an upload went unread."""
    unread = (F.col("event") == "team_preview") & (F.col("event_idx") < 7)
    return r.segment_by_marker(ev.withColumn("event", F.when(unread, "unread").otherwise(F.col("event"))).drop("match")).select(*JOB, "event_idx", "match")


_JOBTIME = "SELECT *, (event_idx * 5 - match * 20)::DOUBLE t FROM {ev}"


@on_matches("collapse_bursts", f"""
WITH x AS ({_JOBTIME}), f AS (SELECT *, lag(t) OVER (PARTITION BY job_id ORDER BY event_idx) p FROM x WHERE event = 'stat_change'),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY event_idx) c FROM f)
SELECT user_id_text AS user_id, job_id, max(event_idx) AS event_idx FROM g GROUP BY user_id_text, job_id, c""")
def collapse_bursts(ev):
    marks = ev.withColumn("timestamp", (F.col("event_idx") * 5 - F.col("match") * 20).cast("double"))
    marks = marks.where("event = 'stat_change'").select(*JOB, "event_idx", "timestamp")
    return r.collapse_bursts(marks, JOB, "event_idx", gap=30.0).drop("timestamp")


_PHRASES = """CASE WHEN lower(trim(winner)) IN ('player', 'opponent') THEN lower(trim(winner))
  WHEN regexp_matches(lower(coalesce(detail, '') || ' ' || coalesce(actor, '')), 'you won|you win|victory|player won|defeated the opponent') THEN 'player'
  WHEN regexp_matches(lower(coalesce(detail, '') || ' ' || coalesce(actor, '')), 'you lost|you were defeated|you whited out|you blacked out|opponent won|player lost|defeat') THEN 'opponent'
  WHEN lower(trim(actor)) IN ('player', 'opponent') THEN lower(trim(actor)) ELSE 'unknown' END"""


@on_matches("matches_from_previews", f"""
WITH x AS (SELECT user_id_text u, job_id j, event_idx, event, winner, detail, actor, event_idx * 5.0::DOUBLE t FROM {{ev}}
  WHERE event = 'team_preview' OR (event = 'battle_end' AND k % 8 <> 0)),
p AS (SELECT *, lead(t) OVER (PARTITION BY j ORDER BY event_idx) nx FROM x WHERE event = 'team_preview'),
e AS (SELECT p.u, p.j, p.t st, x.t, {_PHRASES.replace('winner', 'x.winner').replace('detail', 'x.detail').replace('actor', 'x.actor')} w, x.detail d
  FROM p LEFT JOIN x ON x.j = p.j AND x.event = 'battle_end' AND x.t >= p.t AND (p.nx IS NULL OR x.t < p.nx)
  QUALIFY row_number() OVER (PARTITION BY p.j, p.t ORDER BY x.t DESC) = 1)
SELECT u AS user_id, j AS job_id, coalesce(t, st) AS timestamp, CASE WHEN t IS NULL THEN 'unknown' ELSE w END AS winner,
  CASE WHEN t IS NULL THEN '(no end-of-match screen captured)' ELSE d END AS detail FROM e""")
def matches_from_previews(ev):
    timed = ev.withColumn("timestamp", F.col("event_idx") * 5.0)
    unread = (F.col("event") == "battle_end") & (F.col("k") % 8 == 0)
    return r.matches_from_previews(timed.withColumn("event", F.when(unread, "unread").otherwise(F.col("event"))))
