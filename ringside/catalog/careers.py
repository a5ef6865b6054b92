"""Queries over a player's uploads."""

import re

from pyspark.sql import functions as F

from ringside.catalog.records import SCORES
from ringside.catalog.registry import on_matches
from ringside.catalog.snippets import PM
from ringside.operators import history as h
from ringside.operators import record as r
from ringside.plans import jobs as side

SESSIONS = f"""
jobs AS ({side.JOBS_SQL.strip()}),
ranked AS (SELECT *, cast(row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', first_ts), job_id) AS INT) session FROM jobs WHERE status = 'done'),
kept AS (SELECT * FROM ev),
ses AS (SELECT r.user_id, r.session, r.job_id, r.first_ts, n.n matches_in_session FROM ranked r JOIN (SELECT job_id, count(DISTINCT match) n FROM kept GROUP BY 1) n USING (job_id)),
gm AS (SELECT user_id, session, job_id, match, cast(row_number() OVER (PARTITION BY user_id ORDER BY session, match) AS INT) global_match
  FROM (SELECT DISTINCT s.user_id, s.session, s.job_id, k.match FROM ses s JOIN kept k USING (job_id)))
"""


def both(ev):
    return h.sessions(side.jobs(ev), ev), ev


@on_matches("completed_jobs", f"WITH {SESSIONS} SELECT user_id, job_id, source_type, epoch(date_trunc('second', first_ts))::DOUBLE AS created_ts FROM jobs WHERE status = 'done'")
def completed_jobs(ev):
    return h.completed_jobs(side.jobs(ev)).select("user_id", "job_id", "source_type", "created_ts")


@on_matches("sessions", f"WITH {SESSIONS} SELECT user_id, session, job_id, matches_in_session FROM ses")
def sessions(ev):
    return both(ev)[0].select("user_id", "session", "job_id", "matches_in_session")


@on_matches("global_matches", f"WITH {SESSIONS} SELECT user_id, session, job_id, match, global_match FROM gm")
def global_matches(ev):
    return h.global_matches(*both(ev)).select("user_id", "session", "job_id", "match", "global_match")


@on_matches("merged_events", f"WITH {SESSIONS} SELECT k.event_id, s.user_id, s.session, s.job_id AS source_job_id, g.global_match FROM kept k JOIN ses s USING (job_id) JOIN gm g ON g.job_id = k.job_id AND g.match = k.match")
def merged_events(ev):
    return h.merged_events(*both(ev)).select("event_id", "user_id", "session", "source_job_id", "global_match")


@on_matches("filter_by_date", f"WITH {SESSIONS} SELECT user_id, session, job_id FROM ses WHERE date_trunc('second', first_ts) BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'")
def filter_by_date(ev):
    return h.filter_by_date(both(ev)[0], "2024-01-05", "2024-01-20").select("user_id", "session", "job_id")


@on_matches("events_of_sessions", f"WITH {SESSIONS} SELECT k.event_id FROM kept k JOIN ses s USING (job_id) WHERE date_trunc('second', first_ts) >= TIMESTAMP '2024-01-10 00:00:00'")
def events_of_sessions(ev):
    rows, events = both(ev)
    return h.events_of_sessions(events, h.filter_by_date(rows, "2024-01-10", "not a day")).select("event_id")


@on_matches("events_for_and_through_session", f"""WITH {SESSIONS} SELECT s.user_id, count(*) FILTER (WHERE session = 2) AS in_second, count(*) FILTER (WHERE session <= 2) AS through_second
FROM kept k JOIN ses s USING (job_id) WHERE session <= 2 GROUP BY 1""")
def events_for_session(ev):
    merged = h.merged_events(*both(ev))
    through = h.events_through_session(merged, 2).groupBy("user_id").agg(F.count("*").alias("through_second"))
    alone = h.events_for_session(merged, 2).groupBy("user_id").agg(F.count("*").alias("in_second"))
    return through.join(alone, "user_id", "left").fillna(0)


def _trend(by, source, extra=""):
    cols = by.split(", ")
    return SCORES.format(by=by, by_cols=", ".join({"user_id": "u AS user_id"}.get(x, x) for x in cols), source=source)


_PLAYED = "SELECT pm.*, s.session FROM pm JOIN ses s ON s.job_id = pm.j WHERE winner IN ('player', 'opponent')"
_THROUGH = "SELECT pm.*, s2.session FROM pm JOIN ses s ON s.job_id = pm.j JOIN ses s2 ON s2.user_id = s.user_id AND s.session <= s2.session WHERE winner IN ('player', 'opponent')"


@on_matches("skill_trend_sessions", f"WITH {PM}, {SESSIONS}, " + _trend("user_id, session", _PLAYED) + """
SELECT s.user_id, s.session, s.matches_in_session, x.matches_analyzed AS session_matches_analyzed, tempo AS session_tempo, adaptability AS session_adaptability,
  execution AS session_execution, closing AS session_closing, overall AS session_overall FROM ses s LEFT JOIN scores x USING (user_id, session)""")
def skill_trend_sessions(ev):
    rows, events = both(ev)
    trend = h.skill_trend(r.per_match(events), rows)
    return trend.select("user_id", "session", "matches_in_session", *[x for x in trend.columns if x.startswith("session_")
                        and x not in ("session_tier", "session_matches_to_next_tier")])


@on_matches("skill_trend_cumulative", f"WITH {PM}, {SESSIONS}, " + _trend("user_id, session", _THROUGH) + """
SELECT s.user_id, s.session, x.matches_analyzed AS total_matches_analyzed, tempo AS total_tempo, adaptability AS total_adaptability,
  execution AS total_execution, closing AS total_closing, overall AS total_overall FROM ses s LEFT JOIN scores x USING (user_id, session)""")
def skill_trend_cumulative(ev):
    rows, events = both(ev)
    trend = h.skill_trend(r.per_match(events), rows)
    return trend.select("user_id", "session", *[x for x in trend.columns if x.startswith("total_")
                        and x not in ("total_tier", "total_matches_to_next_tier")])


@on_matches("matches_through_session", f"""WITH {PM}, {SESSIONS}, x AS (SELECT s.user_id, s.session, pm.winner FROM pm JOIN ses s ON s.job_id = pm.j WHERE winner <> 'unknown' OR len(p_brought) > 0)
SELECT s.user_id, s.session, count(x.winner) AS games, count(*) FILTER (WHERE winner = 'player') AS wins, count(*) FILTER (WHERE winner = 'opponent') AS losses
FROM ses s LEFT JOIN x ON x.user_id = s.user_id AND x.session <= s.session GROUP BY 1, 2""")
def matches_through(ev):
    rows, events = both(ev)
    return h.matches_through(r.per_match(events), rows)


@on_matches("record_rollup", f"""WITH {PM}, {SESSIONS} SELECT u AS user_id, session, count(*) FILTER (WHERE winner = 'player') AS wins, count(*) FILTER (WHERE winner = 'opponent') AS losses, count(*) AS total_games
FROM pm JOIN ses s ON s.job_id = pm.j WHERE winner <> 'unknown' OR len(p_brought) > 0 GROUP BY GROUPING SETS ((u, session), (u))""")
def record_rollup(ev):
    rows, events = both(ev)
    return r.record_rollup(h.with_session(r.per_match(events), rows))


def _period(name, condition):
    return f"""{name}m AS (SELECT pm.* FROM pm JOIN jobs ON jobs.job_id = pm.j WHERE {condition})"""


def _figures(name):
    body = SCORES.format(by="user_id", by_cols="u AS user_id", source=f"SELECT * FROM {name}m WHERE winner IN ('player', 'opponent')")
    for cte in ("scores", "d", "le", "be", "s0", "s1"):
        body = re.sub(rf"\b{cte}\b(?=\.| AS \(| USING| LEFT| GROUP|\)| WHERE)", f"{name}_{cte}", body)
        body = re.sub(rf"(?<=FROM ){cte}\b", f"{name}_{cte}", body)
        body = re.sub(rf"(?<=JOIN ){cte}\b", f"{name}_{cte}", body)
    return body


_RATE = """{n}r AS (SELECT u AS user_id, cast(coalesce(round_even(100.0 * count(*) FILTER (WHERE winner = 'player') / nullif(count(*) FILTER (WHERE winner <> 'unknown'), 0), 1), 0) AS DOUBLE) win_rate
  FROM {n}m WHERE winner <> 'unknown' OR len(p_brought) > 0 GROUP BY 1)"""


@on_matches("period_compare", f"WITH {PM}, jobs AS ({side.JOBS_SQL.strip()}), "
            + _period("a", "job_no % 2 = 1 AND u <> 'u3'") + ", " + _period("b", "job_no % 2 = 0 OR u = 'u3'") + ", "
            + _figures("a") + ", " + _figures("b") + ", " + _RATE.format(n="a") + ", " + _RATE.format(n="b") + """
SELECT user_id, """ + ", ".join(f"cast(round_even(x.{m} - y.{m}, 1) AS DOUBLE) AS {m}_delta" for m in ("win_rate", "overall", "tempo", "adaptability", "execution", "closing")) + """
FROM (SELECT * FROM ar LEFT JOIN a_scores USING (user_id)) x FULL JOIN (SELECT * FROM br LEFT JOIN b_scores USING (user_id)) y USING (user_id)""")
def period_compare(ev):
    """Odd uploads against even ones; all uploads of one user are on the second side."""
    first = r.per_match(ev.where("job_no % 2 = 1 and user_id <> 'u3'"))
    second = r.per_match(ev.where("job_no % 2 = 0 or user_id = 'u3'"))
    return h.period_compare(first, second)


@on_matches("match_durations", f"""WITH {SESSIONS}, w AS (SELECT job_id, match, (max(event_idx) * 5 + max(match_id) % 4 - min(event_idx) * 5)::DOUBLE d FROM ev WHERE match_id % 6 <> 5 GROUP BY 1, 2)
SELECT user_id, session, job_id, match, global_match, d AS duration_seconds FROM gm LEFT JOIN w USING (job_id, match)""")
def match_durations(ev):
    rows, events = both(ev)
    return h.match_durations(rows, h.global_matches(rows, events), side.match_windows(ev))


@on_matches("session_blocks")
def session_blocks(ev):
    return h.session_blocks(r.per_match(ev), h.sessions(side.jobs(ev), ev))


@on_matches("session_block_headers", f"""WITH {SESSIONS} SELECT user_id, session, 'SESSION ' || session || ' (' || strftime(first_ts, '%Y-%m-%d') || ', ' || matches_in_session || CASE matches_in_session WHEN 1 THEN ' match' ELSE ' matches' END || ', job ' || job_id || '):' AS header FROM ses""")
def session_block_headers(ev):
    rows, events = both(ev)
    blocks = h.session_blocks(r.per_match(events), rows)
    return blocks.select("user_id", "session", F.substring_index("block", "\n", 1).alias("header"))
