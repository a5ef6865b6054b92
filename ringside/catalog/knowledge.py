"""Queries over text sources, the audit log, coaching tables and streams run as batches."""

from pyspark.sql import functions as F

from ringside.catalog.careers import SESSIONS, both
from ringside.catalog.registry import on_matches, query
from ringside.catalog.snippets import DECIDED, PM
from ringside.operators import coaching as co
from ringside.operators import meta as m
from ringside.operators import record as r
from ringside.plans.bridge import match_events
from ringside.sources import readers as s
from ringside.sources import sinks
from ringside.streaming import live


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _payloads(ev):
    """JSON text of every bridge match (40 rows each) in four accepted shapes."""
    turn = F.when(F.col("k") % 2 == 0, F.col("turn_raw"))
    row = F.struct("timestamp", "event", "actor", "pokemon", F.col("hp_raw").alias("hp_percent"), turn.alias("turn"),
                   F.array_join("player_active", ", ").alias("player_active"), "confidence")
    rows = ev.groupBy("job_id", "match", "match_id").agg(F.sort_array(F.collect_list(F.struct("pos", row.alias("e")))).alias("l"))
    events = F.to_json(F.transform("l", lambda x: x["e"]))
    wrap = lambda name: F.concat(F.lit(f'{{"{name}": '), events, F.lit("}"))
    text = (F.when(F.col("match_id") % 4 == 0, events).when(F.col("match_id") % 4 == 1, wrap("events"))
            .when(F.col("match_id") % 4 == 2, wrap("items")).otherwise(wrap("data")))
    return rows.select(F.concat_ws("/", "job_id", "match").alias("job_id"), "match_id", text.alias("text"))


@on_matches("normalize_ai_payload", "SELECT job_id || '/' || match AS job_id, pos FROM {ev}")
def normalize_ai_payload(ev):
    return s.normalize_ai_payload(_payloads(ev), ["job_id"]).select("job_id", "pos")


@on_matches("silver_events", """SELECT job_id || '/' || match AS job_id, pos::BIGINT AS event_idx, timestamp, event, actor, pokemon,
  CASE WHEN event = 'hp_change' THEN round(hp_percent, 6) END AS hp_percent, CASE WHEN k % 2 = 0 THEN try_cast(trim(turn_raw) AS INT) END AS turn, coalesce(player_active, '') AS player_active, confidence FROM {ev}""")
def silver_events(ev):
    rows = s.silver_events(s.normalize_ai_payload(_payloads(ev), ["job_id"]))
    return rows.select("job_id", "event_idx", "timestamp", "event", "actor", "pokemon", F.round("hp_percent", 6).alias("hp_percent"), "turn",
                       F.array_join("player_active", ", ").alias("player_active"), "confidence")


@on_matches("batch_results", """SELECT match_id, CASE match_id % 6 WHEN 3 THEN 'quota' WHEN 4 THEN 'empty response (no ''response'' field in result line)' WHEN 5 THEN 'could not parse response text as JSON: no events seen' END AS error,
  CASE WHEN match_id % 6 < 3 THEN 40 END AS n FROM {ev} WHERE pos = 0""")
def batch_results(ev):
    """Answers that are plain, fenced, wrapped in talk, failed, empty and unreadable."""
    rows = _payloads(ev.withColumn("match_id", F.col("match_id")))
    kind = F.col("match_id") % 6
    said = (F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("```json\n"), "text", F.lit("\n```")))
            .when(kind == 2, F.concat(F.lit("Here you go: "), "text", F.lit(" - done"))).otherwise("no events seen"))
    part = F.struct(F.array(F.struct(F.struct(F.array(F.struct(said.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    line = F.to_json(F.struct(
        F.concat(F.lit("match"), "match_id", F.lit("::chunk0")).alias("key"), F.when(kind == 3, "quota").alias("error"),
        F.when(kind != 4, part).alias("response")))
    out = s.batch_results(rows.select(line.alias("line")))
    n = F.size(s._array_rows(F.col("events")))
    return out.select(F.col("match").cast("bigint").alias("match_id"), "error", F.when(F.col("error").isNull(), n).alias("n"))


_USAGE = """x AS (SELECT match % 3 src, pokemon sp, count(*) n FROM ev WHERE pokemon IS NOT NULL GROUP BY ALL), t AS (SELECT src, sum(n) a FROM x GROUP BY 1)"""


def _usage_texts(ev):
    """A usage table per source from the bridge counts: at most 24 species each; source 2 is not a table."""
    counts = ev.where("pokemon is not null").groupBy((F.col("match") % 3).alias("source"), "pokemon").agg(F.count("*").alias("n"))
    totals = counts.groupBy("source").agg(F.sum("n").alias("a"), F.array_join(F.sort_array(F.collect_list(F.concat(
        F.lit("| "), F.lpad(F.col("n").cast("string"), 6, " "), F.lit(" | "), F.rpad("pokemon", 20, " "), F.lit("| "), (F.col("n") / 8).cast("string"), F.lit("% | 1 |")))), "\n").alias("rows"))
    text = F.when(F.col("source") == 2, "404 not found").otherwise(F.concat(F.lit(" Total battles: "), "a", F.lit("\n + --- +\n"), "rows"))
    return totals.select("source", text.alias("text"))


@on_matches("usage_stats", f"WITH {_USAGE} SELECT src AS source, sp AS species, n / 8.0::DOUBLE AS pct, a::BIGINT AS total_battles FROM x JOIN t USING (src) WHERE src <> 2")
def usage_stats(ev):
    return m.usage_stats(_usage_texts(ev), ["source"])


@on_matches("moveset_stats", """SELECT match % 3 AS source, pokemon AS species, count(*) AS raw_count, 'Moves' AS section, detail AS label, 0.0::DOUBLE AS pct FROM ev WHERE false GROUP BY ALL
UNION ALL SELECT src, sp, n, sec, lab, pct FROM (
  SELECT b.src, b.sp, b.n, l.sec, l.lab, l.pct FROM (SELECT match % 3 src, pokemon sp, count(*) n FROM ev WHERE pokemon IS NOT NULL GROUP BY ALL) b
  JOIN (VALUES ('Abilities', 'Intimidate', 90.5::DOUBLE), ('Items', 'Sitrus Berry', 60.25::DOUBLE), ('Spreads', 'Jolly:2/32/0/0/0/32', 12.0::DOUBLE), ('Moves', 'Fake Out', 99.125::DOUBLE), ('Moves', 'Protect', 50.0::DOUBLE)) l(sec, lab, pct) ON true)""")
def moveset_stats(ev):
    """Block text per species of the bridge: name, raw count and four sections; at most 24 blocks per source."""
    counts = ev.where("pokemon is not null").groupBy((F.col("match") % 3).alias("source"), "pokemon").agg(F.count("*").alias("n"))
    bar = F.lit("\n +----------------+\n")
    part = lambda name, *rows: F.concat(bar, F.lit(f" | {name} |\n" + "\n".join(f" | {x} | " for x in rows)))
    block = F.concat(F.lit(" | "), "pokemon", F.lit(" |"), bar, F.lit(" | Raw count: "), "n", F.lit(" |"),
                     part("Abilities", "Intimidate 90.5%"), part("Items", "Sitrus Berry 60.25%"), part("Spreads", "Jolly:2/32/0/0/0/32 12.0%"),
                     part("Moves", "Fake Out 99.125%", "Protect 50%"), bar)
    block = F.regexp_replace(block, "(?m)^ ", "")
    texts = counts.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list(block)), "").alias("text"))
    return m.moveset_stats(texts, ["source"])


@query("first_available", """WITH x AS (SELECT user_id, event_id % 4 AS months_back, CASE (event_id // 4) % 4 WHEN 0 THEN 1760 WHEN 1 THEN 1630 WHEN 2 THEN 1500 ELSE 0 END AS cutoff, count(*) FILTER (WHERE event_type = 'click') AS rows_found FROM events GROUP BY ALL)
SELECT * FROM x WHERE rows_found > 0 AND months_back <= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY months_back, -cutoff) = 1""")
def first_available(spark, sf_dir):
    rows = read(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id % 4 as months_back", "element_at(array(1760, 1630, 1500, 0), cast(event_id div 4 % 4 + 1 as int)) as cutoff", "event_type")
    rows = rows.groupBy("user_id", "months_back", "cutoff").agg(F.count_if(F.col("event_type") == "click").alias("rows_found"))
    return m.first_available(rows, ["user_id"])


@on_matches("missing_reference", """SELECT DISTINCT pokemon AS name FROM {ev} WHERE pokemon IS NOT NULL AND pokemon NOT IN (SELECT pokemon FROM ev WHERE job_no = 0 AND actor = 'player' AND pokemon IS NOT NULL AND pokemon <> 'Garchomp')""")
def missing_reference(ev):
    named = ev.where("pokemon is not null").select(F.col("pokemon").alias("name"))
    dex = ev.where("job_no = 0 and actor = 'player' and pokemon is not null").select(
        F.col("pokemon").alias("name"), F.when(F.col("pokemon") != "Garchomp", F.lit("{}")).alias("base_stats")).distinct()
    return m.missing_reference(named, dex)


def _audit(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("created_at"), "user_id")


@query("audit_counts", "SELECT event_type, cast(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def audit_counts(spark, sf_dir):
    return m.audit_counts(_audit(spark, sf_dir))


@query("read_audit_tail", "SELECT event_id, event_type FROM events WHERE event_id % 5 <> 0 ORDER BY event_id DESC LIMIT 200")
def read_audit_tail(spark, sf_dir):
    """Audit lines, every fifth of them malformed; the last 200 readable ones."""
    ev = read(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.to_json(F.struct("event_type", F.lit(1.5).alias("created_at"))))
    rows = s.audit_rows(ev.select("event_id", line.alias("value")), "event_id")
    return s.last_rows(rows, "event_id", 200).select("event_id", "event_type")


@query("merge_meta", "SELECT event_type AS part, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'new' ELSE 'old' END AS version FROM events WHERE event_type NOT IN ('click', 'view') OR event_id % 2 = 0")
def merge_meta(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("event_type").alias("part"), "event_id")
    new = ev.where("part in ('click', 'view') and event_id % 2 = 0").withColumn("version", F.lit("new"))
    return m.merge_meta(new, ev.withColumn("version", F.lit("old")))


@query("meta_context")
def meta_context(spark, sf_dir):
    ev = match_events(spark, sf_dir)
    rules = spark.createDataFrame([("VGC", 2, 4, 6, ["mega", "terastallization_no"])], "format_name string, active_per_side int, bring_count int, team_size int, legal_mechanics array<string>")
    usage = m.usage_stats(_usage_texts(ev.withColumn("match", F.lit(0))), ["source"])  # one table over all matches
    return m.meta_context(rules, r.worst_matchups(r.per_match(ev), ["user_id"]), usage, ["user_id"])


# ---- coaching tables from orders and customers ----

def _links(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as token", "o_custkey as owner_user_id", "o_orderpriority as label", "o_orderdate as created_at",
        "case when o_orderkey % 3 = 0 then o_orderdate + interval 400 days end as expires_at", "case when o_orderstatus = 'P' then o_orderdate end as revoked_at")


@query("active_share_links", "SELECT cast(o_orderkey AS VARCHAR) AS token FROM orders WHERE o_orderstatus <> 'P' AND (o_orderkey % 3 <> 0 OR o_orderdate + INTERVAL 400 DAY >= TIMESTAMP '1997-01-01 00:00:00')")
def active_share_links(spark, sf_dir):
    return co.active_share_links(_links(spark, sf_dir), F.lit("1997-01-01 00:00:00").cast("timestamp")).select("token")


@query("share_links_list", "SELECT cast(o_orderkey AS VARCHAR) AS token, o_custkey AS owner_user_id, o_orderstatus = 'P' AS revoked FROM orders")
def share_links_list(spark, sf_dir):
    rows = co.share_links_list(_links(spark, sf_dir))
    return rows.select("token", "owner_user_id", F.col("revoked_at").isNotNull().alias("revoked"))


def _students(spark, sf_dir):
    return read(spark, sf_dir, "customer").selectExpr("c_nationkey as coach_user_id", "'u' || cast(c_custkey % 14 as string) as player_user_id", "c_custkey as added_at").dropDuplicates(["coach_user_id", "player_user_id"])


_ST = "st AS (SELECT DISTINCT c_nationkey coach, 'u' || c_custkey % 14 player FROM customer)"


@query("students_list", f"WITH {_ST} SELECT coach AS coach_user_id, player AS player_user_id FROM st WHERE coach = 7")
def students_list(spark, sf_dir):
    return co.students_list(_students(spark, sf_dir), 7).select("coach_user_id", "player_user_id")


@query("authorized_students", f"WITH {_ST} SELECT o_orderkey FROM orders JOIN st ON st.coach = o_custkey % 25 AND st.player = 'u' || o_orderkey % 16")
def authorized_students(spark, sf_dir):
    asked = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 25 as coach_user_id", "'u' || cast(o_orderkey % 16 as string) as player_user_id")
    return co.authorized_students(_students(spark, sf_dir), asked).select("o_orderkey")


def _notes(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_custkey % 25 as coach_user_id", "'u' || cast(o_orderkey % 16 as string) as player_user_id", "o_orderpriority as text", "o_orderdate as created_at")


@query("notes_by_coach", f"WITH {_ST} SELECT o_orderkey AS id, coach AS coach_user_id, player AS player_user_id, o_orderpriority AS text FROM orders JOIN st ON st.coach = o_custkey % 25 AND st.player = 'u' || o_orderkey % 16")
def notes_by_coach(spark, sf_dir):
    return co.notes_by_coach(_notes(spark, sf_dir), _students(spark, sf_dir)).select("id", "coach_user_id", "player_user_id", "text")


@query("notes_about", "SELECT o_orderkey AS id, o_custkey % 25 AS coach_user_id FROM orders WHERE o_orderkey % 16 = 3")
def notes_about(spark, sf_dir):
    return co.notes_about(_notes(spark, sf_dir), "u3").select("id", "coach_user_id")


@query("mentioned_matches", """WITH x AS (SELECT conv_id, turn, unnest(list_distinct(list_transform(regexp_extract_all(
  text || ' match ' || conv_id || ' and game #' || (turn + 2) || ' or 7', '(?i)(?:match|game|g)\\s*#?\\s*(\\d+)', 1), lambda x: x::BIGINT))) AS match FROM conversations)
SELECT x.conv_id, x.turn, x.match FROM x JOIN (SELECT DISTINCT conv_id, turn AS match FROM conversations) k ON k.conv_id = x.conv_id AND k.match = x.match""")
def mentioned_matches(spark, sf_dir):
    """A conversation's turns stand for its owner's matches: messages keep the numbers that are among them."""
    rows = read(spark, sf_dir, "conversations")
    said = F.concat("text", F.lit(" match "), "conv_id", F.lit(" and game #"), F.col("turn") + 2, F.lit(" or 7"))
    messages = rows.select("conv_id", "turn", said.alias("text"))
    return co.mentioned_matches(messages, rows.select("conv_id", F.col("turn").alias("match")), ["conv_id"]).select("conv_id", "turn", F.col("match"))


@query("student_profiles", f"""WITH {PM}, {SESSIONS}, {_ST}, k AS (SELECT pm.* FROM pm JOIN jobs ON jobs.job_id = pm.j),
rec AS (SELECT u, count(*) FILTER (WHERE winner <> 'unknown') matches, count(*) FILTER (WHERE won) wins, count(*) FILTER (WHERE winner = 'opponent') losses
  FROM k WHERE winner <> 'unknown' OR len(p_brought) > 0 GROUP BY u), sn AS (SELECT user_id, count(*) n FROM ses GROUP BY 1)
SELECT coach AS coach_user_id, u AS user_id, matches, wins, losses, coalesce(sn.n, 0) AS sessions_count FROM st JOIN rec ON rec.u = st.player LEFT JOIN sn ON sn.user_id = u""")
def student_profiles(spark, sf_dir):
    ev = match_events(spark, sf_dir)
    rows, events = both(ev)
    profiles = co.student_profiles(_students(spark, sf_dir), r.per_match(events), rows)
    return profiles.select("coach_user_id", "user_id", "matches", "wins", "losses", "sessions_count")


# ---- reports ----

@on_matches("report_text", f"""WITH {PM}, g AS (SELECT u, count(*) FILTER (WHERE won) w, count(*) n FROM ({DECIDED}) GROUP BY 1)
SELECT u AS user_id, '# Coaching Report' || chr(10) || '- Matches: **' || n || '**  |  Record: **' || w || '-' || (n - w) || '**' AS value FROM g""")
def report_text(ev):
    by = ["user_id"]
    base = r.record(r.per_match(ev), by)
    title = base.select(*by, F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit("# Coaching Report").alias("line"))
    line = F.concat(F.lit("- Matches: **"), "matches", F.lit("**  |  Record: **"), "wins", F.lit("-"), "losses", F.lit("**"))
    return sinks.report_text(title.unionByName(base.select(*by, F.lit(1).alias("part"), F.lit(0).alias("place"), line.alias("line"))), by)


@on_matches("events_csv", "SELECT event_id::VARCHAR AS event_id, coalesce(player_team, '') AS player_team, timestamp::BIGINT::VARCHAR AS seconds FROM {ev}")
def events_csv(ev):
    flat = sinks.events_csv(ev.select("event_id", "player_team", F.col("timestamp").cast("bigint").alias("seconds")))
    return flat.withColumn("player_team", F.coalesce("player_team", F.lit("")))


# ---- the stream operators over a whole table at once ----

@query("audit_window_counts", "SELECT cast(ts AS DATE)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def audit_window_counts(spark, sf_dir):
    rows = live.audit_window_counts(_audit(spark, sf_dir))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("audit_sliding_counts", """SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts) + INTERVAL 12 HOUR * (hour(ts) // 12), date_trunc('day', ts) + INTERVAL 12 HOUR * (hour(ts) // 12) - INTERVAL 12 HOUR]) s FROM events) GROUP BY ALL""")
def audit_sliding_counts(spark, sf_dir):
    rows = live.audit_window_counts(_audit(spark, sf_dir), size="24 hours", slide="12 hours")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("audit_sessions", """WITH x AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) p FROM events),
y AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) g FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM y GROUP BY user_id, g""")
def audit_sessions(spark, sf_dir):
    rows = live.audit_sessions(_audit(spark, sf_dir))
    return rows.withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("start", "end")})

