"""Queries over time series of frames, labels and signals."""

from pyspark.sql import functions as F

from ringside.catalog.registry import on_matches, query
from ringside.contracts import KEY
from ringside.functions import fixed_values as fixed
from ringside.operators import signals as s

U = ["user_id"]


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _frames(ev):
    """Every third row is a frame of its match; the others are events with their own clock."""
    frames = ev.where("event_id % 3 = 0").select(
        *KEY, (F.col("pos") * 2.0 + F.col("k") % 5).alias("t"), F.concat(F.lit("f"), "event_id").alias("path"),
        F.col("event_idx").alias("ord"), F.when(F.col("k") % 6 != 0, F.col("value")).alias("sharpness"))
    events = ev.where("event_id % 3 <> 0").select(*KEY, "event_id", (F.col("pos") * 2.0 + (F.col("k") % 4) * 0.5).alias("timestamp"))
    return events.withColumn("timestamp", F.when(F.col("event_id") % 17 != 0, F.col("timestamp"))), frames


_FR = """f AS (SELECT job_id, match, (pos * 2.0 + k % 5)::DOUBLE t, 'f' || event_id path, event_idx ord, CASE WHEN k % 6 <> 0 THEN value END sh FROM ev WHERE event_id % 3 = 0),
e AS (SELECT job_id, match, event_id, CASE WHEN event_id % 17 <> 0 THEN (pos * 2.0 + (k % 4) * 0.5)::DOUBLE END t FROM ev WHERE event_id % 3 <> 0),
n AS (SELECT e.event_id, arg_min(f.path, (abs(f.t - e.t), f.t, f.ord)) p FROM e LEFT JOIN f ON f.job_id = e.job_id AND f.match = e.match AND e.t IS NOT NULL GROUP BY 1)"""


@on_matches("nearest_frame", f"WITH {_FR} SELECT event_id, p AS nearest_frame FROM n")
def nearest_frame(ev):
    events, frames = _frames(ev)
    return s.nearest_frame(events, frames).select("event_id", "nearest_frame")


@on_matches("attach_reference_frames", f"""WITH {_FR}, q AS (SELECT e.event_id, arg_max(f.path, (f.sh, -f.ord)) p FROM e JOIN f ON f.job_id = e.job_id AND f.match = e.match AND abs(f.t - e.t) <= 1.5 AND f.sh IS NOT NULL GROUP BY 1)
SELECT n.event_id, coalesce(q.p, n.p) AS reference_frame FROM n LEFT JOIN q USING (event_id)""")
def attach_reference_frames(ev):
    events, frames = _frames(ev)
    return s.attach_reference_frames(events, frames, frames).select("event_id", "reference_frame")


@query("dedupe_vectors", """
WITH RECURSIVE n AS (SELECT label, vec_id, embedding::DOUBLE[] v, row_number() OVER (PARTITION BY label ORDER BY vec_id) rn FROM embeddings WHERE embedding IS NOT NULL),
r AS (SELECT label, vec_id, rn, true keep, v kept FROM n WHERE rn = 1
  UNION ALL SELECT label, vec_id, rn, far, CASE WHEN far THEN v ELSE kept END FROM (
    SELECT n.*, r.kept, list_sum(list_transform(list_zip(r.kept, n.v), lambda z: abs(z[1] - z[2]))) / len(n.v) >= 0.14 far FROM r JOIN n ON n.label = r.label AND n.rn = r.rn + 1))
SELECT label, vec_id FROM r WHERE keep""")
def dedupe_vectors(spark, sf_dir):
    """Frame vectors of a label as one video."""
    rows = read(spark, sf_dir, "embeddings").where("embedding is not null")
    return s.dedupe_vectors(rows, ["label"], "vec_id", "embedding", 0.14).select("label", "vec_id")


def _samples(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0 - 473352.0
    return ev.select("user_id", hours.alias("t"), F.col("value").alias("motion"),
                     F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("brightness"), "event_type")


_SM = "sm AS (SELECT user_id, epoch_us(ts) / 3600000000.0::DOUBLE - 473352.0 t, value motion, regexp_extract(props, '([0-9]+)', 1)::DOUBLE b, event_type FROM events)"
_AW = _SM + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) rn FROM sm),
r AS (SELECT user_id, rn, t, t st, motion, b FROM n WHERE rn = 1 UNION ALL
  SELECT n.user_id, n.rn, n.t, CASE WHEN n.t - r.st >= 24 THEN n.t ELSE r.st END, n.motion, n.b FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1),
g AS (SELECT user_id, st, avg(motion) m, avg(b) b FROM r GROUP BY 1, 2),
z AS (SELECT user_id, max(t) l, max(t) FILTER (WHERE rn = 1) t0, max(t) FILTER (WHERE rn = 2) t1 FROM n GROUP BY 1),
aw AS (SELECT user_id, st, coalesce(lead(st) OVER (PARTITION BY user_id ORDER BY st), l + coalesce(t1 - t0, 1)) en, m, b, m >= 50 AND b >= 40 act FROM g JOIN z USING (user_id)),
pd AS (SELECT user_id, greatest(0, st - 6) s, en + 6 e FROM aw WHERE act),
mi AS (SELECT user_id, min(s) s, max(e) e FROM (SELECT *, sum(CASE WHEN pr IS NULL OR s > pr THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) g FROM
  (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pr FROM pd)) GROUP BY user_id, g)"""


def _windows(spark, sf_dir):
    return s.activity_windows(_samples(spark, sf_dir), U, span=24.0, motion=50.0, dark=40.0)


@query("activity_windows", f'WITH RECURSIVE {_AW} SELECT user_id, round(st, 6) AS start, round(en, 6) AS "end", round(m, 6) AS motion, round(b, 6) AS brightness, act AS active FROM aw')
def activity_windows(spark, sf_dir):
    rows = _windows(spark, sf_dir)
    return rows.withColumns({x: F.round(x, 6) for x in ("start", "end", "motion", "brightness")})


@query("merge_intervals", f"WITH RECURSIVE {_AW} SELECT user_id, round(s, 6) AS start_seconds, round(e, 6) AS end_seconds FROM mi")
def merge_intervals(spark, sf_dir):
    rows = s.merge_intervals(_windows(spark, sf_dir), U, 6.0)
    return rows.select("user_id", *[F.round(x, 6).alias(x) for x in ("start_seconds", "end_seconds")])


@query("prefilter_report", f"""WITH RECURSIVE {_AW}, k AS (SELECT user_id, sum(e - s) k FROM mi GROUP BY 1), l AS (SELECT user_id, max(t) len FROM sm GROUP BY 1)
SELECT user_id, round(least(coalesce(k, 0), len), 6) AS kept_seconds, round(len - least(coalesce(k, 0), len), 6) AS dropped_seconds,
  round((len - least(coalesce(k, 0), len)) / len * 100, 6) AS dropped_pct, round(len * 258 / 1000000 * 0.3, 9) AS cost_all, round(least(coalesce(k, 0), len) * 258 / 1000000 * 0.3, 9) AS cost_kept
FROM l LEFT JOIN k USING (user_id)""")
def prefilter_report(spark, sf_dir):
    lengths = _samples(spark, sf_dir).groupBy("user_id").agg(F.max("t").alias("video_seconds"))
    rows = s.prefilter_report(s.merge_intervals(_windows(spark, sf_dir), U, 6.0), lengths, U)
    return rows.select("user_id", *[F.round(x, 6).alias(x) for x in ("kept_seconds", "dropped_seconds", "dropped_pct")],
                       *[F.round(x, 9).alias(x) for x in ("cost_all", "cost_kept")])


def _labels(spark, sf_dir):
    label = F.when(F.col("event_type").isin("click", "view", "error"), "battle").otherwise(F.col("event_type"))
    return _samples(spark, sf_dir).select("user_id", F.col("t").alias("ts"), label.alias("label"))


_LR = _SM + """, lb AS (SELECT user_id, t, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'battle' ELSE event_type END l FROM sm),
g AS (SELECT *, count(*) FILTER (WHERE l <> 'battle') OVER (PARTITION BY user_id ORDER BY t) r FROM lb),
rn AS (SELECT user_id, r, min(t) s, max(t) e FROM g WHERE l = 'battle' GROUP BY 1, 2),
mg AS (SELECT user_id, min(s) s, max(e) e FROM (SELECT *, sum(CASE WHEN p IS NULL OR s - p > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s) g FROM
  (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY s) p FROM rn)) GROUP BY user_id, g),
sg AS (SELECT user_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY s) AS INT) m, s, e + 1 e FROM mg WHERE e - s >= 20)"""


@query("label_runs", f'WITH {_LR} SELECT user_id, r AS run, round(s, 6) AS start, round(e, 6) AS "end" FROM rn')
def label_runs(spark, sf_dir):
    rows = s.label_runs(_labels(spark, sf_dir), U)
    return rows.select("user_id", "run", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def _segments(spark, sf_dir):
    return s.segment_matches(s.label_runs(_labels(spark, sf_dir), U), U, 1.0, 15.0, 20.0)


@query("segment_matches", f"WITH {_LR} SELECT user_id, m AS match, round(s, 6) AS start_seconds, round(e, 6) AS end_seconds FROM sg")
def segment_matches(spark, sf_dir):
    rows = _segments(spark, sf_dir)
    return rows.select("user_id", "match", F.round("start_seconds", 6).alias("start_seconds"), F.round("end_seconds", 6).alias("end_seconds"))


@query("average_match_length", f"WITH {_LR} SELECT user_id, count(*) AS matches, round(avg(e - s), 6) AS avg_seconds FROM sg GROUP BY 1")
def average_match_length(spark, sf_dir):
    return s.average_match_length(_segments(spark, sf_dir), U).withColumn("avg_seconds", F.round("avg_seconds", 6))


@query("label_counts", f"WITH {_LR} SELECT user_id, l AS label, count(*) AS frames FROM lb GROUP BY 1, 2")
def label_counts(spark, sf_dir):
    return s.label_counts(_labels(spark, sf_dir), U)


def _two(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    other = F.when(F.col("event_id") % 7 == 0, "menu").otherwise(F.col("event_type"))
    return (ev.select("user_id", F.col("event_id").alias("ts"), F.col("event_type").alias("label")),
            ev.select("user_id", F.col("event_id").alias("ts"), other.alias("label")))


@query("compare_labels", "SELECT user_id, count(*) AS samples, count(*) FILTER (WHERE event_id % 7 <> 0) AS agreed, cast(round_even(count(*) FILTER (WHERE event_id % 7 <> 0)::DOUBLE / count(*) * 100, 1) AS DOUBLE) AS agreement_pct FROM events GROUP BY 1")
def compare_labels(spark, sf_dir):
    return s.compare_labels(*_two(spark, sf_dir), U)


@query("label_disagreements", "SELECT user_id, event_id AS ts, event_type AS label_a, 'menu' AS label_b FROM events WHERE event_id % 7 = 0")
def label_disagreements(spark, sf_dir):
    return s.label_disagreements(*_two(spark, sf_dir), U)


_T = lambda e: f"split_part('{','.join(fixed.TYPES[:6])}', ',', cast({e} % 6 + 1 as int))"
ROW = ["job_id", "match", "row_no"]


def _reads(ev):
    return ev.select("job_id", "match", (F.col("pos") % 6).alias("row_no"), (F.col("k") % 3).alias("num_badges"), F.expr(
        f"case when k % 3 = 0 then array() when k % 3 = 1 then array({_T('pos')}) else array({_T('pos')}, {_T('(pos + k % 2 + 1)')}) end").alias("types"))


_VT = f"""rd AS (SELECT job_id, match, pos % 6 row_no, k % 3 nb, CASE k % 3 WHEN 0 THEN [] WHEN 1 THEN [{_T('pos')}] ELSE [{_T('pos')}, {_T('(pos + k % 2 + 1)')}] END ts FROM ev),
nf AS (SELECT job_id, match, row_no, count(*) n FROM rd GROUP BY ALL), vt AS (SELECT job_id, match, row_no, t, count(*) v FROM (SELECT job_id, match, row_no, unnest(list_distinct(ts)) t FROM rd) GROUP BY ALL),
bg AS (SELECT job_id, match, row_no, arg_max(nb, (c, nb)) nb FROM (SELECT job_id, match, row_no, nb, count(*) c FROM rd GROUP BY ALL) GROUP BY ALL),
id AS (SELECT job_id, match, row_no, list_sort(list(t)) ts FROM vt JOIN nf USING (job_id, match, row_no) WHERE v >= least(n // 2 + 1, 3) GROUP BY ALL),
vo AS (SELECT nf.*, bg.nb, coalesce(id.ts, []) ts FROM nf JOIN bg USING (job_id, match, row_no) LEFT JOIN id USING (job_id, match, row_no))"""


@on_matches("vote_types", f"WITH {_VT} SELECT job_id, match, row_no, n AS n_frames, nb AS num_badges_found, array_to_string(ts, ', ') AS identified_types FROM vo")
def vote_types(ev):
    return s.vote_types(_reads(ev), ROW).withColumn("identified_types", F.array_join("identified_types", ", "))


_DEXL = "dx(n, ts) AS (VALUES " + ", ".join(f"('{n}', [{', '.join(repr(x) for x in sorted(t))}])" for n, t in fixed.SPECIES_TYPES.items()) + ")"
_NARROW = "(SELECT string_agg(n, ', ' ORDER BY n) FROM dx WHERE len(vo.ts) = 0 OR (CASE WHEN vo.nb <= 1 OR len(vo.ts) >= 2 THEN dx.ts = vo.ts ELSE list_contains(dx.ts, vo.ts[1]) END))"


@on_matches("row_type_hints", f"WITH {_VT}, {_DEXL} SELECT job_id, match, row_no, coalesce({_NARROW}, '') AS candidates FROM vo WHERE len(ts) > 0")
def row_type_hints(ev):
    rows = s.row_type_hints(_reads(ev), ROW)
    return rows.select(*ROW, F.array_join("candidates", ", ").alias("candidates"))


@on_matches("narrow_species_by_types", f"WITH {_VT}, {_DEXL} SELECT job_id, match, row_no, coalesce({_NARROW}, '') AS candidates FROM vo")
def narrow_species(ev):
    rows = s.narrow_species_by_types(s.vote_types(_reads(ev), ROW), "identified_types", "num_badges_found")
    return rows.select(*ROW, F.array_join("candidates", ", ").alias("candidates"))


@on_matches("best_read_by_row", """WITH x AS (SELECT job_id, match, pos % 6 row_no, pos // 12 crop, coalesce(pokemon, 'none') species, max(k) / 100.0::DOUBLE score FROM ev GROUP BY ALL),
y AS (SELECT *, row_number() OVER w rn, lead(score) OVER w nx FROM x WINDOW w AS (PARTITION BY job_id, match, row_no, crop ORDER BY score DESC, species)),
z AS (SELECT *, score - coalesce(nx, 0) gap FROM y WHERE rn = 1 AND score >= 0.5 AND score - coalesce(nx, 0) >= 0.05)
SELECT job_id, match, row_no, arg_min(species, (-round_even(score, 3), crop)) AS species, max(cast(round_even(score, 3) AS DOUBLE)) AS confidence FROM z GROUP BY job_id, match, row_no""")
def best_read_by_row(ev):
    scores = ev.select("job_id", "match", (F.col("pos") % 6).alias("row_no"), F.expr("pos div 12").alias("crop"),
                       F.coalesce("pokemon", F.lit("none")).alias("species"), "k")
    scores = scores.groupBy(*ROW, "crop", "species").agg((F.max("k") / 100.0).alias("score"))
    return s.best_read_by_row(scores, ["crop"], ROW).drop("runner_up_margin")


@on_matches("assign_to_windows", """WITH w AS (SELECT job_id, match, min(event_idx) * 5.0 s, max(event_idx) * 5.0 - 20 + match_id % 4 * 15 e FROM ev GROUP BY job_id, match, match_id)
SELECT ev.event_id, w.match FROM ev JOIN w ON w.job_id = ev.job_id AND ev.event_idx * 5.0 >= w.s AND ev.event_idx * 5.0 < w.e""")
def assign_to_windows(ev):
    windows = ev.groupBy("job_id", "match", "match_id").agg(
        (F.min("event_idx") * 5.0).alias("start_seconds"), (F.max("event_idx") * 5.0 - 20 + F.col("match_id") % 4 * 15).alias("end_seconds"))
    points = ev.select("job_id", "event_id", (F.col("event_idx") * 5.0).alias("t"))
    return s.assign_to_windows(points, windows.drop("match_id"), ["job_id"], block=120.0).select("event_id", "match")


@query("transcript_stats", """SELECT conv_id, count(*) AS segments, cast(sum(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words FROM conversations GROUP BY 1""")
def transcript_stats(spark, sf_dir):
    return s.transcript_stats(read(spark, sf_dir, "conversations"), ["conv_id"])


@on_matches("match_context", """WITH l AS (SELECT user_id_text AS user_id, job_id, match, 1 AS part, event_idx AS place, '  ' || concat_ws(' | ', cast(pos * 5 AS VARCHAR) || 's', event, actor, 'pokemon=' || pokemon, 'detail=' || detail,
  'player_active=' || player_active, 'opponent_active=' || opponent_active, 'player_brought=' || nullif(player_brought, ''), 'opponent_brought=' || nullif(opponent_brought, ''), 'winner=' || winner, 'turn=' || turn) AS line FROM ev)
SELECT * FROM l UNION ALL SELECT user_id_text, job_id, match, 2, rn, '  ' || (pos * 5) || 's: ' || event_type FROM (SELECT *, row_number() OVER (PARTITION BY job_id, match ORDER BY pos) rn FROM ev WHERE k % 2 = 0) WHERE rn <= 60""")
def match_context(ev):
    heard = ev.where("k % 2 = 0").select(*KEY, (F.col("pos") * 5.0).alias("start"), F.col("event_type").alias("text"))
    return s.match_context(ev, heard)
