"""Queries over scalar rules."""

from pyspark.sql import functions as F

from ringside.catalog.registry import on_matches, query
from ringside.catalog.snippets import names
from ringside.catalog.strategy import BANDS, DEX, POSTURE
from ringside.catalog.turns import key_sql
from ringside.functions import columns as c
from ringside.functions import fixed_values as fixed
from ringside.functions.textlines import parse_battle_line

ID = "event_id"


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@on_matches("to_seconds", "SELECT event_id, coalesce(try_cast(turn_raw AS DOUBLE), 0.0::DOUBLE) AS seconds FROM {ev}", raw=True)
def to_seconds(ev):
    return ev.select(ID, c.to_seconds("turn_raw").alias("seconds"))


@on_matches("split_names", f"SELECT event_id, len({names('player_team')}) AS n, {names('player_team')}[1] AS first FROM {{ev}}", raw=True)
def split_names(ev):
    parts = c.split_names("player_team")
    return ev.select(ID, F.size(parts).cast("bigint").alias("n"), F.get(parts, F.lit(0)).alias("first"))


@query("norm", "SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS key FROM documents")
def norm(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", c.norm("text").alias("key"))


_FORMS = """case when k % 6 = 0 then 'Mega ' || pokemon when k % 6 = 1 then pokemon || '-Mega-X' when k % 6 = 2 then 'Alolan ' || pokemon
 when k % 6 = 3 then pokemon || ' (Mega)' when k % 6 = 4 then pokemon || '-Galar' else pokemon end"""


@on_matches("species_key", f"SELECT event_id, {key_sql('(' + _FORMS + ')')} AS key FROM {{ev}} WHERE pokemon IS NOT NULL", raw=True)
def species_key(ev):
    return ev.where("pokemon is not null").select(ID, c.species_key(F.expr(_FORMS)).alias("key"))


@on_matches("normalize_turn", """SELECT event_id, CASE WHEN regexp_full_match(turn_raw, '\\s*-?\\d+\\s*') THEN try_cast(trim(turn_raw) AS INT) END AS turn_no FROM {ev}
WHERE event = 'field_state'""", raw=True)
def normalize_turn(ev):
    """Turns written as numbers, digit strings and words, read through VARIANT."""
    quoted = F.concat(F.lit('"'), "turn_raw", F.lit('"'))
    bare = F.when(F.col("turn_raw").rlike("^[0-9]+$") & (F.col("k") % 2 == 0), F.col("turn_raw")).otherwise(quoted)
    rows = ev.where("event = 'field_state'").select(ID, F.try_parse_json(bare).alias("v"))
    return rows.select(ID, c.normalize_turn("v").alias("turn_no"))


_HP = """CASE WHEN regexp_full_match(b, '\\s*\\d+(\\.\\d+)?\\s*/\\s*\\d+(\\.\\d+)?\\s*')
  THEN CASE WHEN split_part(b, '/', 2)::DOUBLE <> 0 THEN split_part(b, '/', 1)::DOUBLE / split_part(b, '/', 2)::DOUBLE * 100 END
  ELSE try_cast(b AS DOUBLE) END"""


@on_matches("coerce_hp", f"SELECT event_id, round({_HP}, 6) AS hp FROM (SELECT event_id, trim(regexp_replace(hp_raw, '%$', '')) b FROM {{ev}} WHERE event = 'hp_change')", raw=True)
def coerce_hp(ev):
    rows = ev.where("event = 'hp_change'").withColumn("v", F.try_parse_json(F.concat(F.lit('"'), "hp_raw", F.lit('"'))))
    return rows.select(ID, F.round(c.coerce_hp("v"), 6).alias("hp"))


@on_matches("hp_fraction", """SELECT event_id, cast(round_even(greatest(0, least(100, k::DOUBLE / (20 + pos * 3) * 100)), 1) AS DOUBLE) AS hp FROM {ev} WHERE k > 3
UNION ALL SELECT event_id, 0.0::DOUBLE FROM ev WHERE k <= 3""", raw=True)
def hp_fraction(ev):
    field = F.when(F.col("k") > 3, F.concat("k", F.lit("/"), F.col("pos") * 3 + 20, F.lit(" par"))).otherwise("0 fnt")
    return ev.select(ID, c.hp_fraction(field).alias("hp"))


@on_matches("names_of", f"""SELECT event_id, CASE WHEN k % 4 = 2 THEN {names('player_active')}[1] ELSE player_active END AS names FROM {{ev}} WHERE player_active IS NOT NULL""", raw=True)
def names_of(ev):
    """Comma text, list of text, one object and list of objects give the same names."""
    parts = c.split_names("player_active")
    quote = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    entry = lambda x: F.concat(F.lit('{"pokemon":"'), x, F.lit('","hp":100}'))
    listed = lambda items: F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    k = F.col("k") % 4
    text = (F.when(k == 0, quote(F.col("player_active"))).when(k == 1, listed(F.transform(parts, quote)))
            .when(k == 2, entry(F.get(parts, F.lit(0)))).otherwise(listed(F.transform(parts, entry))))
    rows = ev.where("player_active is not null").select(ID, F.try_parse_json(text).alias("v"))
    return rows.select(ID, F.array_join(c.names_of("v"), ", ").alias("names"))


@on_matches("stat_change", """SELECT event_id, regexp_extract(detail, '^(Attack|Defense|Sp\\. Atk|Sp\\. Def|Speed)', 1) AS stat,
  CASE WHEN detail LIKE '%rose' THEN 1 ELSE -1 END AS direction FROM {ev} WHERE event = 'stat_change'
  AND regexp_matches(detail, '^(Attack|Defense|Sp\\. Atk|Sp\\. Def|Speed) (sharply rose|harshly fell|rose|fell)$')""", raw=True)
def stat_change(ev):
    rows = ev.where("event = 'stat_change'").withColumn("s", c.stat_change("detail")).where("s is not null")
    return rows.select(ID, "s.stat", "s.direction")


@on_matches("speed_tool", """SELECT event_id, CASE WHEN lower(detail) IN ('item: choice scarf', 'item: booster energy', 'ability: swift swim')
  THEN trim(split_part(detail, ':', 2)) END AS tool FROM {ev} WHERE event = 'item_or_ability_activated'""", raw=True)
def speed_tool(ev):
    return ev.where("event = 'item_or_ability_activated'").select(ID, c.speed_tool("detail").alias("tool"))


@on_matches("screens_sides", "SELECT event_id, contains(screens, 'player ') AS player_up, contains(screens, 'opponent ') AS opponent_up FROM {ev} WHERE screens IS NOT NULL", raw=True)
def screens_sides(ev):
    return ev.where("screens is not null").select(
        ID, c.screen_up("screens", "player").alias("player_up"), c.screen_up("screens", "opponent").alias("opponent_up"))


@on_matches("move_name", "SELECT event_id, regexp_replace(detail, ' \\(failed\\)$', '') AS move_name FROM {ev} WHERE event = 'move_used'", raw=True)
def move_name(ev):
    return ev.where("event = 'move_used'").select(ID, c.move_name(F.lit(None), "detail").alias("move_name"))


_SENTENCE = """case when k % 7 = 0 then pokemon || ' used ' || detail || '!' when k % 7 = 1 then 'The opposing ' || pokemon || ' used ' || detail
 when k % 7 = 2 then 'used ' || detail || ' on Weavile (shown).' when k % 7 = 3 then detail || ' [seen late] [turn 3]'
 when k % 7 = 4 then 'a Dark-type move' when k % 7 = 5 then detail || ' failed' else detail end"""


@on_matches("move_name_strict", """SELECT event_id, CASE WHEN k % 7 <> 4 THEN regexp_replace(detail, ' \\(failed\\)$', '') END AS move_name FROM {ev} WHERE event = 'move_used'""", raw=True)
def move_name_strict(ev):
    rows = ev.where("event = 'move_used'").withColumn("said", F.expr(_SENTENCE))
    return rows.select(ID, c.move_name_strict(F.lit(None), "said", "pokemon").alias("move_name"))


_WIN = """CASE WHEN regexp_matches(t, '{won}') THEN 'player' WHEN regexp_matches(t, '{lost}') THEN 'opponent'
  WHEN actor IN ('player', 'opponent') THEN actor ELSE 'unknown' END"""


@on_matches("decide_winner", f"""SELECT event_id, {_WIN.format(won='|'.join(fixed.WON_PHRASES), lost='|'.join(fixed.LOST_PHRASES))} AS by_record,
  {_WIN.format(won='|'.join(fixed.WON_PHRASES_SHORT), lost='|'.join(fixed.LOST_PHRASES_SHORT))} AS by_report,
  CASE WHEN actor IN ('player', 'opponent') THEN actor ELSE 'unknown' END AS by_field
FROM (SELECT *, lower(detail || ' ' || actor) t FROM {{ev}} WHERE event = 'battle_end')""", raw=True)
def decide_winner(ev):
    """The three rules on end screens whose winner field is missing."""
    none = F.lit(None).cast("string")
    return ev.where("event = 'battle_end'").select(
        ID, c.winner_by_text(none, "detail", "actor").alias("by_record"),
        c.winner_by_text_short(none, "detail", "actor").alias("by_report"),
        c.winner_by_field(none, "actor").alias("by_field"))


@query("created_at_ts", "SELECT event_id, cast(epoch_us(date_trunc('second', ts)) AS DOUBLE) / 1000000 AS seconds FROM events")
def created_at_ts(spark, sf_dir):
    """ISO text whose offset is ignored, and plain numbers."""
    ev = read(spark, sf_dir, "events")
    zone = F.element_at(F.array(*[F.lit(z) for z in ("Z", "+00:00", "-05:00", "")]), (F.col("event_id") % 4 + 1).cast("int"))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    number = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    text = F.when(F.col("event_id") % 5 == 0, number).otherwise(iso)
    return ev.select("event_id", c.created_at_ts(text).alias("seconds"))


@query("date_boundary", """SELECT event_id, epoch(cast(ts AS DATE))::DOUBLE AS since_ts, epoch(cast(ts AS DATE))::DOUBLE + 86399 AS until_ts FROM events WHERE event_id % 10 <> 0
UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 10 = 0""")
def date_boundary(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    day = F.when(F.col("event_id") % 10 == 0, "last week").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return ev.select("event_id", c.date_boundary(day).alias("since_ts"), c.date_boundary(day, True).alias("until_ts"))


_PRESETS = "CASE event_id % 4 WHEN 0 THEN '7d' WHEN 1 THEN '30d' WHEN 2 THEN 'month' ELSE 'all' END"


@query("preset_range", f"""SELECT event_id, cast(CASE {_PRESETS} WHEN '7d' THEN d - 6 WHEN '30d' THEN d - 29 WHEN 'month' THEN cast(date_trunc('month', d) AS DATE) END AS DATE) AS since
FROM (SELECT event_id, cast(ts AS DATE) d FROM events)""")
def preset_range(spark, sf_dir):
    ev = read(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    return ev.select("event_id", c.preset_range(F.expr(_PRESETS), "d")["since"].alias("since"))


@query("previous_period", """SELECT event_id, d - n AS since, d - 1 AS until
FROM (SELECT event_id, cast(ts AS DATE) d, cast(CASE WHEN event_id % 3 = 0 THEN 30 ELSE event_id % 11 + 1 END AS INT) n FROM events)""")
def previous_period(spark, sf_dir):
    ev = read(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    until = F.when(F.col("event_id") % 3 != 0, F.expr("date_add(d, cast(event_id % 11 as int))"))
    period = c.previous_period(F.col("d"), until)
    return ev.select("event_id", period["since"].alias("since"), period["until"].alias("until"))


@on_matches("pct_clamp_scale", """SELECT event_id, round(CASE WHEN pos = 0 THEN 0 ELSE k / pos * 100 END, 6) AS pct, greatest(10, least(60, k))::DOUBLE AS clamped,
  round(greatest(0, least(100, (k - 20) / 50 * 100)), 6) AS scaled, 50.0::DOUBLE AS flat FROM {ev}""", raw=True)
def pct_clamp_scale(ev):
    return ev.select(
        ID, F.round(c.ratio_pct("k", "pos"), 6).alias("pct"), c.clamp(F.col("k").cast("double"), 10.0, 60.0).alias("clamped"),
        F.round(c.scale("k", 20, 70), 6).alias("scaled"), c.scale("k", 7, 7).alias("flat"))


@on_matches("confidence_tier", """SELECT event_id, CASE WHEN n >= 100 THEN 'Exceptional' WHEN n >= 50 THEN 'Strong' WHEN n >= 25 THEN 'Good understanding' ELSE 'Provisional (building)' END AS tier,
  cast(CASE WHEN n >= 100 THEN NULL WHEN n >= 50 THEN 100 - n WHEN n >= 25 THEN 50 - n ELSE 25 - n END AS BIGINT) AS matches_to_next_tier
FROM (SELECT event_id, k + pos n FROM {ev})""", raw=True)
def confidence_tier(ev):
    tier = c.confidence_tier(F.col("k") + F.col("pos"))
    return ev.select(ID, tier["tier"].alias("tier"), tier["matches_to_next_tier"].alias("matches_to_next_tier"))


@on_matches("win_probability", """SELECT event_id, cast(round_even(50 + 50 * ((exp(s / 30.0) - 1) / (exp(s / 30.0) + 1)), 1) AS DOUBLE) AS win_probability FROM (SELECT event_id, k * 2 - 100 s FROM {ev})""", raw=True)
def win_probability(ev):
    return ev.select(ID, c.win_probability(F.col("k") * 2 - 100).alias("win_probability"))


@on_matches("position_band_and_posture", f"""SELECT event_id, {BANDS.format('s')} AS band, {POSTURE.format(BANDS.format('s'))} AS posture FROM (SELECT event_id, k * 2 - 100 s FROM {{ev}})""", raw=True)
def position_band(ev):
    band = c.position_band(F.col("k") * 2 - 100)
    return ev.select(ID, band.alias("band"), c.risk_posture(band).alias("posture"))


@on_matches("regret_category", """SELECT event_id, CASE WHEN k / 4 <= 5 THEN 'Excellent preview' WHEN k / 4 <= 12 THEN 'Good preview' WHEN k / 4 <= 20 THEN 'Questionable preview' ELSE 'Major preview mistake' END AS category FROM {ev}""", raw=True)
def regret_category(ev):
    return ev.select(ID, c.regret_category(F.col("k") / 4).alias("category"))


_ATTACK = f"split_part('{','.join(fixed.TYPES)}', ',', cast(k % 18 + 1 as int))"
_GUARD = f"split_part('{','.join(fixed.TYPES)}', ',', cast(pos % 18 + 1 as int))"
_GUARD2 = f"split_part('{','.join(fixed.TYPES)}', ',', cast((pos + 5) % 18 + 1 as int))"


@on_matches("type_multiplier", "WITH " + DEX + f""", x AS (SELECT event_id, {_ATTACK} a, {_GUARD} d1, {_GUARD2} d2 FROM ev)
SELECT event_id, coalesce(c1.m, 1)::DOUBLE * coalesce(c2.m, 1)::DOUBLE AS mult FROM x LEFT JOIN chart c1 ON c1.a = x.a AND c1.d = x.d1 LEFT JOIN chart c2 ON c2.a = x.a AND c2.d = x.d2""", raw=True)
def type_multiplier(ev):
    return ev.select(ID, c.type_multiplier(F.expr(_ATTACK), F.array(F.expr(_GUARD), F.expr(_GUARD2))).alias("mult"))


@query("referenced_matches", """SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text || ' match ' || conv_id || ' and game #' || turn, '(?i)(?:match|game|g)\\s*#?\\s*(\\d+)', 1), lambda x: x::BIGINT))), ',') AS matches FROM conversations""")
def referenced_matches(spark, sf_dir):
    said = F.concat("text", F.lit(" match "), "conv_id", F.lit(" and game #"), "turn")
    found = F.array_sort(c.referenced_matches(said))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(found.cast("array<string>"), ",").alias("matches"))


@on_matches("slugs", """SELECT event_id, replace(replace(lower(trim(pokemon || '''s . X')), '''', ''), '.', '') AS s0, replace(replace(replace(lower(trim(pokemon || '''s . X')), '''', ''), '.', ''), ' ', '-') AS slug,
  'gen9championsvgc2026reg' || 'm' || cast(k AS VARCHAR) AS tier FROM {ev} WHERE pokemon IS NOT NULL""", raw=True)
def slugs(ev):
    text = F.concat("pokemon", F.lit("'s . X"))
    return ev.where("pokemon is not null").select(
        ID, F.regexp_replace(F.lower(F.trim(text)), "[.']", "").alias("s0"),
        c.slug(text).alias("slug"), c.tier_slug(F.concat(F.lit("M-"), "k"), F.lit(2026)).alias("tier"))


@on_matches("replace_token", f"""SELECT event_id, array_to_string(list_transform({names('player_active')}, lambda x: CASE WHEN x = 'Garchomp' THEN 'Gabite' ELSE x END), ', ') AS names FROM {{ev}} WHERE player_active IS NOT NULL""")
def replace_token(ev):
    new = c.replace_token("player_active", F.lit("Garchomp"), F.lit("Gabite"))
    return ev.where(F.size("player_active") > 0).select(ID, F.array_join(new, ", ").alias("names"))


@query("clean_ocr_text", """SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}\\p{M}_\\s''!.,%/-]', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS text FROM documents""")
def clean_ocr_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", c.clean_ocr_text("text").alias("text"))


@on_matches("parse_plate", """SELECT event_id, 'Incineroar' AS name, CASE WHEN k % 2 = 0 THEN k END AS hp_cur, CASE WHEN k % 2 = 0 THEN 175 END AS hp_max,
  CASE WHEN k % 2 = 0 THEN cast(round_even(k * 100 / 175, 0) AS INT) ELSE k END AS hp_pct FROM {ev} WHERE event = 'hp_change'""", raw=True)
def parse_plate(ev):
    text = F.concat(F.lit("* Incineroar Lv "), F.when(F.col("k") % 2 == 0, F.concat("k", F.lit(" / 175"))).otherwise(F.concat("k", F.lit(" % "))))
    return ev.where("event = 'hp_change'").withColumn("p", c.parse_plate(text)).select(ID, "p.name", "p.hp_cur", "p.hp_max", "p.hp_pct")


@query("text_mentions_any", """SELECT d.doc_id, coalesce(bool_or(length(w) >= 4 AND (starts_with(w, 'thereal') OR starts_with('thereal', w) OR starts_with(w, 'lorem') OR starts_with('lorem', w))), false) AS mentions
FROM (SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g'))) w FROM documents) d GROUP BY doc_id""")
def text_mentions_any(spark, sf_dir):
    wanted = F.array(F.lit("Thereal"), F.lit("Lorem"), F.lit("the"))
    return read(spark, sf_dir, "documents").select("doc_id", c.text_mentions_any("text", wanted).alias("mentions"))


@on_matches("caption", f"""SELECT event_id, CASE event
  WHEN 'team_preview' THEN 'Team preview - you lead with ' || CASE WHEN player_lead <> '' THEN player_lead ELSE '?' END || '; opponent leads with ' || opponent_lead || '.'
  WHEN 'pokemon_sent_out' THEN w || ' sent out.' WHEN 'move_used' THEN w || ' used ' || detail || '.' WHEN 'pokemon_fainted' THEN w || ' fainted!'
  WHEN 'status_inflicted' THEN w || ' was affected by ' || detail || '.' WHEN 'terastallized' THEN w || ' Terastallized!'
  WHEN 'hp_change' THEN w || '''s HP is now ' || CASE WHEN hp_percent IS NULL THEN 'unknown.' WHEN hp_percent = floor(hp_percent) THEN cast(hp_percent::BIGINT AS VARCHAR) || '%.' ELSE cast(hp_percent AS VARCHAR) || '%.' END
  WHEN 'item_or_ability_activated' THEN w || ': ' || detail
  WHEN 'battle_end' THEN CASE winner WHEN 'player' THEN 'You won the match!' WHEN 'opponent' THEN 'You lost the match.' ELSE 'Match ended (result unclear).' END
  WHEN 'field_state' THEN 'Weather: ' || weather || ' - Terrain: ' || terrain || CASE WHEN trick_room THEN ' - Trick Room active' ELSE '' END || ' - Tailwind active - Screens: ' || screens
  ELSE w || ' ' || replace(event, '_', ' ') END AS caption
FROM (SELECT *, CASE WHEN actor = 'opponent' THEN 'Opposing ' ELSE '' END || coalesce(pokemon, '') w FROM {{ev}})""")
def caption(ev):
    return ev.select(ID, c.caption().alias("caption"))


@on_matches("cost_estimates", """SELECT user_id_text AS user_id, job_id, round(max(event_idx) * 5 * 0.33 * 258 / 1000000 * 0.3, 9)::DOUBLE AS cost, (count(DISTINCT match) * 0.15)::DECIMAL(10,2) AS job_cost FROM {ev} GROUP BY 1, 2""")
def cost_estimates(ev):
    rows = ev.groupBy("user_id", "job_id").agg(F.max(F.col("event_idx") * 5).alias("s"), F.count_distinct("match").alias("n"))
    return rows.select("user_id", "job_id", F.round(c.cost_estimate(F.col("s"), 0.33)["cost"], 9).alias("cost"), c.job_cost("n").alias("job_cost"))


_SOURCES = "CASE event_id % 5 WHEN 0 THEN 'url' WHEN 1 THEN 'upload' WHEN 2 THEN 'showdown' WHEN 3 THEN 'liveFeed' END"


@query("default_job_name", f"""SELECT event_id, CASE {_SOURCES} WHEN 'url' THEN 'Video URL' WHEN 'upload' THEN 'Video upload' WHEN 'showdown' THEN 'Showdown replay' WHEN 'liveFeed' THEN 'Livefeed' ELSE 'Gameplay' END
  || ' - ' || strftime(ts, '%b %d, %Y') AS name FROM events""")
def default_job_name(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", c.default_job_name(F.expr(_SOURCES), F.to_date("ts")).alias("name"))


@on_matches("detect_roster_conflict", """SELECT event_id, CASE WHEN event = 'hp_change' AND k % 13 = 6 THEN 'Gengar, Mew' ELSE '' END AS names FROM {ev}""", raw=True)
def detect_roster_conflict(ev):
    return ev.select(ID, F.array_join(c.detect_roster_conflict("detail"), ", ").alias("names"))


_ARG = "'p' || cast(event_id % 2 + 1 as varchar(5)) || 'a: Nick ' || cast(k as varchar(9))"


@on_matches("replay_tokens", """SELECT event_id, 'p' || cast(event_id % 2 + 1 AS VARCHAR) || 'a' AS slot, 'p' || cast(event_id % 2 + 1 AS VARCHAR) AS side, 'Nick ' || k AS nickname,
  pokemon AS species, detail AS move FROM {ev} WHERE event = 'move_used'""", raw=True)
def replay_tokens(ev):
    rows = ev.where("event = 'move_used'")
    token, details = F.expr(_ARG), F.concat("pokemon", F.lit(", L50, M"))
    return rows.select(ID, c.slot_id(token).alias("slot"), c.slot_side(token).alias("side"), c.slot_nickname(token).alias("nickname"),
                       c.species_from_details(details).alias("species"),
                       c.strip_move_prefix(F.concat(F.lit("Move: "), "detail")).alias("move"))


_WX = "split_part('RainDance,SunnyDay,Sandstorm,Snow,Hail,none,Fog', ',', cast(k % 7 + 1 as int))"


@on_matches("vocabulary", f"""SELECT event_id, CASE {_WX} WHEN 'RainDance' THEN 'rain' WHEN 'SunnyDay' THEN 'sun' WHEN 'Sandstorm' THEN 'sand' WHEN 'Snow' THEN 'snow' WHEN 'Hail' THEN 'snow' WHEN 'none' THEN 'none' ELSE 'Fog' END AS weather_name FROM {{ev}}""", raw=True)
def vocabulary(ev):
    return ev.select(ID, c.vocabulary(F.expr(_WX), fixed.WEATHER_NAMES, F.expr(_WX)).alias("weather_name"))


@on_matches("event_key", """SELECT event_id, 'match' || match || '::chunk' || pos AS key, match AS m, pos AS chunk FROM {ev}""", raw=True)
def event_key(ev):
    rows = ev.withColumn("key", c.event_key("match", "pos")).withColumn("p", c.parse_event_key("key"))
    return rows.select(ID, "key", F.col("p.match").alias("m"), F.col("p.chunk").alias("chunk"))


_LINES = """case k % 12 when 0 then 'The opposing ' || pokemon || ' fainted!' when 1 then pokemon || ' fainted!' when 2 then 'It''s super effective!'
 when 3 then 'A critical hit!' when 4 then pokemon || '''s Sp. Atk sharply rose!' when 5 then pokemon || ' was burned!'
 when 6 then pokemon || ' used ' || replace(detail, ' (failed)', '') || ', but it failed!' when 7 then pokemon || ' used ' || replace(detail, ' (failed)', '') || '!' when 8 then 'Go! ' || pokemon || '!'
 when 9 then 'Rain began to fall, rain.' when 10 then 'You won the battle!' else 'zzz' end"""


@on_matches("parse_battle_line", f"""SELECT event_id,
  CASE k % 12 WHEN 0 THEN 'pokemon_fainted' WHEN 1 THEN 'pokemon_fainted' WHEN 2 THEN 'super_effective_hit' WHEN 3 THEN 'critical_hit' WHEN 4 THEN 'stat_change' WHEN 5 THEN 'status_inflicted'
    WHEN 6 THEN 'move_used' WHEN 7 THEN 'move_used' WHEN 8 THEN 'pokemon_sent_out' WHEN 9 THEN 'weather_or_terrain_set' WHEN 10 THEN 'battle_end' END AS event,
  CASE WHEN k % 12 IN (0, 1, 4, 5, 6, 7, 8) THEN pokemon END AS pokemon, CASE k % 12 WHEN 0 THEN 'opponent' WHEN 1 THEN 'player' WHEN 8 THEN 'player' END AS actor,
  CASE k % 12 WHEN 0 THEN pokemon || ' fainted' WHEN 1 THEN pokemon || ' fainted' WHEN 2 THEN 'It''s super effective!' WHEN 3 THEN 'A critical hit!' WHEN 4 THEN 'Sp. Atk sharply rose' WHEN 5 THEN pokemon || ' was burned'
    WHEN 6 THEN replace(detail, ' (failed)', '') || ' (failed)' WHEN 7 THEN replace(detail, ' (failed)', '') WHEN 8 THEN pokemon || ' sent out' WHEN 9 THEN 'Rain began to fall, rain.' WHEN 10 THEN 'You won the battle!' END AS detail,
  CASE k % 12 WHEN 6 THEN 0.9 WHEN 10 THEN 0.98 WHEN 11 THEN NULL ELSE 0.95 END::DOUBLE AS confidence
FROM {{ev}} WHERE event = 'move_used'""", raw=True)
def battle_line(ev):
    rows = ev.where("event = 'move_used'")
    rows = rows.withColumn("e", parse_battle_line(F.expr(_LINES)))
    return rows.select(ID, *[F.col(f"e.{x}").alias(x) for x in ("event", "pokemon", "actor", "detail", "confidence")])


@query("parse_battle_line_on_conversations")
def battle_line_conversations(spark, sf_dir):
    """Every line of every conversation text and one battle line per turn; free text mostly fits no rule."""
    told = F.concat("text", F.lit("\n"), F.initcap("role"), F.lit(" used Protect!"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(told, "\n")).alias("line", "t"))
    rows = rows.withColumn("e", parse_battle_line(F.col("t"))).where("e is not null")
    return rows.select("conv_id", "turn", "line", "e.event", "e.detail", "e.confidence")
