"""Queries over team and damage arithmetic."""

from pyspark.sql import functions as F

from ringside.catalog.registry import on_matches, query
from ringside.catalog.snippets import DECIDED, PM
from ringside.catalog.strategy import DEX
from ringside.contracts import KEY
from ringside.functions import fixed_values as fixed
from ringside.operators import record as r
from ringside.operators import teams as t

RISK = """
wk AS (SELECT g.n, g.atk, g.mult FROM guard g WHERE g.mult > 1)"""


def risk_sql(lists, key="rid"):
    """Risk of each named list in `lists`(rid, ns)."""
    return f"""rm AS (SELECT {key}, unnest(ns) n FROM {lists}), rk AS (SELECT rm.{key}, wk.atk, count(*) c, count(*) FILTER (WHERE wk.mult >= 4) q FROM rm JOIN wk ON wk.n = rm.n GROUP BY ALL),
risk AS (SELECT {key}, cast(sum(CASE WHEN c >= 2 THEN c - 1 ELSE 0 END) + 1.5 * sum(q) AS DOUBLE) risk, string_agg(atk || ' ' || c, ', ' ORDER BY atk) FILTER (WHERE c >= 2) shared, cast(sum(q) AS BIGINT) quads FROM rk GROUP BY ALL)"""


@on_matches("weaknesses", "WITH " + DEX + """, x AS (SELECT event_id, pokemon FROM ev WHERE pokemon IS NOT NULL)
SELECT x.event_id, string_agg(atk || ' ' || cast(mult AS DECIMAL(3,1)), ', ' ORDER BY atk) AS weak_to FROM x JOIN guard g ON g.n = x.pokemon AND g.mult > 1 GROUP BY 1""")
def weaknesses(ev):
    dex = t.resolve(F.array("pokemon"))
    names = F.transform(F.get(dex, F.lit(0))["types"], lambda i: F.get(F.lit(fixed.TYPES), i))
    # Exploded, for a filter over the list would compute it twice.
    some = F.filter(F.array(t.weaknesses(names)), lambda w: F.size(w) > 0)
    rows = ev.where("pokemon is not null").select("event_id", F.explode(some).alias("w"))
    told = F.array_sort(F.transform("w", lambda x: F.concat(x["type"], F.lit(" "), x["mult"].cast("decimal(3,1)").cast("string"))))
    return rows.select("event_id", F.array_join(told, ", ").alias("weak_to"))


@on_matches("team_risk", "WITH " + DEX + "," + RISK + f""", {PM}, ls AS (SELECT u || '/' || j || '/' || m rid, u, j, m, o_brought ns FROM pm), {risk_sql('ls')}
SELECT ls.u AS user_id, ls.j AS job_id, ls.m AS match, len(list_filter(ns, lambda n: n <> 'Smeargle')) AS resolved, array_to_string(list_filter(ns, lambda n: n = 'Smeargle'), ', ') AS unresolved,
  coalesce(risk, 0) AS risk_score, coalesce(shared, '') AS shared_weaknesses, coalesce(quads, 0) AS quads FROM ls LEFT JOIN risk USING (rid)""")
def team_risk(ev):
    rows = t.team_risk(r.per_match(ev), "opponent_brought")
    shared = F.array_sort(F.transform("shared_weaknesses", lambda x: F.concat(x["type"], F.lit(" "), x["n"])))
    return rows.select(*KEY, F.size("resolved").cast("bigint").alias("resolved"), F.array_join("unresolved", ", ").alias("unresolved"), "risk_score",
                       F.array_join(shared, ", ").alias("shared_weaknesses"), F.size("quad_weaknesses").cast("bigint").alias("quads"))


_ANS = """an AS (SELECT rid, d, string_agg(a, ', ' ORDER BY i) FILTER (WHERE hit) ans, count(*) FILTER (WHERE hit) c FROM (
  SELECT x.rid, x.d, y.a, y.i, coalesce(best.b, 0) >= 2 hit FROM (SELECT DISTINCT rid, unnest(ds) d FROM prs) x JOIN (SELECT rid, unnest(ak) a, generate_subscripts(ak, 1) i FROM prs) y USING (rid)
  LEFT JOIN best ON best.a = y.a AND best.d = x.d WHERE x.d IN (SELECT n FROM species)) GROUP BY ALL)"""


@on_matches("type_answers", "WITH " + DEX + f", {PM}, prs AS (SELECT u || '/' || j || '/' || m rid, p_brought ak, o_brought ds FROM pm WHERE len(p_brought) > 0), {_ANS}" + """
SELECT rid, d AS defender, coalesce(ans, '') AS answers FROM an""")
def type_answers(ev):
    rows = r.per_match(ev).where(F.size("player_brought") > 0)
    answers = t.type_answers(t.resolve(F.array_distinct("player_brought")), t.resolve(F.array_distinct("opponent_brought")))
    rows = rows.select(F.concat_ws("/", *KEY).alias("rid"), F.inline(answers))
    return rows.withColumn("answers", F.array_join("answers", ", "))


@on_matches("team_matchup", "WITH " + DEX + f""", {PM}, b AS (SELECT u || '/' || j || '/' || m rid, p_brought p, o_brought o FROM pm),
cov AS (SELECT side, rid, count(*) n, count(*) FILTER (WHERE hit) c FROM (SELECT side, rid, q.d, bool_or(coalesce(best.b, 0) >= 2) hit FROM (
  SELECT DISTINCT 'you' side, rid, d, a FROM (SELECT rid, unnest(o) d FROM b) JOIN (SELECT rid, unnest(p) a FROM b) USING (rid)
  UNION ALL SELECT DISTINCT 'them', rid, d, a FROM (SELECT rid, unnest(p) d FROM b) JOIN (SELECT rid, unnest(o) a FROM b) USING (rid)) q LEFT JOIN best ON best.a = q.a AND best.d = q.d
  WHERE q.d IN (SELECT n FROM species) GROUP BY ALL) GROUP BY ALL)
SELECT b.rid, y.c || '/' || y.n AS your_coverage, t.c || '/' || t.n AS their_coverage, CASE WHEN y.c / y.n - t.c / t.n >= 0.25 THEN 'favorable' WHEN y.c / y.n - t.c / t.n <= -0.25 THEN 'unfavorable' ELSE 'even' END AS verdict
FROM b JOIN cov y ON y.rid = b.rid AND y.side = 'you' JOIN cov t ON t.rid = b.rid AND t.side = 'them'""")
def team_matchup(ev):
    rows = t.team_matchup(r.per_match(ev).where(F.size("player_brought") > 0), "player_brought", "opponent_brought")
    return rows.select(F.concat_ws("/", *KEY).alias("rid"), "your_coverage", "their_coverage", "verdict")


SELECTIONS = "WITH " + DEX + "," + RISK + f""", {PM}, tm AS (SELECT u || '/' || j || '/' || m rid, p_team, p_brought, list_filter(list_distinct(o_brought), lambda n: n <> 'Smeargle') opp FROM pm),
ix AS (SELECT a, b, c, d, row_number() OVER (ORDER BY a, b, c, d) - 1 no FROM range(1, 7) w(a), range(1, 7) x(b), range(1, 7) y(c), range(1, 7) z(d) WHERE a < b AND b < c AND c < d),
cd AS (SELECT tm.rid team, no, [p_team[a], p_team[b], p_team[c], p_team[d]] ns, opp FROM tm CROSS JOIN ix UNION ALL SELECT rid, -1, p_brought, opp FROM tm WHERE len(p_brought) = 4),
ls AS (SELECT team || '#' || no rid, team, no, ns, opp FROM cd), {risk_sql('ls')},
ofn AS (SELECT rid, count(*) FILTER (WHERE hit) / count(*) o FROM (SELECT ls.rid, u.d, bool_or(coalesce(best.b, 0) >= 2) hit FROM ls, unnest(opp) u(d), unnest(ns) v(a) LEFT JOIN best ON best.a = v.a AND best.d = u.d GROUP BY ALL) GROUP BY 1),
sc AS (SELECT ls.*, round_even(100 * (0.65::DOUBLE * o + 0.35::DOUBLE * (1 / (1 + coalesce(risk, 0)))), 1)::DOUBLE sc FROM ls JOIN ofn USING (rid) LEFT JOIN risk USING (rid))"""


@on_matches("all_selections", SELECTIONS + " SELECT team AS rid, cast(no AS INT) AS no, array_to_string(ns, ', ') AS candidate, sc AS score FROM sc WHERE no >= 0")
def all_selections(ev):
    rows = t.all_selections(r.per_match(ev), "player_team", "opponent_brought")
    rows = rows.select(F.concat_ws("/", *KEY).alias("rid"), F.inline("selections"))
    return rows.withColumn("candidate", F.array_join("candidate", ", "))


@on_matches("preview_skill", SELECTIONS + """, rnk AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY sc DESC, no) rn FROM sc WHERE no >= 0),
be AS (SELECT * FROM rnk WHERE rn = 1), ac AS (SELECT * FROM sc WHERE no = -1)
SELECT ac.team AS rid, ac.sc AS selected_score, be.sc AS best_score, cast(round_even(be.sc - ac.sc, 1) AS DOUBLE) AS regret, cast(round_even(ac.sc / be.sc * 100, 1) AS DOUBLE) AS skill_pct, rnk.rn AS rank_of_selected,
  CASE WHEN round_even(be.sc - ac.sc, 1) <= 5 THEN 'Excellent preview' WHEN round_even(be.sc - ac.sc, 1) <= 12 THEN 'Good preview' WHEN round_even(be.sc - ac.sc, 1) <= 20 THEN 'Questionable preview' ELSE 'Major preview mistake' END AS regret_category,
  CASE WHEN len(list_filter(be.ns, lambda x: NOT list_contains(ac.ns, x))) = 1 THEN list_filter(be.ns, lambda x: NOT list_contains(ac.ns, x))[1] END AS swap_in
FROM ac JOIN be USING (team) JOIN rnk ON rnk.team = ac.team AND list_sort(rnk.ns) = list_sort(ac.ns)""")
def preview_skill(ev):
    rows = t.preview_skill(r.per_match(ev), "player_team", "player_brought", "opponent_brought")
    return rows.select(F.concat_ws("/", *KEY).alias("rid"), "selected_score", "best_score", "regret", "skill_pct",
                       F.col("rank_of_selected").cast("bigint").alias("rank_of_selected"), "regret_category", "swap_in")


_STR = "WITH " + DEX + "," + RISK + f""", {PM}, d AS (SELECT * FROM ({DECIDED}) WHERE len(o_brought) > 0), ls AS (SELECT u || '/' || j || '/' || m rid, u, won, o_brought ns FROM d), {risk_sql('ls')},
st AS (SELECT ls.rid, u, won, coalesce(risk, 0)::DOUBLE rs, len(list_filter(ns, lambda n: n <> 'Smeargle')) rn FROM ls LEFT JOIN risk USING (rid))"""


@on_matches("opponent_strength", _STR + " SELECT rid, won, rs AS risk_score, rn AS resolved FROM st")
def opponent_strength(ev):
    rows = t.opponent_strength(r.per_match(ev))
    return rows.select(F.concat_ws("/", *KEY).alias("rid"), "won", "risk_score", F.size("resolved").cast("bigint").alias("resolved"))


@on_matches("median_split", _STR + """, q AS (SELECT * FROM st WHERE rn >= 2), md AS (SELECT u, median(rs) md, count(*) n FROM q GROUP BY 1 HAVING count(*) >= 4)
SELECT u AS user_id, md AS median_risk_score, n AS sample_size, count(*) FILTER (WHERE rs > md) AS weaker_n, count(*) FILTER (WHERE rs <= md) AS tighter_n,
  cast(round_even(100.0 * count(*) FILTER (WHERE won AND rs > md) / nullif(count(*) FILTER (WHERE rs > md), 0), 1) AS DOUBLE) AS win_rate_vs_weaker_built,
  cast(round_even(100.0 * count(*) FILTER (WHERE won AND rs <= md) / nullif(count(*) FILTER (WHERE rs <= md), 0), 1) AS DOUBLE) AS win_rate_vs_tighter_built FROM q JOIN md USING (u) GROUP BY u, md, n""")
def median_split(ev):
    return t.median_split(t.opponent_strength(r.per_match(ev)), ["user_id"])


_NAT = "split_part('Hardy,Adamant,Jolly,Modest,Brave,Timid', ',', cast(p_partkey % 6 + 1 as int))"
_BASE = {"hp": "p_size + 40", "attack": "p_partkey % 120 + 30", "defense": "p_partkey % 90 + 40", "special_attack": "p_partkey % 70 + 60", "special_defense": "p_size * 2 + 20", "speed": "p_partkey % 140 + 10"}
_UP = {"attack": ("Adamant,Brave", "Modest,Timid"), "defense": ("", ""), "special_attack": ("Modest", "Adamant,Jolly"), "special_defense": ("", ""), "speed": ("Jolly,Timid", "Brave")}


def _stat_sql(stat):
    grown = f"floor((2 * ({_BASE[stat]}) + 31 + floor((p_size % 33 * 8) / 4)) * 50 / 100)"
    if stat == "hp":
        return f"cast({grown} + 60 AS INT) AS stat_hp"
    up, down = _UP[stat]
    mult = f"CASE WHEN list_contains(string_split('{up}', ','), nat) THEN 1.1 WHEN list_contains(string_split('{down}', ','), nat) THEN 0.9 ELSE 1.0 END"
    return f"cast(floor(({grown} + 5) * ({mult})) AS INT) AS stat_{stat}"


@query("calc_stats", f"SELECT p_partkey, {', '.join(_stat_sql(x) for x in _BASE)} FROM (SELECT *, {_NAT} nat FROM part)")
def calc_stats(spark, sf_dir):
    """Parts as species: size and key give base stats, spread and nature."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey", f"{_NAT} as nature", "50 as level", *[f"{e} as base_{x}" for x, e in _BASE.items()],
        *[f"p_size % 33 * 8 as ev_{x}" for x in _BASE])
    return t.calc_stats(rows).select("p_partkey", *[f"stat_{x}" for x in _BASE])


_TY = lambda e: f"split_part('{','.join(fixed.TYPES)}', ',', cast(({e}) % 18 + 1 as int))"
_DMG = {
    "pw": "cast(floor(l_quantity * 3) as int) - 5", "ak": "cast(floor(l_extendedprice / 500) as int) % 180 + 20", "df": "l_partkey % 150 + 30",
    "hp": "l_suppkey % 200 + 90", "phys": "l_linenumber % 2 = 0", "ty": _TY("l_orderkey"), "own": _TY("l_orderkey + l_linenumber % 3"),
    "d1": _TY("l_partkey"), "d2": _TY("l_suppkey"), "wx": "split_part('sun,rain,sand,snow,none', ',', cast(l_orderkey % 5 + 1 as int))",
    "it": "split_part('Life Orb,Choice Band,Choice Specs,Expert Belt,none', ',', cast(l_linenumber % 5 + 1 as int))",
    "ab": "split_part('Guts,Adaptability,none', ',', cast(l_partkey % 3 + 1 as int))", "brn": "l_partkey % 4 = 0",
    "crit": "l_suppkey % 5 = 0", "spread": "l_orderkey % 3 = 0", "stg": "cast(l_linenumber % 9 as int) - 4",
}


@query("damage_matrix", "WITH " + DEX + ", s AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{e} AS {k}" for k, e in _DMG.items()) + """ FROM lineitem),
a AS (SELECT *, greatest(1, floor(ak * CASE WHEN stg >= 0 THEN (2 + stg) / 2 ELSE 2 / (2 - stg) END)) a1, floor(df * 1.0) b0 FROM s),
b AS (SELECT *, greatest(1, CASE WHEN (wx = 'sand' AND NOT phys AND (d1 = 'rock' OR d2 = 'rock')) OR (wx = 'snow' AND phys AND (d1 = 'ice' OR d2 = 'ice')) THEN floor(b0 * 1.5) ELSE b0 END) b1 FROM a),
c AS (SELECT b.*, floor(floor(22 * pw * a1 / b1) / 50) + 2 base, coalesce(c1.m, 1)::DOUBLE * coalesce(c2.m, 1)::DOUBLE tm,
  CASE WHEN own = ty THEN CASE WHEN ab = 'Adaptability' THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END ELSE 1.0::DOUBLE END stab
  FROM b LEFT JOIN chart c1 ON c1.a = b.ty AND c1.d = b.d1 LEFT JOIN chart c2 ON c2.a = b.ty AND c2.d = b.d2),
d AS (SELECT *, CASE WHEN spread THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN (wx = 'sun' AND ty = 'fire') OR (wx = 'rain' AND ty = 'water') THEN 1.5::DOUBLE WHEN (wx = 'sun' AND ty = 'water') OR (wx = 'rain' AND ty = 'fire') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN crit THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * stab * tm * CASE WHEN brn AND phys AND ab <> 'Guts' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN it = 'Life Orb' THEN 1.3::DOUBLE WHEN (it = 'Choice Band' AND phys) OR (it = 'Choice Specs' AND NOT phys) THEN 1.5::DOUBLE WHEN it = 'Expert Belt' AND tm > 1 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END md FROM c),
e AS (SELECT *, CASE WHEN pw <= 0 OR tm = 0 THEN [0::BIGINT] ELSE list_transform(range(85, 101), lambda p: greatest(1, floor(base * md * (p::DOUBLE / 100))::BIGINT)) END rolls FROM d)
SELECT l_orderkey, l_linenumber, list_min(rolls) AS min_damage, list_max(rolls) AS max_damage, cast(round_even(list_avg(rolls), 2) AS DOUBLE) AS avg_damage,
  CASE WHEN pw > 0 THEN cast(round_even(list_max(rolls)::DOUBLE / hp * 100, 1) AS DOUBLE) ELSE 0.0::DOUBLE END AS max_pct FROM e""")
def damage_matrix(spark, sf_dir):
    """Line items as attack scenarios."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", *[f"{e} as {k}" for k, e in _DMG.items()])
    rows = rows.selectExpr(
        "l_orderkey", "l_linenumber",
        "struct(50 as level, ak as atk, ak as spa, stg as atk_stage, stg as spa_stage, array(own) as types, ab as ability, it as item, "
        "case when brn then 'brn' end as status, false as is_tera, '' as tera_type) as attacker",
        "struct(hp, df as def, df as spd, 0 as def_stage, 0 as spd_stage, array(d1, d2) as types, false as is_tera, '' as tera_type) as defender",
        "struct(pw as power, case when phys then 'physical' else 'special' end as category, ty as type, spread as is_spread, crit as is_crit) as move",
        "struct(wx as weather, 2 as targets_count) as field")
    out = t.damage_matrix(rows)
    return out.select("l_orderkey", "l_linenumber", F.col("damage.min").alias("min_damage"), F.col("damage.max").alias("max_damage"),
                      F.col("damage.avg").alias("avg_damage"), F.col("damage.max_pct").alias("max_pct"))


@query("parse_spread", f"SELECT p_partkey, {_NAT} AS nature, p_size AS hp, cast(p_partkey % 32 AS INT) AS spe FROM part")
def parse_spread(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey", f"{_NAT} || ':' || cast(p_size as string) || '/0/4/0/0/' || cast(p_partkey % 32 as string) as label")
    rows = rows.withColumn("s", t.parse_spread(F.col("label")))
    return rows.select("p_partkey", "s.nature", "s.hp", "s.spe")
