"""Queries over strategic scores."""

from pyspark.sql import functions as F

from ringside.catalog.registry import on_matches
from ringside.catalog.turns import BOARD, K, key_sql
from ringside.contracts import KEY
from ringside.functions import fixed_values as fixed
from ringside.operators import strategy as s

_IN = lambda words: ", ".join(f"'{w}'" for w in words)
BANDS = ("CASE WHEN {0} >= 80 THEN 'Dominating' WHEN {0} >= 50 THEN 'Strong Advantage' WHEN {0} >= 20 THEN 'Slight Advantage' "
         "WHEN {0} >= -19 THEN 'Even' WHEN {0} >= -49 THEN 'Slight Disadvantage' WHEN {0} >= -79 THEN 'Major Disadvantage' ELSE 'Losing' END")
POSTURE = ("CASE WHEN {0} IN ('Dominating', 'Strong Advantage') THEN 'safe' WHEN {0} = 'Slight Advantage' THEN 'cautiously_safe' "
           "WHEN {0} = 'Even' THEN 'balanced' WHEN {0} = 'Slight Disadvantage' THEN 'cautiously_aggressive' ELSE 'aggressive' END")

TL = BOARD + f""",
hp AS (SELECT job_id, match, actor side, {key_sql('pokemon')} sk, tn, event_idx, hp_percent FROM tg
  WHERE event = 'hp_change' AND hp_percent IS NOT NULL AND tn IS NOT NULL AND actor IN ('player', 'opponent')),
kh AS (SELECT av.job_id, av.match, av.tn, av.side, av.slot, arg_max(h.hp_percent, (h.tn, h.event_idx)) hp
  FROM av LEFT JOIN hp h ON h.job_id = av.job_id AND h.match = av.match AND h.side = av.side AND h.sk = av.sk AND h.tn < av.tn GROUP BY ALL),
alive AS (SELECT job_id, match, tn, count(*) FILTER (WHERE side = 'player') pa, count(*) FILTER (WHERE side = 'opponent') oa,
  avg(hp) FILTER (WHERE side = 'player') ph, avg(hp) FILTER (WHERE side = 'opponent') oh FROM kh GROUP BY ALL),
tool AS (SELECT job_id, match, actor side, pokemon, detail, min(tn) ft FROM tg WHERE event = 'item_or_ability_activated'
  AND lower(detail) IN ('item: choice scarf', 'item: booster energy', 'ability: swift swim') AND tn IS NOT NULL AND actor IN ('player', 'opponent') GROUP BY ALL),
tools AS (SELECT g.job_id, g.match, g.tn, count(*) FILTER (WHERE t.side = 'player') pt, count(*) FILTER (WHERE t.side = 'opponent') ot
  FROM grid g JOIN tool t ON t.job_id = g.job_id AND t.match = g.match AND t.ft < g.tn GROUP BY ALL),
cats AS (SELECT job_id, match, tn, side, list_sort(list(DISTINCT c)) cs FROM (SELECT *, CASE WHEN lower(mv) IN ({_IN(fixed.SPREAD_MOVES)}) THEN 'spread'
  WHEN lower(mv) = 'fake out' THEN 'fake_out' WHEN lower(mv) IN ({_IN(fixed.REDIRECTION_MOVES)}) THEN 'redirection' END c FROM km) WHERE c IS NOT NULL GROUP BY ALL),
room AS (SELECT job_id, match, bool_or(actor = 'player') p, bool_or(actor = 'opponent') o FROM ev WHERE event = 'move_used' AND detail LIKE 'Trick Room%' GROUP BY ALL),
fn AS (SELECT job_id, match, tn, count(*) FILTER (WHERE side = 'player') pf, count(*) FILTER (WHERE side = 'opponent') of FROM act WHERE ty = 'fainted' GROUP BY ALL),
bo AS (SELECT u, job_id, match, tn, actor side, pokemon, event_idx, regexp_extract(detail, '^(.*?) (sharply )?rose$', 1) stat FROM tg WHERE event = 'stat_change' AND tn IS NOT NULL
  AND actor IN ('player', 'opponent') AND regexp_matches(detail, '^(Attack|Sp\\. Atk|Speed) (sharply rose|rose)$')),
bc AS (SELECT job_id, match, tn, count(*) n FROM bo GROUP BY ALL),
nx AS (SELECT *, lead(tn) OVER (PARTITION BY job_id, match ORDER BY tn) nt FROM grid),
lost AS (SELECT DISTINCT nx.u, nx.job_id, nx.match, nx.nt tn, s.side, s.pokemon FROM slots s JOIN nx ON nx.job_id = s.job_id AND nx.match = s.match AND nx.tn = s.ft WHERE nt IS NOT NULL),
ls AS (SELECT job_id, match, tn, list(pokemon ORDER BY pokemon) FILTER (WHERE side = 'player') pl, list(pokemon ORDER BY pokemon) FILTER (WHERE side = 'opponent') ol FROM lost GROUP BY ALL),
w0 AS (SELECT g.*, coalesce(pa, 0) pa, coalesce(oa, 0) oa, ph, oh, c.c.tailwind tw, coalesce(c.c.trick_room, false) tr, c.c.weather wt, c.c.terrain te, c.c.screens sc,
    coalesce(pt, 0) pt, coalesce(ot, 0) ot, coalesce(len(cp.cs), 0) pc, coalesce(len(co.cs), 0) oc, coalesce(cp.cs, []) pcs, coalesce(co.cs, []) ocs,
    coalesce(room.p, false) rp, coalesce(room.o, false) ro, coalesce(pf, 0) pf, coalesce(of, 0) of, coalesce(bc.n, 0) boosts, coalesce(pl, []) pl, coalesce(ol, []) ol
  FROM grid g LEFT JOIN alive USING (job_id, match, tn) LEFT JOIN cond c USING (job_id, match, tn) LEFT JOIN tools USING (job_id, match, tn)
  LEFT JOIN cats cp ON cp.job_id = g.job_id AND cp.match = g.match AND cp.tn = g.tn AND cp.side = 'player'
  LEFT JOIN cats co ON co.job_id = g.job_id AND co.match = g.match AND co.tn = g.tn AND co.side = 'opponent'
  LEFT JOIN room ON room.job_id = g.job_id AND room.match = g.match LEFT JOIN fn ON fn.job_id = g.job_id AND fn.match = g.match AND fn.tn = g.tn
  LEFT JOIN bc ON bc.job_id = g.job_id AND bc.match = g.match AND bc.tn = g.tn LEFT JOIN ls ON ls.job_id = g.job_id AND ls.match = g.match AND ls.tn = g.tn),
w1 AS (SELECT *, contains(sc, 'player ') psc, contains(sc, 'opponent ') osc,
  greatest(-100, least(100, round_even((pa - oa) * 25 + CASE tw WHEN 'player' THEN 10 WHEN 'opponent' THEN -10 ELSE 0 END + coalesce((ph - oh) * 0.15::DOUBLE, 0), 0)))::INT score,
  greatest(-30, least(30, (pt - ot) * 5))::INT sp, greatest(-30, least(30, (pc - oc) * 5))::INT th,
  greatest(-100, least(100, round_even((pa - oa) * 25 + coalesce((round_even(ph, 1)::DOUBLE - round_even(oh, 1)::DOUBLE) * 0.15::DOUBLE, 0), 0)))::INT bs FROM w0),
w2 AS (SELECT *, ((CASE WHEN psc THEN 8 ELSE 0 END) - (CASE WHEN osc THEN 8 ELSE 0 END))::INT ss FROM w1),
w3 AS (SELECT *, greatest(-100, least(100, score + sp + th + ss))::INT pos,
  lag(score) OVER w pscore, lag(tw) OVER w ptw, lag(tr) OVER w ptr, lag(wt) OVER w pwt, lag(te) OVER w pte, lag(psc) OVER w ppsc, lag(osc) OVER w posc
  FROM w2 WINDOW w AS (PARTITION BY job_id, match ORDER BY tn)),
tl AS (SELECT *, coalesce(score - pscore, 0)::INT delta, {BANDS.format('pos')} band,
  psc AND NOT coalesce(ppsc, false) pgain, osc AND NOT coalesce(posc, false) ogain FROM w3)
"""


@on_matches("momentum_timeline", "WITH RECURSIVE " + TL + f"""
SELECT {K}, tn AS turn, pa AS player_alive, oa AS opponent_alive, score, delta, cast(round_even(50 + 50 * ((exp(score / 30.0) - 1) / (exp(score / 30.0) + 1)), 1) AS DOUBLE) AS win_probability,
  sp AS speed_score, th AS threat_score, bs AS board_score, ss AS screen_score, greatest(-100, least(100, bs + ss))::INT AS resource_score,
  cast(round_even(ph, 1) AS DOUBLE) AS player_avg_hp, cast(round_even(oh, 1) AS DOUBLE) AS opponent_avg_hp,
  CASE WHEN sp > 0 THEN 'player' WHEN sp < 0 THEN 'opponent' WHEN tw = 'both' OR tr THEN 'contested' ELSE 'none' END AS speed_side,
  CASE WHEN th > 0 THEN 'player' WHEN th < 0 THEN 'opponent' ELSE 'even' END AS threat_side,
  pos AS position, band, {POSTURE.format('band')} AS posture, CASE WHEN delta > 10 THEN 'gained' WHEN delta < -10 THEN 'lost' ELSE 'neutral' END AS direction,
  pf AS player_faints, of AS opponent_faints, boosts, pgain AS player_screen_gained, ogain AS opponent_screen_gained FROM tl""")
def momentum_timeline(ev):
    return s.strategy_of(ev).timeline.select(
        *KEY, "turn", "player_alive", "opponent_alive", "score", "delta", "win_probability", "speed_score",
        "threat_score", "board_score", "screen_score", "resource_score", "player_avg_hp", "opponent_avg_hp",
        "speed_side", "threat_side", "position", "band", "posture", "direction", "player_faints", "opponent_faints",
        "boosts", "player_screen_gained", "opponent_screen_gained")


@on_matches("turn_reasons", "WITH RECURSIVE " + TL + f""", r AS (SELECT u, job_id, match, tn, list_concat(list_transform(pl, lambda x: 'Player lost ' || x), list_transform(ol, lambda x: 'Opponent lost ' || x),
  list_filter([CASE WHEN tw IN ('player', 'opponent') AND tw IS DISTINCT FROM ptw THEN (CASE tw WHEN 'player' THEN 'Player' ELSE 'Opponent' END) || ' gained Tailwind' END,
  CASE WHEN tr AND NOT coalesce(ptr, false) THEN 'Trick Room is active' END,
  CASE WHEN wt <> 'none' AND wt IS DISTINCT FROM pwt THEN 'Weather: ' || wt END,
  CASE WHEN te <> 'none' AND te IS DISTINCT FROM pte THEN 'Terrain: ' || te END], lambda x: x IS NOT NULL)) x FROM tl)
SELECT {K}, tn AS turn, CASE WHEN len(x) > 0 THEN array_to_string(x, '; ') ELSE 'No notable change this turn' END AS reasons FROM r""")
def turn_reasons(ev):
    line = s.strategy_of(ev).timeline
    return line.select(*KEY, "turn", F.array_join("reasons", "; ").alias("reasons"))


@on_matches("speed_factors", "WITH RECURSIVE " + TL + f"""
SELECT {K}, tn AS turn, 'tailwind:' || tw AS factor FROM tl WHERE tw IN ('player', 'opponent', 'both')
UNION ALL SELECT {K}, tn, 'trick_room:' || CASE WHEN rp AND NOT ro THEN 'player' WHEN ro AND NOT rp THEN 'opponent' ELSE 'unclear' END FROM tl WHERE tr
UNION ALL SELECT g.u, g.job_id, g.match, g.tn, 'tool:' || side || ':' || pokemon || ':' || trim(split_part(detail, ':', 2))
  FROM grid g JOIN tool t ON t.job_id = g.job_id AND t.match = g.match AND t.ft < g.tn""")
def speed_factors(ev):
    return s.speed_factors(s.strategy_of(ev))


MOMENTUM = f"""me AS (
SELECT u, job_id, match, tn, 'negative' cat, 'own_pokemon_fainted' ty, side FROM lost
UNION ALL SELECT u, job_id, match, tn, 'positive', 'opponent_pokemon_fainted', CASE side WHEN 'player' THEN 'opponent' ELSE 'player' END FROM lost
UNION ALL SELECT u, job_id, match, tn, 'positive', 'big_stat_boost', side FROM bo
UNION ALL SELECT u, job_id, match, tn, 'positive', 'screen_established', 'player' FROM tl WHERE pgain
UNION ALL SELECT u, job_id, match, tn, 'positive', 'screen_established', 'opponent' FROM tl WHERE ogain)"""


@on_matches("momentum_events", "WITH RECURSIVE " + TL + ", " + MOMENTUM + f" SELECT {K}, tn AS turn, cat AS category, ty AS type, side FROM me")
def momentum_events(ev):
    return s.momentum_events(s.strategy_of(ev)).drop("detail")


@on_matches("resource_summary", "WITH RECURSIVE " + TL + """
SELECT u AS user_id, job_id, match, count(*) AS turns_played, arg_min(pa, tn) AS player_alive_start, arg_min(oa, tn) AS opponent_alive_start,
  arg_max(pa, tn) AS player_alive_final, arg_max(oa, tn) AS opponent_alive_final FROM tl GROUP BY ALL""")
def resource_summary(ev):
    return s.resource_summary(s.strategy_of(ev)).drop("final_win_probability")


MISTAKES = """mk AS (
SELECT f.u, f.job_id, f.match, f.tn, 'blind_switch_koed' ty, f.side FROM act f WHERE f.ty = 'fainted' AND EXISTS (
  SELECT 1 FROM act a WHERE a.ty = 'switch' AND a.job_id = f.job_id AND a.match = f.match AND a.tn = f.tn AND a.side = f.side AND a.pokemon = f.pokemon)
UNION ALL SELECT u, job_id, match, tn, 'big_momentum_swing', CASE WHEN delta > 0 THEN 'opponent' ELSE 'player' END FROM tl WHERE abs(delta) >= 40)"""


@on_matches("mistake_candidates", "WITH RECURSIVE " + TL + ", " + MISTAKES + f" SELECT {K}, tn AS turn, ty AS type, side FROM mk")
def mistake_candidates(ev):
    return s.mistake_candidates(s.strategy_of(ev)).drop("detail")


WINCON = """lt AS (SELECT job_id, match, max(tn) lt, min(tn) f FROM grid GROUP BY ALL),
sw AS (SELECT b.u, b.job_id, b.match, b.side, b.pokemon, list(b.tn ORDER BY b.tn)[2] te, count(*) n,
  EXISTS (SELECT 1 FROM slots s JOIN lt ON lt.job_id = s.job_id AND lt.match = s.match WHERE s.job_id = b.job_id AND s.match = b.match AND s.side = b.side AND s.pokemon = b.pokemon AND (s.ft IS NULL OR s.ft >= lt.lt)) alive
  FROM bo b GROUP BY b.u, b.job_id, b.match, b.side, b.pokemon HAVING count(*) >= 2),
cl0 AS (SELECT a.u, a.job_id, a.match, a.side, a.pokemon, count(*) n, min((a.tn, a.event_idx)) f FROM act a WHERE a.ty = 'move' AND EXISTS (
  SELECT 1 FROM act x WHERE x.ty = 'fainted' AND x.job_id = a.job_id AND x.match = a.match AND x.tn = a.tn AND x.side <> a.side) GROUP BY ALL),
cl AS (SELECT * FROM cl0 QUALIFY row_number() OVER (PARTITION BY job_id, match, side ORDER BY n DESC, f) = 1)"""


@on_matches("designated_sweepers", "WITH RECURSIVE " + TL + ", " + WINCON + f"""
SELECT {K}, side, pokemon, te AS turn_established, n AS boost_count, alive AS survived_to_last_turn_seen FROM sw""")
def designated_sweepers(ev):
    return s.designated_sweepers(s.strategy_of(ev))


@on_matches("primary_closers", "WITH RECURSIVE " + TL + ", " + WINCON + f" SELECT {K}, side, pokemon, n AS count FROM cl WHERE n >= 2")
def primary_closers(ev):
    return s.primary_closers(s.strategy_of(ev))


_CHART = ", ".join(f"('{a}', '{d}', {float(m)})" for a in fixed.TYPES for d, m in fixed.TYPE_CHART[a].items())
_DEX = ", ".join(f"('{n}', {i}, '{t}')" for n, ts in fixed.SPECIES_TYPES.items() for i, t in enumerate(ts))
# Multiplier of the best own type of one species against another.
DEX = f"""chart(a, d, m) AS (VALUES {_CHART}), dex(n, i, t) AS (VALUES {_DEX}),
types(t) AS (SELECT unnest([{_IN(fixed.TYPES)}])), species AS (SELECT DISTINCT n FROM dex),
guard AS (SELECT s.n, t.t atk, coalesce(max(c.m) FILTER (WHERE d.i = 0), 1) * coalesce(max(c.m) FILTER (WHERE d.i = 1), 1) mult
  FROM species s CROSS JOIN types t JOIN dex d ON d.n = s.n LEFT JOIN chart c ON c.a = t.t AND c.d = d.t GROUP BY ALL),
best AS (SELECT x.n a, g.n d, max(g.mult) b FROM dex x JOIN guard g ON g.atk = x.t GROUP BY ALL)"""

THREATS = """th AS (SELECT o.u, o.job_id, o.match, o.pokemon, list(p.pokemon ORDER BY p.pokemon) hit, count(*) + 0.5 * count(*) FILTER (WHERE b.b >= 4) sc
  FROM (SELECT DISTINCT u, job_id, match, pokemon FROM slots WHERE side = 'opponent') o
  JOIN (SELECT DISTINCT job_id, match, pokemon FROM slots WHERE side = 'player') p ON p.job_id = o.job_id AND p.match = o.match
  JOIN best b ON b.a = o.pokemon AND b.d = p.pokemon AND b.b > 1
  WHERE EXISTS (SELECT 1 FROM grid g WHERE g.job_id = o.job_id AND g.match = o.match) GROUP BY o.u, o.job_id, o.match, o.pokemon)"""


@on_matches("threats", "WITH RECURSIVE " + TL + ", " + DEX + ", " + THREATS + f"""
SELECT {K}, pokemon, array_to_string(hit, ', ') AS threatens, cast(sc AS DOUBLE) AS threat_score,
  cast(row_number() OVER (PARTITION BY job_id, match ORDER BY sc DESC, pokemon) AS INT) AS place FROM th""")
def threats(ev):
    rows = s.threats(s.strategy_of(ev))
    return rows.withColumn("threatens", F.array_join("threatens", ", "))


@on_matches("threat_moves", "WITH RECURSIVE " + TL + f"""
SELECT DISTINCT {K}, pokemon, mv AS move_name FROM km WHERE side = 'opponent'""")
def threat_moves(ev):
    return s.threat_moves(s.strategy_of(ev))


LOSS = """be AS (SELECT job_id, match, winner FROM ev WHERE event = 'battle_end' AND winner IN ('player', 'opponent')),
lo AS (SELECT tl.u, tl.job_id, tl.match, be.winner, CASE be.winner WHEN 'player' THEN 'opponent' ELSE 'player' END loser, max(tn) lt,
  max(tn) FILTER (WHERE (CASE be.winner WHEN 'player' THEN oa - pa ELSE pa - oa END) >= 0) ev_t FROM tl JOIN be USING (job_id, match) GROUP BY ALL),
fb AS (SELECT job_id, match, side loser, max(tn) ft FROM act WHERE ty = 'fainted' GROUP BY ALL),
loss AS (SELECT lo.*, CASE WHEN ev_t < lt THEN ev_t END dt, fb.ft FROM lo LEFT JOIN fb USING (job_id, match, loser))"""


@on_matches("loss_trace", "WITH RECURSIVE " + TL + ", " + LOSS + f"""
SELECT {K}, winner, loser, dt AS decisive_turn, ft AS final_blow_turn,
  CASE WHEN ev_t IS NULL THEN 'behind_from_start' WHEN ev_t = lt THEN 'level_to_the_end' ELSE 'turned' END AS course FROM loss""")
def loss_trace(ev):
    return s.loss_trace(s.strategy_of(ev), ev)


@on_matches("final_blows", "WITH RECURSIVE " + TL + ", " + LOSS + f"""
SELECT a.u AS user_id, a.job_id, a.match, a.tn AS turn, a.side, a.pokemon FROM act a JOIN loss l ON l.job_id = a.job_id AND l.match = a.match AND l.loser = a.side AND l.ft = a.tn
WHERE a.ty = 'fainted'""")
def final_blows(ev):
    st = s.strategy_of(ev)
    return s.final_blows(st, s.loss_trace(st, ev)).drop("seq")


@on_matches("analyze_job", "WITH RECURSIVE " + TL + ", " + MISTAKES + ", " + WINCON + ", " + DEX + ", " + THREATS + ", " + LOSS + """
SELECT m.u AS user_id, m.job_id, m.match, coalesce(t.n, 0) AS turns, coalesce(k.n, 0) AS mistakes, coalesce(w.n, 0) AS win_conditions, coalesce(x.n, 0) AS threats, loser, dt AS decisive_turn
FROM (SELECT DISTINCT user_id_text u, job_id, match FROM ev) m
LEFT JOIN (SELECT job_id, match, count(*) n FROM tl GROUP BY ALL) t USING (job_id, match)
LEFT JOIN (SELECT job_id, match, count(*) n FROM mk GROUP BY ALL) k USING (job_id, match)
LEFT JOIN (SELECT job_id, match, count(*) n FROM (SELECT job_id, match FROM sw UNION ALL SELECT job_id, match FROM cl WHERE n >= 2) GROUP BY ALL) w USING (job_id, match)
LEFT JOIN (SELECT job_id, match, count(*) n FROM th GROUP BY ALL) x USING (job_id, match)
LEFT JOIN loss USING (job_id, match)""")
def analyze_job(ev):
    return s.analyze_job(s.strategy_of(ev), ev)


_P = lambda cond: f"cast(round_even(100.0::DOUBLE * count(*) FILTER (WHERE {cond}) / count(*), 1) AS DOUBLE)"


@on_matches("battle_profile", "WITH RECURSIVE " + TL + ", " + MISTAKES + ", " + LOSS + f""",
p AS (SELECT u AS user_id, count(*) AS turns_analyzed, cast(round_even(avg(pos), 1) AS DOUBLE) AS average_position, min(pos) AS worst_position, max(pos) AS best_position,
  {_P("band = 'Even'")} AS band_even_pct, {_P("band = 'Slight Advantage'")} AS band_slight_advantage_pct, {_P(POSTURE.format('band') + " = 'safe'")} AS posture_safe_pct,
  {_P("sp > 0")} AS speed_player_pct, {_P("sp = 0 AND (tw = 'both' OR tr)")} AS speed_contested_pct, {_P("th < 0")} AS threat_opponent_pct,
  count(*) FILTER (WHERE list_contains(pcs, 'spread')) AS player_spread_turns, {_P("psc")} AS player_screen_uptime_pct, cast(round_even(avg(ss), 1) AS DOUBLE) AS average_screen_score,
  {_P("delta > 10")} AS momentum_gained_pct FROM tl GROUP BY u),
f AS (SELECT u AS user_id, cast(round_even(avg(x), 1) AS DOUBLE) AS final_turn_average, count(*) AS matches_with_turns FROM (SELECT u, job_id, match, arg_max(pos, tn) x FROM tl GROUP BY ALL) GROUP BY u),
m AS (SELECT u AS user_id, count(*) FILTER (WHERE ty = 'blind_switch_koed') AS blind_switches, count(*) FILTER (WHERE ty = 'big_momentum_swing') AS big_swings FROM mk GROUP BY u),
l AS (SELECT u AS user_id, count(*) AS losses_analyzed, cast(round_even(avg(dt), 1) AS DOUBLE) AS average_decisive_turn FROM loss WHERE loser = 'player' GROUP BY u)
SELECT p.*, final_turn_average, matches_with_turns, coalesce(blind_switches, 0) AS blind_switches, coalesce(big_swings, 0) AS big_swings,
  coalesce(losses_analyzed, 0) AS losses_analyzed, average_decisive_turn
FROM p LEFT JOIN f USING (user_id) LEFT JOIN m USING (user_id) LEFT JOIN l USING (user_id)""")
def battle_profile(ev):
    return s.battle_profile(s.strategy_of(ev), ev, ["user_id"]).select(
        "user_id", "turns_analyzed", "average_position", "worst_position", "best_position", "band_even_pct",
        "band_slight_advantage_pct", "posture_safe_pct", "speed_player_pct", "speed_contested_pct",
        "threat_opponent_pct", "player_spread_turns", "player_screen_uptime_pct", "average_screen_score",
        "momentum_gained_pct", "final_turn_average", "matches_with_turns", "blind_switches", "big_swings",
        "losses_analyzed", "average_decisive_turn")


@on_matches("profile_tops", "WITH RECURSIVE " + TL + ", " + WINCON + ", " + LOSS + """,
x AS (SELECT u, 'designated_sweeper' kind, pokemon FROM sw WHERE side = 'player' UNION ALL SELECT u, 'primary_closer', pokemon FROM cl WHERE side = 'player' AND n >= 2
  UNION ALL SELECT a.u, 'final_blow', a.pokemon FROM act a JOIN loss l ON l.job_id = a.job_id AND l.match = a.match AND l.loser = 'player' AND a.side = 'player' AND l.ft = a.tn WHERE a.ty = 'fainted')
SELECT u AS user_id, kind, pokemon, count(*) AS n, row_number() OVER (PARTITION BY u, kind ORDER BY count(*) DESC, pokemon) AS rank
FROM x GROUP BY u, kind, pokemon QUALIFY rank <= 5""")
def profile_tops(ev):
    return s.profile_tops(s.strategy_of(ev), ev, ["user_id"])
