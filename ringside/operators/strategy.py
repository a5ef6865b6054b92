"""Scores per turn and what they say about a match.

Everything reads the tables of `turns`; each score is a plain expression over
one wide row per turn.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.contracts import KEY, SIDES
from ringside.functions import columns as c
from ringside.functions import fixed_values as fixed
from ringside.operators import teams, turns
from ringside.operators.record import top_n
from ringside.plans.ordering import materialise
from ringside.plans.scan import last_of, scan, sum_of

OTHER = {"player": "opponent", "opponent": "player"}
LABEL = {"player": "Player", "opponent": "Opponent"}
CATEGORIES = ["fake_out", "redirection", "spread"]


@dataclass(frozen=True)
class Strategy:
    turns: turns.Turns
    windows: turns.Turns
    slots: DataFrame
    boards: DataFrame
    timeline: DataFrame


def strategy_of(events: DataFrame, order="event_idx", window_order=None) -> Strategy:
    """Turn tables and the timeline, each written once for all reports over them.

    Decision windows follow time, the other readings follow arrival. Where the
    two differ, `window_order` names the time order (`in_time_order`).
    """
    t = turns.turns_of(events, order)
    w = t if window_order in (None, order) else turns.turns_of(events, window_order)
    slots = materialise(turns.roster_slots(w))
    boards = materialise(turns.board(w))
    return Strategy(t, w, slots, boards, materialise(momentum_timeline(t, w, slots, boards)))


def move_category(name):
    low = F.lower(name)
    return (
        F.when(low.isin(fixed.SPREAD_MOVES), "spread")
        .when(low == "fake out", "fake_out")
        .when(low.isin(fixed.REDIRECTION_MOVES), "redirection")
    )


def board_categories(t, boards) -> DataFrame:
    """Dangerous move groups already revealed by the species on the board: rows (turn, side, category)."""
    known = turns.first_reveals(t).withColumn("category", move_category(F.col("move_name")))
    known = known.where(F.col("category").isNotNull()).groupBy(*KEY, "side", "pokemon", "category").agg(
        F.min("first.turn").alias("since"))
    shown = boards.select(*KEY, "side", "turn", F.explode(F.array_distinct("board")).alias("pokemon"))
    hits = shown.join(known, [*KEY, "side", "pokemon"]).where(F.col("since") < F.col("turn"))
    return hits.select(*KEY, "turn", "side", "category")


def offensive_boosts(t) -> DataFrame:
    return turns.stat_changes(t).where((F.col("direction") > 0) & F.col("stat").isin(fixed.OFFENSIVE_STATS))


def lost_species(t, slots) -> DataFrame:
    """Species whose loss shows at the start of a turn: those that fainted in the turn before it."""
    following = scan(t.grid, KEY, "turn", {"next_turn": last_of(F.col("turn"), inclusive=False)}, reverse=True)
    gone = slots.where(F.col("faint_turn").isNotNull()).select(*KEY, "side", "pokemon", F.col("faint_turn").alias("turn"))
    rows = gone.distinct().join(following, [*KEY, "turn"]).where(F.col("next_turn").isNotNull())
    return rows.select(*KEY, F.col("next_turn").alias("turn"), "side", "pokemon")


def _clamped(value, limit):
    return c.clamp(F.rint(value), float(-limit), float(limit)).cast("int")


def turn_facts(t, w, slots, boards) -> DataFrame:
    """One row per turn of the grid: what its events, boards and known HP add up to, from one exchange of all of them."""
    on = [*KEY, "turn"]
    marks = {
        "down": slots.where(F.col("faint_turn").isNotNull()).select(*KEY, "side", F.col("faint_turn").alias("turn")),
        "tools": turns.speed_tools(t).select(*on, "side"),
        "faints": turns.turn_faints(t).select(*on, "side"),
        "boosts": offensive_boosts(t).select(*on),
        "hp": turns.hp_at_start(t, slots.drop("pokemon"), w).select(*on, "side", "known_hp"),
    }
    rows = [r.withColumn("_kind", F.lit(k)) for k, r in {"grid": w.grid, **marks}.items()]
    rows.append(board_categories(w, boards).withColumnRenamed("category", "_kind"))
    # Rows without a whole key belong to no match.
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).dropna("any", subset=KEY)
    here = lambda kind, s: (F.col("_kind") == kind) & (F.col("side") == s)
    out = rows.groupBy(*on).agg(
        F.count_if(F.col("_kind") == "grid").alias("_grid"),
        *[F.count_if(here(kind, s)).alias(name) for s in SIDES for kind, name in (
            ("down", f"_{s}_down"), ("tools", f"_{s}_tools"), ("faints", f"{s}_faints"))],
        F.count_if(F.col("_kind") == "boosts").alias("boosts"),
        *[F.avg(F.when(here("hp", s), F.col("known_hp"))).alias(f"{s}_hp") for s in SIDES],
        *[F.bool_or(here(k, s)).alias(f"{s}_{k}") for s in SIDES for k in CATEGORIES])
    return out.where("_grid > 0").drop("_grid")


def momentum_timeline(t, w, slots, boards) -> DataFrame:
    """Every score of every turn, one row per turn."""
    on = [*KEY, "turn"]
    facts = turn_facts(t, w, slots, boards)
    down, tools = ({f"{s}_{name}": sum_of(F.col(f"_{s}_{name}"), inclusive=False) for s in SIDES} for name in ("down", "tools"))
    rows = scan(facts, KEY, "turn", {**down, **tools}).drop(*[f"_{n}" for n in [*down, *tools]])
    rows = rows.join(turns.turn_conditions(t), on, "left")
    lost = lost_species(w, slots)
    # One turn and side per group, out of one roster.
    lost = lost.groupBy(*on).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("pokemon")))).alias(f"{s}_lost") for s in SIDES])
    rows = rows.join(lost, on, "left")
    roster = slots.groupBy(*KEY).agg(*[F.count_if(F.col("side") == s).alias(f"{s}_roster") for s in SIDES])
    setters = turns.trick_room_setters(t).groupBy(*KEY).agg(*[
        F.bool_or(F.col("side") == s).alias(f"{s}_set_room") for s in SIDES])
    rows = rows.join(roster, KEY, "left").fillna(0, [f"{s}_roster" for s in SIDES]).join(setters, KEY, "left")

    false, none = F.lit(False), F.array().cast("array<string>")
    rows = rows.withColumns({
        **{f"{s}_{k}": F.coalesce(f"{s}_{k}", false) for s in SIDES for k in [*CATEGORIES, "set_room"]},
        **{f"{s}_lost": F.coalesce(f"{s}_lost", none) for s in SIDES},
        **{f"{s}_alive": F.col(f"{s}_roster") - F.col(f"{s}_down") for s in SIDES},
        **{f"{s}_screen": c.screen_up("screens", s) for s in SIDES},
    })
    alive = (F.col("player_alive") - F.col("opponent_alive")) * fixed.ALIVE_WEIGHT
    wind = F.when(F.col("tailwind") == "player", 1).when(F.col("tailwind") == "opponent", -1).otherwise(0)
    hp_gap = F.coalesce(F.col("player_hp") - F.col("opponent_hp"), F.lit(0.0)) * fixed.HP_WEIGHT
    shown_hp = {s: F.bround(f"{s}_hp", 1) for s in SIDES}
    shown_gap = F.coalesce(shown_hp["player"] - shown_hp["opponent"], F.lit(0.0)) * fixed.HP_WEIGHT
    tools = (F.col("player_tools") - F.col("opponent_tools")) * fixed.SPEED_TOOL_WEIGHT
    flags = lambda s: reduce(lambda a, b: a + b, [F.col(f"{s}_{k}").cast("int") for k in CATEGORIES])
    threat = (flags("player") - flags("opponent")) * fixed.THREAT_TOOL_WEIGHT
    screens = (F.col("player_screen").cast("int") - F.col("opponent_screen").cast("int")) * fixed.SCREEN_WEIGHT
    rows = rows.withColumns({
        "score": _clamped(alive + wind * fixed.TAILWIND_WEIGHT + hp_gap, fixed.SCORE_CLAMP),
        "speed_score": _clamped(tools, fixed.SPEED_CLAMP),
        "threat_score": _clamped(threat, fixed.THREAT_CLAMP),
        "board_score": _clamped(alive + shown_gap, fixed.SCORE_CLAMP),
        "screen_score": screens,
        "player_avg_hp": shown_hp["player"],
        "opponent_avg_hp": shown_hp["opponent"],
    })
    room = F.coalesce("trick_room", false)
    rows = rows.withColumns({
        "resource_score": _clamped(F.col("board_score") + F.col("screen_score"), fixed.SCORE_CLAMP),
        "speed_side": F.when(F.col("speed_score") > 0, "player").when(F.col("speed_score") < 0, "opponent")
        .when((F.col("tailwind") == "both") | room, "contested").otherwise("none"),
        "threat_side": F.when(F.col("threat_score") > 0, "player").when(F.col("threat_score") < 0, "opponent")
        .otherwise("even"),
        "position": _clamped(
            F.col("score") + F.col("speed_score") + F.col("threat_score") + F.col("screen_score"), fixed.SCORE_CLAMP),
        "win_probability": c.win_probability("score"),
        "trick_room": room,
    })
    state = F.struct("score", *turns.CONDITIONS, "player_screen", "opponent_screen")
    rows = scan(rows, KEY, "turn", {"_prev": last_of(state, inclusive=False)})
    delta = F.coalesce(F.col("score") - F.col("_prev.score"), F.lit(0))
    gained = {s: F.col(f"{s}_screen") & ~F.coalesce(F.col(f"_prev.{s}_screen"), false) for s in SIDES}
    rows = rows.withColumns({
        "delta": delta,
        "band": c.position_band("position"),
        "direction": F.when(delta > fixed.NEUTRAL_BAND, "gained").when(delta < -fixed.NEUTRAL_BAND, "lost")
        .otherwise("neutral"),
        **{f"{s}_screen_gained": g for s, g in gained.items()},
    })
    return rows.withColumns({
        "posture": c.risk_posture("band"),
        "reasons": turn_reasons(),
    }).drop("_prev")


def turn_reasons():
    """Plain-language causes of a turn's change: losses first, then conditions newly on."""
    prev = lambda name: F.col(f"_prev.{name}")
    def losses(side):
        return F.transform(f"{side}_lost", lambda x: F.concat(F.lit(f"{LABEL[side]} lost "), x))

    parts = [losses(side) for side in SIDES]
    changed = lambda name: F.col(name).isNotNull() & ~F.col(name).eqNullSafe(prev(name))
    wind = F.col("tailwind").isin(*SIDES) & changed("tailwind")
    on = lambda name: changed(name) & ~F.col(name).isin("none", "")
    notes = F.array(
        F.when(wind, F.concat(F.initcap("tailwind"), F.lit(" gained Tailwind"))),
        F.when(F.col("trick_room") & ~F.coalesce(prev("trick_room"), F.lit(False)), "Trick Room is active"),
        F.when(on("weather"), F.concat(F.lit("Weather: "), F.col("weather"))),
        F.when(on("terrain"), F.concat(F.lit("Terrain: "), F.col("terrain"))))
    told = F.concat(*parts, F.filter(notes, lambda x: x.isNotNull()))
    return F.when(F.size(told) > 0, told).otherwise(F.array(F.lit("No notable change this turn")))


def speed_factors(s: Strategy) -> DataFrame:
    """Speed control explained: one row per turn and factor."""
    line = s.timeline
    room = (
        F.when(F.col("player_set_room") & ~F.col("opponent_set_room"), "player")
        .when(F.col("opponent_set_room") & ~F.col("player_set_room"), "opponent").otherwise("unclear"))
    facts = F.array(
        F.when(F.col("tailwind").isin("player", "opponent", "both"), F.concat(F.lit("tailwind:"), F.col("tailwind"))),
        F.when(F.col("trick_room"), F.concat(F.lit("trick_room:"), room)))
    noted = line.select(*KEY, "turn", F.explode(F.filter(facts, lambda x: x.isNotNull())).alias("factor"))
    tools = turns.speed_tools(s.turns).withColumnRenamed("turn", "since")
    seen = line.select(*KEY, "turn").join(tools, KEY).where(F.col("since") < F.col("turn"))
    seen = seen.select(*KEY, "turn", F.concat(
        F.lit("tool:"), "side", F.lit(":"), "pokemon", F.lit(":"), "tool").alias("factor"))
    return noted.unionByName(seen)


def momentum_events(s: Strategy) -> DataFrame:
    """Rows (turn, category, type, side, detail) behind the momentum of a turn."""
    lost = lost_species(s.windows, s.slots)
    name = F.initcap("side")
    own = lost.select(*KEY, "turn", F.lit("negative").alias("category"), F.lit("own_pokemon_fainted").alias("type"),
                      "side", F.concat(name, F.lit(" lost "), "pokemon").alias("detail"))
    other = F.when(F.col("side") == "player", "opponent").otherwise("player")
    gain = lost.select(
        *KEY, "turn", F.lit("positive").alias("category"), F.lit("opponent_pokemon_fainted").alias("type"),
        other.alias("side"),
        F.concat(name, F.lit("'s "), "pokemon", F.lit(" fainted, a gain for "), F.initcap(other)).alias("detail"))
    boosts = offensive_boosts(s.turns).select(
        *KEY, "turn", F.lit("positive").alias("category"), F.lit("big_stat_boost").alias("type"), "side",
        F.concat(name, F.lit("'s "), "pokemon", F.lit("'s "), "stat", F.lit(" rose")).alias("detail"))
    screens = s.timeline.select(*KEY, "turn", F.explode(F.filter(F.array(*[
        F.when(F.col(f"{x}_screen_gained"), F.lit(x)) for x in SIDES]), lambda x: x.isNotNull())).alias("side"))
    screens = screens.select(
        *KEY, "turn", F.lit("positive").alias("category"), F.lit("screen_established").alias("type"), "side",
        F.concat(name, F.lit(" set up a screen this turn")).alias("detail"))
    return own.unionByName(gain).unionByName(boosts).unionByName(screens)


def resource_summary(s: Strategy) -> DataFrame:
    first, last = (lambda x: F.min_by(x, "turn")), (lambda x: F.max_by(x, "turn"))
    return s.timeline.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("turns_played"),
        first("player_alive").alias("player_alive_start"), first("opponent_alive").alias("opponent_alive_start"),
        last("player_alive").alias("player_alive_final"), last("opponent_alive").alias("opponent_alive_final"),
        last("win_probability").alias("final_win_probability"))


def mistake_candidates(s: Strategy) -> DataFrame:
    """Switch-ins that fainted the same turn, and big swings of the score."""
    acts = turns.turn_actions(s.windows)
    came = acts.where("type = 'switch'").select(*KEY, "turn", "side", "pokemon").distinct()
    blind = turns.turn_faints(s.turns).join(came, [*KEY, "turn", "side", "pokemon"], "left_semi").select(
        *KEY, "turn", F.lit("blind_switch_koed").alias("type"), "side",
        F.concat(F.initcap("side"), F.lit(" switched in "), "pokemon", F.lit(" and it fainted the same turn")).alias("detail"))
    size = F.abs("delta")
    gainer = F.when(F.col("delta") > 0, "player").otherwise("opponent")
    loser = F.when(F.col("delta") > 0, "opponent").otherwise("player")
    swing = s.timeline.where(size >= fixed.SWING_THRESHOLD).select(
        *KEY, "turn", F.lit("big_momentum_swing").alias("type"), loser.alias("side"),
        F.concat(F.lit("the advantage score swung "), size, F.lit(" points toward "), F.initcap(gainer)).alias("detail"))
    return blind.unionByName(swing)


def _last_turn(s):
    return s.timeline.groupBy(*KEY).agg(F.max("turn").alias("last_turn"))


def designated_sweepers(s: Strategy) -> DataFrame:
    """Species with two or more offensive boosts; the turn of the second; alive in the last window or not."""
    keys = [*KEY, "side", "pokemon"]
    boosts = offensive_boosts(s.turns)
    count = boosts.groupBy(*keys).agg(F.count(F.lit(1)).alias("boost_count"))
    second = top_n(boosts, keys, ["turn", "seq"], fixed.SWEEPER_BOOSTS).where(F.col("rank") == fixed.SWEEPER_BOOSTS)
    last = s.slots.join(_last_turn(s), KEY).where(
        F.col("faint_turn").isNull() | (F.col("faint_turn") >= F.col("last_turn")))
    last = last.select(*keys).distinct().withColumn("_alive", F.lit(True))
    return (
        second.select(*keys, F.col("turn").alias("turn_established")).join(count, keys).join(last, keys, "left")
        .join(_last_turn(s).select(*KEY), KEY, "left_semi")
        .select(*keys, "turn_established", "boost_count",
                F.coalesce("_alive", F.lit(False)).alias("survived_to_last_turn_seen"))
    )


def primary_closers(s: Strategy) -> DataFrame:
    """Per side the species with most moves on turns in which an opposing species fell, at least two."""
    fell = turns.turn_faints(s.turns).select(
        *KEY, "turn", F.when(F.col("side") == "player", "opponent").otherwise("player").alias("side")).distinct()
    moves = turns.turn_actions(s.windows).where("type = 'move'").join(fell, [*KEY, "turn", "side"], "left_semi")
    counts = moves.groupBy(*KEY, "side", "pokemon").agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct("turn", "seq")).alias("_first"))
    best = counts.groupBy(*KEY, "side").agg(
        F.min_by(F.struct("pokemon", "count"), F.struct((-F.col("count")).alias("n"), "_first")).alias("_b"))
    return best.select(*KEY, "side", "_b.*").where(F.col("count") >= fixed.CLOSER_TURNS)


def win_conditions(s: Strategy) -> DataFrame:
    sweep = designated_sweepers(s).select(*KEY, F.lit("designated_sweeper").alias("type"), "side", "pokemon")
    close = primary_closers(s).select(*KEY, F.lit("primary_closer").alias("type"), "side", "pokemon")
    return sweep.unionByName(close)


def threats(s: Strategy, dex=None) -> DataFrame:
    """Opponent species that hit the player's brought species super-effectively with their own types."""
    rosters = teams.match_rosters(s.slots.join(_last_turn(s).select(*KEY), KEY, "left_semi"))
    return teams.type_threats(rosters, KEY, "opponent_brought", "player_brought", dex)


def threat_moves(s: Strategy) -> DataFrame:
    """Moves each opponent species had shown by the last turn it was on the board."""
    shown = s.boards.where("side = 'opponent'").select(*KEY, "turn", F.explode("board").alias("pokemon"))
    until = shown.groupBy(*KEY, "pokemon").agg(F.max("turn").alias("until"))
    seen = turns.first_reveals(s.windows).where("side = 'opponent'").join(until, [*KEY, "pokemon"])
    return seen.where(F.col("first.turn") < F.col("until")).select(*KEY, "pokemon", "move_name")


def loss_trace(s: Strategy, events: DataFrame) -> DataFrame:
    """Per decided match: the last turn the loser was level or ahead, and the turn of its last loss."""
    said = F.coalesce(F.when(F.col("winner") != "", F.col("winner")), F.col("actor"))
    ends = events.where((F.col("event") == "battle_end") & F.col("match").isNotNull()).groupBy(*KEY).agg(
        F.min_by(said, "event_idx").alias("winner"))
    ends = ends.where(F.col("winner").isin(*SIDES))
    loser = F.when(F.col("winner") == "player", "opponent").otherwise("player")
    line = s.timeline.select(*KEY, "turn", "player_alive", "opponent_alive").join(ends, KEY)
    gap = F.when(F.col("winner") == "player", F.col("opponent_alive") - F.col("player_alive")).otherwise(
        F.col("player_alive") - F.col("opponent_alive"))
    seen = line.groupBy(*KEY, "winner").agg(
        F.max("turn").alias("last_turn"), F.max(F.when(gap >= 0, F.col("turn"))).alias("level_turn"))
    blows = turns.turn_faints(s.turns).groupBy(*KEY, F.col("side").alias("loser")).agg(F.max("turn").alias("final_blow_turn"))
    rows = seen.withColumn("loser", loser).join(blows, [*KEY, "loser"], "left")
    return rows.select(
        *KEY, "winner", "loser",
        F.when(F.col("level_turn") < F.col("last_turn"), F.col("level_turn")).alias("decisive_turn"),
        "final_blow_turn",
        F.when(F.col("level_turn").isNull(), "behind_from_start")
        .when(F.col("level_turn") == F.col("last_turn"), "level_to_the_end").otherwise("turned").alias("course"))


def final_blows(s: Strategy, traces: DataFrame) -> DataFrame:
    """Species the loser lost in the turn of its last loss."""
    marks = traces.select(*KEY, F.col("loser").alias("side"), F.col("final_blow_turn").alias("turn"))
    return turns.turn_faints(s.turns).join(marks, [*KEY, "side", "turn"], "left_semi")


def analyze_job(s: Strategy, events: DataFrame, dex=None) -> DataFrame:
    """One row per match with the size of every report; a match without turns keeps its row."""
    counted = lambda rows, name: rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias(name))
    out = events.where(F.col("match").isNotNull()).select(*KEY).distinct()
    out = out.join(counted(s.timeline, "turns"), KEY, "left")
    out = out.join(counted(mistake_candidates(s), "mistakes"), KEY, "left")
    out = out.join(counted(win_conditions(s), "win_conditions"), KEY, "left")
    out = out.join(counted(threats(s, dex), "threats"), KEY, "left").fillna(0)
    return out.join(loss_trace(s, events).select(*KEY, "loser", "decisive_turn"), KEY, "left")


def battle_profile(s: Strategy, events: DataFrame, by) -> DataFrame:
    """Averages and shares over all turns of a job or a career."""
    line = s.timeline
    n = F.count(F.lit(1))
    share = lambda condition: F.bround(F.count_if(condition) * 100.0 / n, 1)
    mean = lambda x: F.bround(F.avg(x), 1)
    side = lambda column, value: share(F.col(column) == value)
    bands = {label.lower().replace(" ", "_"): label for _, label, _ in fixed.POSITION_BANDS}
    postures = list(dict.fromkeys(p for _, _, p in fixed.POSITION_BANDS))
    out = line.groupBy(*by).agg(
        n.alias("turns_analyzed"),
        mean("position").alias("average_position"),
        F.min("position").alias("worst_position"), F.max("position").alias("best_position"),
        *[side("band", label).alias(f"band_{k}_pct") for k, label in bands.items()],
        *[side("posture", p).alias(f"posture_{p}_pct") for p in postures],
        *[side("speed_side", x).alias(f"speed_{x}_pct") for x in ("player", "opponent", "contested", "none")],
        *[side("threat_side", x).alias(f"threat_{x}_pct") for x in ("player", "opponent", "even")],
        *[F.count_if(f"{x}_{k}").alias(f"{x}_{k}_turns") for x in SIDES for k in CATEGORIES],
        *[share(F.col(f"{x}_screen")).alias(f"{x}_screen_uptime_pct") for x in SIDES],
        mean("screen_score").alias("average_screen_score"),
        *[side("direction", x).alias(f"momentum_{x}_pct") for x in ("gained", "lost", "neutral")],
    )
    final = line.groupBy(*dict.fromkeys([*by, *KEY])).agg(F.max_by("position", "turn").alias("_p"))
    out = out.join(final.groupBy(*by).agg(
        mean("_p").alias("final_turn_average"), F.count(F.lit(1)).alias("matches_with_turns")), by, "left")
    slips = mistake_candidates(s)
    out = out.join(slips.groupBy(*by).agg(
        F.count_if(F.col("type") == "blind_switch_koed").alias("blind_switches"),
        F.count_if(F.col("type") == "big_momentum_swing").alias("big_swings")), by, "left")
    lost = loss_trace(s, events).where("loser = 'player'").groupBy(*by).agg(
        F.count(F.lit(1)).alias("losses_analyzed"), mean("decisive_turn").alias("average_decisive_turn"))
    return out.join(lost, by, "left").fillna(0, ["blind_switches", "big_swings", "losses_analyzed"])


def profile_tops(s: Strategy, events: DataFrame, by, n=5) -> DataFrame:
    """The five most frequent sweepers, closers and last losses of the player."""
    wins = win_conditions(s).where("side = 'player'").select(*by, F.col("type").alias("kind"), "pokemon")
    traces = loss_trace(s, events).where("loser = 'player'")
    blows = final_blows(s, traces).select(*by, F.lit("final_blow").alias("kind"), "pokemon")
    counts = wins.unionByName(blows).groupBy(*by, "kind", "pokemon").agg(F.count(F.lit(1)).alias("n"))
    return top_n(counts, [*by, "kind"], [-F.col("n"), F.col("pokemon")], n)
