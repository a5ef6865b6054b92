"""Team and matchup arithmetic, computed inside each row without joins.

The dex (species -> types) is reference data of a few hundred entries that the
caller may replace; it enters the plan as one constant map.
"""

import json
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.contracts import KEY
from ringside.functions import columns as c
from ringside.functions import fixed_values as fixed

_ENTRY = "map<string,struct<types:array<int>,guard:array<double>>>"
_EMPTY = "array<string>"


def default_dex():
    return {name: list(types) for name, types in fixed.SPECIES_TYPES.items()}


def _guard(types):
    """Multiplier of each attacking type against these types."""
    chart = {(a, d): m for a, d, m in c.chart_rows()}
    out = []
    for attack in fixed.TYPES:
        product = 1.0
        for t in types:
            product *= chart.get((attack, t), 1.0)
        out.append(product)
    return out


def dex_map(dex=None):
    dex = default_dex() if dex is None else dex
    entries = {
        name: {"types": [fixed.TYPES.index(t) for t in types], "guard": _guard(types)} for name, types in dex.items()}
    return F.from_json(F.lit(json.dumps(entries)), _ENTRY)


def resolve(names, dex=None):
    """struct(name, types, guard) of the species that the dex knows, in list order."""
    entries = dex_map(dex)
    found = F.transform(names, lambda x: F.struct(x.alias("name"), F.try_element_at(entries, x).alias("e")))
    known = F.filter(found, lambda x: x["e"].isNotNull())
    return F.transform(known, lambda x: F.struct(
        x["name"].alias("name"), x["e"]["types"].alias("types"), x["e"]["guard"].alias("guard")))


def _best(attacker, defender):
    return F.array_max(F.transform(attacker["types"], lambda t: F.get(defender["guard"], t)))


def weaknesses(types):
    """struct(type, mult) of the attacking types above 1x.

    One pass over the defender's types multiplies all attacking types at once, so `types` is evaluated once a row.
    """
    by_defender = F.lit([_guard([t]) for t in fixed.TYPES])
    neutral = F.lit([1.0] * len(fixed.TYPES))

    def onto(product, t):
        factors = F.coalesce(F.get(by_defender, F.array_position(F.lit(fixed.TYPES), t).cast("int") - 1), neutral)
        return F.zip_with(product, factors, lambda a, b: a * b)

    product = F.coalesce(F.aggregate(types, neutral, onto), neutral)
    rows = F.zip_with(F.lit(fixed.TYPES), product, lambda t, m: F.struct(t.alias("type"), m.alias("mult")))
    return F.filter(rows, lambda x: x["mult"] > 1)


def _total(values):
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def shared_weaknesses(team):
    """struct(type, n) of attacking types that two or more resolved members are weak to."""
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(17)),
        lambda t: F.struct(F.get(F.lit(fixed.TYPES), t).alias("type"),
                           F.size(F.filter(team, lambda m: F.get(m["guard"], t) > 1)).alias("n")))
    return F.filter(rows, lambda x: x["n"] >= 2)


def quad_weaknesses(team):
    """struct(pokemon, type) of members that take four times the damage."""
    per_member = F.transform(team, lambda m: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(17)), lambda t: F.get(m["guard"], t) >= 4),
        lambda t: F.struct(m["name"].alias("pokemon"), F.get(F.lit(fixed.TYPES), t).alias("type"))))
    return F.flatten(per_member)


def risk_score(team):
    overlap = _total(F.transform(shared_weaknesses(team), lambda x: (x["n"] - 1).cast("double")))
    return F.bround(overlap + 1.5 * F.size(quad_weaknesses(team)), 2)


def team_risk(df: DataFrame, names, dex=None) -> DataFrame:
    """Add resolved, unresolved, shared_weaknesses, quad_weaknesses and risk_score of a name list."""
    df = df.withColumn("_team", resolve(F.col(names), dex))
    known = F.transform("_team", lambda x: x["name"])
    return df.withColumns({
        "resolved": known,
        "unresolved": F.filter(names, lambda x: ~F.array_contains(known, x)),
        "shared_weaknesses": shared_weaknesses(F.col("_team")),
        "quad_weaknesses": quad_weaknesses(F.col("_team")),
        "risk_score": risk_score(F.col("_team")),
    }).drop("_team")


def type_answers(attackers, defenders):
    """struct(defender, answers): who hits each resolved defender at 2x or more with an own type."""
    def one(d):
        strong = F.filter(attackers, lambda a: _best(a, d) >= 2)
        return F.struct(d["name"].alias("defender"), F.transform(strong, lambda a: a["name"]).alias("answers"))

    return F.transform(defenders, one)


def _answered(answers):
    return F.size(F.filter(answers, lambda x: F.size(x["answers"]) > 0))


def team_matchup(df: DataFrame, mine, theirs, dex=None) -> DataFrame:
    """Coverage both ways and the verdict at a quarter of a difference."""
    df = df.withColumns({"_m": resolve(F.array_distinct(mine), dex), "_t": resolve(F.array_distinct(theirs), dex)})
    df = df.withColumns({
        "your_type_answers": type_answers(F.col("_m"), F.col("_t")),
        "their_type_answers": type_answers(F.col("_t"), F.col("_m")),
    })
    yours, others = _answered(F.col("your_type_answers")), _answered(F.col("their_type_answers"))
    n_theirs, n_mine = F.size("_t"), F.size("_m")
    gap = F.try_divide(yours.cast("double"), n_theirs) - F.try_divide(others.cast("double"), n_mine)
    return df.withColumns({
        "your_coverage": F.when(n_theirs > 0, F.concat(yours, F.lit("/"), n_theirs)),
        "their_coverage": F.when(n_mine > 0, F.concat(others, F.lit("/"), n_mine)),
        "verdict": F.when(gap >= 0.25, "favorable").when(gap <= -0.25, "unfavorable").when(gap.isNotNull(), "even"),
    }).drop("_m", "_t")


def selection_score(candidate, opponent):
    """Preview score of a resolved selection against a resolved opponent; NULL when none is known."""
    offense = F.try_divide(_answered(type_answers(candidate, opponent)).cast("double"), F.size(opponent))
    defense = 1 / (1 + risk_score(candidate))
    return F.bround(100 * (0.65 * offense + 0.35 * defense), 1)


FOURS = [list(x) for x in combinations(range(6), 4)]


def all_selections(df: DataFrame, team, opponent, dex=None) -> DataFrame:
    """Add `selections`: the 15 ways to bring four of six, scored, in combination order."""
    df = df.withColumns({"_six": F.col(team), "_opp": resolve(F.array_distinct(opponent), dex)})
    picks = F.array(*[F.lit(x) for x in FOURS])
    df = df.withColumn("selections", F.when(F.size("_six") == 6, F.transform(
        picks, lambda p, i: F.struct(i.alias("no"), F.transform(p, lambda j: F.get(F.col("_six"), j)).alias("candidate")))))
    return df.withColumn("selections", F.transform("selections", lambda x: F.struct(
        x["no"].alias("no"), x["candidate"].alias("candidate"),
        selection_score(resolve(x["candidate"], dex), F.col("_opp")).alias("score")))).drop("_six", "_opp")


def preview_skill(df: DataFrame, team, brought, opponent, dex=None) -> DataFrame:
    """Regret and rank of the brought four among the 15 selections; rows that cannot be scored are dropped."""
    usable = (F.size(F.array_distinct(team)) == 6) & (F.size(team) == 6) & (F.size(brought) == 4) & (F.size(opponent) > 0)
    df = all_selections(df.where(usable), team, opponent, dex)
    df = df.withColumns({
        "_opp": resolve(F.array_distinct(opponent), dex),
        "_ranked": F.sort_array(F.transform("selections", lambda x: F.struct(
            (-x["score"]).alias("neg"), x["no"].alias("no"), x["candidate"].alias("candidate")))),
    })
    df = df.withColumn("selected_score", selection_score(resolve(F.col(brought), dex), F.col("_opp")))
    df = df.where(F.col("selected_score").isNotNull())
    best = F.get("_ranked", F.lit(0))
    chosen = F.array_sort(F.array_distinct(brought))
    place = F.array_position(F.transform("_ranked", lambda x: F.array_sort(x["candidate"])), chosen)
    df = df.withColumns({"best_score": -best["neg"], "best_candidate": best["candidate"], "_place": place})
    regret = F.bround(F.col("best_score") - F.col("selected_score"), 1)
    added = F.array_except("best_candidate", F.col(brought))
    removed = F.array_except(F.col(brought), "best_candidate")
    single = (F.size(added) == 1) & (F.size(removed) == 1)
    return df.withColumns({
        "regret": regret,
        "regret_category": c.regret_category(regret),
        "skill_pct": F.when(F.col("best_score") != 0, F.bround(F.col("selected_score") / F.col("best_score") * 100, 1)),
        "rank_of_selected": F.when(F.col("_place") > 0, F.col("_place")),
        "swap_out": F.when(single, F.get(removed, F.lit(0))),
        "swap_in": F.when(single, F.get(added, F.lit(0))),
    }).drop("_opp", "_ranked", "_place", "selections")


def threat_list(opponents, players):
    """struct(pokemon, threatens, threat_score) of resolved opponents that hit someone above 1x."""
    def one(o):
        hit = F.filter(players, lambda p: _best(o, p) > 1)
        quad = F.size(F.filter(players, lambda p: _best(o, p) >= 4))
        return F.struct(
            o["name"].alias("pokemon"), F.array_sort(F.transform(hit, lambda p: p["name"])).alias("threatens"),
            F.bround(F.size(hit) + 0.5 * quad, 2).alias("threat_score"))

    return F.filter(F.transform(opponents, one), lambda x: F.size(x["threatens"]) > 0)


def type_threats(df: DataFrame, keys, opponents, players, dex=None) -> DataFrame:
    """One row per threatening opponent species, with its place by score and name."""
    df = df.withColumns({
        "_o": resolve(F.array_distinct(opponents), dex), "_p": resolve(F.array_distinct(players), dex)})
    found = threat_list(F.col("_o"), F.col("_p"))
    order = F.sort_array(F.transform(found, lambda x: F.struct(
        (-x["threat_score"]).alias("neg"), x["pokemon"].alias("pokemon"), x["threatens"].alias("threatens"))))
    rows = df.select(*keys, F.posexplode(order).alias("_i", "_x"))
    return rows.select(*keys, "_x.pokemon", "_x.threatens", (-F.col("_x.neg")).alias("threat_score"),
                       (F.col("_i") + 1).alias("place"))


def narrow_species_by_types(df: DataFrame, types, badges, dex=None) -> DataFrame:
    """Add `candidates`: exact type set for at most one badge or two read types, superset otherwise."""
    entries = sorted((default_dex() if dex is None else dex).items())
    table = F.from_json(F.lit(json.dumps([{"species": k, "types": sorted(v)} for k, v in entries])),
                        "array<struct<species:string,types:array<string>>>")
    wanted = F.array_sort(F.array_distinct(types))
    exact = (F.col(badges) <= 1) | (F.size(types) >= 2)
    fits = F.filter(table, lambda x: F.when(F.size(wanted) == 0, F.lit(True)).when(
        exact, F.array_sort(x["types"]) == wanted).otherwise(F.size(F.array_except(wanted, x["types"])) == 0))
    return df.withColumn("candidates", F.transform(fits, lambda x: x["species"]))


def opponent_strength(matches: DataFrame, dex=None) -> DataFrame:
    """Preview evaluation of each decided match whose opponent selection is known."""
    rows = matches.where(F.col("winner").isin("player", "opponent") & (F.size("opponent_brought") > 0))
    return team_matchup(team_risk(rows, "opponent_brought", dex), "player_brought", "opponent_brought", dex)


def median_split(strength: DataFrame, by, min_resolved=2, min_matches=4) -> DataFrame:
    """Win rate against teams above the exact median risk, and at or below it."""
    scored = strength.where(F.size("resolved") >= min_resolved)
    # The exact median keeps one counter per distinct score, and scores are multiples of a half.
    middle = scored.groupBy(*by).agg(F.median("risk_score").alias("median_risk_score"), F.count(F.lit(1)).alias("sample_size"))
    rows = scored.join(middle.where(F.col("sample_size") >= min_matches), by)
    weak = F.col("risk_score") > F.col("median_risk_score")
    won = F.col("winner") == "player"
    rate = lambda side: F.when(F.count_if(side) > 0, F.bround(c.ratio_pct(F.count_if(side & won), F.count_if(side)), 1))
    return rows.groupBy(*by, "median_risk_score", "sample_size").agg(
        rate(weak).alias("win_rate_vs_weaker_built"), F.count_if(weak).alias("weaker_n"),
        rate(~weak).alias("win_rate_vs_tighter_built"), F.count_if(~weak).alias("tighter_n"))


SHORT = {"hp": "hp", "attack": "atk", "defense": "def", "special_attack": "spa", "special_defense": "spd", "speed": "spe"}


def nature_multiplier(nature, stat):
    raised = [n for n, (up, _) in fixed.NATURES.items() if up == stat]
    lowered = [n for n, (_, down) in fixed.NATURES.items() if down == stat]
    return F.when(nature.isin(raised), 1.1).when(nature.isin(lowered), 0.9).otherwise(1.0)


def calc_stats(df: DataFrame, prefix="", level="level", nature="nature") -> DataFrame:
    """Add stat_<name> from base_<name>, iv_<name> (31) and ev_<name> (0) columns."""
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
    level = F.col(level)
    out = {}
    for stat, short in SHORT.items():
        base = given(f"{prefix}base_{stat}", 0)
        grown = F.floor((2 * base + given(f"{prefix}iv_{stat}", 31) + F.floor(given(f"{prefix}ev_{stat}", 0) / 4)) * level / 100)
        if stat == "hp":
            value = F.when(base == 0, 0).otherwise(grown + level + 10)
        else:
            value = F.floor((grown + 5) * nature_multiplier(F.col(nature), short))
        out[f"{prefix}stat_{stat}"] = value.cast("int")
    return df.withColumns(out)


def _stage(stage):
    s = F.greatest(F.lit(-6), F.least(F.lit(6), F.coalesce(stage, F.lit(0))))
    return F.when(s >= 0, (2 + s) / 2).otherwise(2 / (2 - s))


def damage_matrix(scenarios: DataFrame, attacker="attacker", defender="defender", move="move", field="field") -> DataFrame:
    """Add `damage`: the sixteen rolls of each scenario row with their summary.

    Struct columns. attacker: level, atk, spa, atk_stage, spa_stage, types, ability, item, status,
    is_tera, tera_type. defender: hp, def, spd, def_stage, spd_stage, types, is_tera, tera_type.
    move: power, category, type, is_spread, is_crit. field: weather, targets_count.
    """
    a, d, m, f = (lambda n: F.col(f"{attacker}.{n}")), (lambda n: F.col(f"{defender}.{n}")), (
        lambda n: F.col(f"{move}.{n}")), (lambda n: F.col(f"{field}.{n}"))
    physical = m("category") == "physical"
    kind = F.lower(m("type"))
    tera = lambda side: F.coalesce(side("is_tera"), F.lit(False)) & (side("tera_type") != "")
    target_types = F.when(tera(d), F.array(d("tera_type"))).otherwise(F.coalesce(d("types"), F.array().cast(_EMPTY)))
    own_types = F.transform(F.coalesce(a("types"), F.array().cast(_EMPTY)), lambda t: F.lower(t))
    low_types = F.transform(target_types, lambda t: F.lower(t))

    def whole(x):
        return F.floor(x).cast("bigint")

    attack = whole(F.when(physical, a("atk") * _stage(a("atk_stage"))).otherwise(a("spa") * _stage(a("spa_stage"))))
    defend = whole(F.when(physical, d("def") * _stage(d("def_stage"))).otherwise(d("spd") * _stage(d("spd_stage"))))
    weather = f("weather")
    bulky = ((weather == "sand") & ~physical & F.array_contains(low_types, "rock")) | (
        (weather == "snow") & physical & F.array_contains(low_types, "ice"))
    defend = F.when(bulky, whole(defend * 1.5)).otherwise(defend)
    attack, defend = F.greatest(F.lit(1), attack), F.greatest(F.lit(1), defend)
    rows = scenarios.withColumns({"_atk": attack, "_def": defend, "_types": target_types, "_own": own_types})
    first = whole(2 * a("level") / 5) + 2
    base = whole(whole(first * m("power") * F.col("_atk") / F.col("_def")) / 50) + 2

    spread = F.when(m("is_spread") & (F.coalesce(f("targets_count"), F.lit(1)) > 1), 0.75).otherwise(1.0)
    good = ((weather == "sun") & (kind == "fire")) | ((weather == "rain") & (kind == "water"))
    bad = ((weather == "sun") & (kind == "water")) | ((weather == "rain") & (kind == "fire"))
    sky = F.when(good, 1.5).when(bad, 0.5).otherwise(1.0)
    crit = F.when(m("is_crit"), 1.5).otherwise(1.0)
    native = F.array_contains(F.col("_own"), kind)
    changed = F.lower(a("tera_type"))
    stab = (
        F.when(tera(a) & (changed == kind), F.when(F.array_contains(F.col("_own"), changed), 2.0).otherwise(1.5))
        .when(native, 1.5).otherwise(1.0))
    stab = F.when((a("ability") == "Adaptability") & (stab > 1.0), F.when(stab >= 2.0, 2.25).otherwise(2.0)).otherwise(stab)
    rows = rows.withColumns({"_base": base, "_stab": stab, "_mult": c.type_multiplier(kind, F.col("_types"))})
    burned = (a("status") == "brn") & physical & ~F.coalesce(a("ability") == "Guts", F.lit(False))
    item = a("item")
    held = (
        F.when(item == "Life Orb", 1.3)
        .when((item == "Choice Band") & physical, 1.5)
        .when((item == "Choice Specs") & ~physical, 1.5)
        .when((item == "Expert Belt") & (F.col("_mult") > 1.0), 1.2).otherwise(1.0))
    modifier = spread * sky * crit * F.col("_stab") * F.col("_mult") * F.when(burned, 0.5).otherwise(1.0) * held
    rows = rows.withColumn("_mod", modifier)
    # Sixteen spelled-out rolls stay inside generated code; a lambda would not.
    rolls = F.array(*[F.greatest(
        F.lit(1).cast("bigint"), whole(F.col("_base") * F.col("_mod") * (p / 100))) for p in range(85, 101)])
    none = F.array_repeat(F.lit(0).cast("bigint"), 16)
    rows = rows.withColumn("_rolls", F.when((F.coalesce(m("power"), F.lit(0)) <= 0) | (F.col("_mult") == 0), none).otherwise(rolls))
    least, most = F.array_min("_rolls"), F.array_max("_rolls")
    mean = F.bround(sum(F.get("_rolls", F.lit(i)) for i in range(16)) / 16, 2)
    share = lambda x: F.when((d("hp") > 0) & (m("power") > 0), F.bround(x / d("hp") * 100, 1)).otherwise(0.0)
    return rows.withColumn("damage", F.struct(
        F.col("_rolls").alias("rolls"), least.alias("min"), most.alias("max"), mean.alias("avg"),
        share(least).alias("min_pct"), share(most).alias("max_pct"))).drop(
        "_atk", "_def", "_types", "_own", "_base", "_stab", "_mult", "_mod", "_rolls")


def parse_spread(label):
    """struct(nature, hp, atk, def, spa, spd, spe) of "Jolly:2/32/0/0/0/32"."""
    points = F.split(F.substring_index(label, ":", -1), "/")
    return F.struct(F.trim(F.substring_index(label, ":", 1)).alias("nature"), *[
        F.get(points, F.lit(i)).try_cast("int").alias(n) for i, n in enumerate(SHORT.values())])


def match_rosters(slots: DataFrame) -> DataFrame:
    """Brought species of both sides as lists; a group is the two rosters of one preview."""
    named = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("pokemon"))))
    return slots.groupBy(*KEY).agg(named("player").alias("player_brought"), named("opponent").alias("opponent_brought"))
