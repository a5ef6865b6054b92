"""Match summaries, win-rate tables, records, reports and skill scores.

`by` names the reporting level: ["user_id", "job_id"] for one upload,
["user_id"] for a career. All aggregates combine on the map side.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringside.contracts import KEY
from ringside.functions import columns as c
from ringside.plans.scan import count_of, last_of, scan, sum_of

JOB = ["user_id", "job_id"]


def segment_by_marker(events: DataFrame, order="event_idx", keys=JOB) -> DataFrame:
    """Match numbers for uploads that carry none: a running count of team previews, at least 1."""
    counted = scan(events, keys, order, {"_n": count_of(F.col("event") == "team_preview")})
    return counted.withColumn("match", F.greatest(F.col("_n"), F.lit(1)).cast("int")).drop("_n")


def with_match_numbers(events: DataFrame, order="event_idx") -> DataFrame:
    """Keep rows with a match number; segment the uploads where no row has one."""
    tagged = events.groupBy(*JOB).agg(F.count("match").alias("_tagged"))
    marked = events.join(tagged, JOB)
    keyed = marked.where((F.col("_tagged") > 0) & F.col("match").isNotNull()).drop("_tagged")
    loose = segment_by_marker(marked.where("_tagged = 0").drop("_tagged", "match"), order)
    return keyed.unionByName(loose)


def _or_list(first, second):
    return F.when(F.size(first) > 0, first).otherwise(F.coalesce(second, F.array().cast("array<string>")))


def knockouts(events: DataFrame, order="event_idx") -> DataFrame:
    """One row per faint with the side that scored it and the running knockout difference."""
    faints = events.where((F.col("event") == "pokemon_fainted") & F.col("match").isNotNull())
    actor = F.lower(F.trim(F.col("actor")))
    faints = faints.select(
        *KEY, order, F.col("pokemon"),
        F.when(actor == "opponent", "player").otherwise("opponent").alias("scored_by"))
    step = F.when(F.col("scored_by") == "player", 1).otherwise(-1).cast("bigint")
    return scan(faints, KEY, order, {"ko_no": count_of(), "ko_diff": sum_of(step)})


def per_match(events: DataFrame, order="event_idx") -> DataFrame:
    """One row per match: result, rosters, faints, first knockout, whether the player was ever ahead."""
    rows = events.where(F.col("match").isNotNull())
    is_preview, is_end = F.col("event") == "team_preview", F.col("event") == "battle_end"
    is_faint = F.col("event") == "pokemon_fainted"
    actor = F.lower(F.trim(F.col("actor")))
    lists = ["player_lead", "opponent_lead", "player_brought", "opponent_brought", "player_team",
             "opponent_team", "player_active", "illegal_species_detected"]
    preview = F.struct(*lists)
    ending = F.struct("winner", "actor", "detail")
    tera = (F.col("event") == "terastallized") & (actor == "player") & (F.col("pokemon") != "")
    grouped = rows.groupBy(*KEY).agg(
        F.min_by(preview, F.when(is_preview, F.col("event_idx"))).alias("tp"),
        F.min_by(ending, F.when(is_end, F.col("event_idx"))).alias("be"),
        F.count_if(is_faint & (actor == "player")).alias("p_faints"),
        F.count_if(is_faint & (actor == "opponent")).alias("o_faints"),
        F.min_by(F.when(actor == "opponent", "player").otherwise("opponent"),
                 F.when(is_faint, F.struct(order))).alias("first_ko"),
        F.count_if(tera).alias("tera_n"),
        F.min("event_idx").alias("first_idx"),
    )
    ahead = knockouts(events, order).groupBy(*KEY).agg((F.max("ko_diff") > 0).alias("_ahead"))
    empty = F.array().cast("array<string>")
    listed = lambda name: F.coalesce(F.col(f"tp.{name}"), empty)
    joined = grouped.join(ahead, KEY, "left")
    winner = c.winner_by_field(F.col("be.winner"), F.col("be.actor"))
    brought = _or_list(listed("player_brought"), F.col("tp.player_active"))
    out = joined.select(
        *KEY,
        winner.alias("winner"),
        F.sort_array(listed("player_lead")).alias("player_lead"),
        F.sort_array(listed("opponent_lead")).alias("opponent_lead"),
        brought.alias("player_brought"),
        listed("player_brought").alias("player_brought_read"),
        _or_list(listed("opponent_brought"), F.col("tp.opponent_team")).alias("opponent_brought"),
        listed("player_team").alias("player_team"),
        listed("opponent_team").alias("opponent_team"),
        listed("illegal_species_detected").alias("illegal_species_detected"),
        F.col("be.detail").alias("winner_detail"),
        "p_faints", "o_faints", "first_ko", "tera_n", "first_idx",
        F.coalesce("_ahead", F.lit(False)).alias("was_ahead"),
    )

    def margin(names):
        size = F.when(F.size(names) > 0, F.size(names)).otherwise(4)
        left = F.greatest(F.lit(0), size - F.col("p_faints"))
        return F.when(F.col("winner") == "player", left).otherwise(F.lit(0)).cast("bigint")

    read = F.col("player_brought_read")
    return out.withColumns({
        "margin": margin(F.col("player_brought")),
        "margin_read": margin(read),
        "brought_n": F.when(F.size(read) > 0, F.size(read)).otherwise(4),
        "won": F.col("winner") == "player",
        "seen": F.struct("job_id", "first_idx"),
    })


def real_matches(matches: DataFrame) -> DataFrame:
    return matches.where((F.col("winner") != "unknown") | (F.size("player_brought") > 0))


def decided(matches: DataFrame) -> DataFrame:
    return matches.where(F.col("winner").isin("player", "opponent"))


def winrate_table(pairs: DataFrame, by, key="name") -> DataFrame:
    """Wins and games per key; `seen` orders ties by first appearance."""
    table = pairs.groupBy(*by, key).agg(
        F.count_if("won").alias("wins"), F.count(F.lit(1)).alias("total"), F.min("seen").alias("first_seen"))
    return table.withColumn("win_pct", F.bround(c.ratio_pct("wins", "total"), 1))


def _named(matches, by, names):
    return matches.select(*by, F.explode(F.array_distinct(names)).alias("name"), "won", "seen")


def _lead(matches, by, side):
    lead = F.array_join(f"{side}_lead", " + ")
    return matches.where(F.size(f"{side}_lead") > 0).select(*by, lead.alias("name"), "won", "seen")


def by_lead(matches: DataFrame, by, side="player") -> DataFrame:
    return winrate_table(_lead(decided(matches), by, side), by)


def by_bring(matches: DataFrame, by) -> DataFrame:
    return winrate_table(_named(decided(matches), by, F.col("player_brought")), by)


def matchups(matches: DataFrame, by) -> DataFrame:
    """Win rate against each species the opponent brought."""
    return winrate_table(_named(decided(matches), by, F.col("opponent_brought")), by)


def toughest_matchups(matches: DataFrame, by, min_sample=3, n=8) -> DataFrame:
    hard = matchups(matches, by).where(F.col("total") >= min_sample)
    return top_n(hard, by, [c.ratio_pct("wins", "total"), -F.col("total"), F.col("first_seen"), F.col("name")], n)


def top_n(rows: DataFrame, by, order, n) -> DataFrame:
    """First n rows per group; Spark limits each map task to n rows per group before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def record(matches: DataFrame, by) -> DataFrame:
    rows = real_matches(matches)
    total = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_games"),
        F.count_if(F.col("winner") == "player").alias("wins"),
        F.count_if(F.col("winner") == "opponent").alias("losses"),
    )
    games = F.col("wins") + F.col("losses")
    return total.select(
        *by, games.alias("matches"), "total_games", (F.col("total_games") - games).alias("undetermined"),
        "wins", "losses", F.bround(c.ratio_pct(F.col("wins"), games), 1).alias("win_rate"))


def record_rollup(matches: DataFrame, user="user_id", session="session") -> DataFrame:
    """Record per session and over all sessions in one pass; all-time rows have a NULL session."""
    rows = real_matches(matches)
    return (
        rows.rollup(user, session)
        .agg(F.grouping_id().alias("_level"),
             F.count_if(F.col("winner") == "player").alias("wins"),
             F.count_if(F.col("winner") == "opponent").alias("losses"),
             F.count(F.lit(1)).alias("total_games"))
        .where("_level < 3").drop("_level")
    )


def combat_summary(matches: DataFrame, by) -> DataFrame:
    games = decided(matches)
    won, first = F.col("won"), F.col("first_ko") == "player"
    return games.groupBy(*by).agg(
        F.sum("o_faints").alias("kos_in_decided"),
        F.sum("p_faints").alias("lost_in_decided"),
        F.bround(F.avg(F.col("o_faints") - F.col("p_faints")), 2).alias("ko_differential_avg"),
        F.bround(F.coalesce(F.avg(F.when(won, F.col("margin"))), F.lit(0.0)), 1).alias("avg_winning_margin"),
        F.bround(c.ratio_pct(F.count_if(first & won), F.count_if(first)), 1).alias("first_ko_win_rate"),
    )


def knockout_totals(events: DataFrame, by) -> DataFrame:
    actor = F.lower(F.trim(F.col("actor")))
    faints = events.where(F.col("event") == "pokemon_fainted")
    return faints.groupBy(*by).agg(
        F.count_if(actor == "opponent").alias("kos_landed"), F.count_if(actor == "player").alias("pokemon_lost"))


def tera_split(matches: DataFrame, by, tera_legal=True) -> DataFrame:
    """Win rate with and without a Terastallization; no rows where the format has none."""
    games = decided(matches) if tera_legal else decided(matches).where(F.lit(False))
    used, won = F.col("tera_n") > 0, F.col("won")
    return games.groupBy(*by).agg(
        F.count_if(used).alias("matches_with"),
        F.count_if(~used).alias("matches_without"),
        F.bround(c.ratio_pct(F.count_if(used & won), F.count_if(used)), 1).alias("win_rate_with"),
        F.bround(c.ratio_pct(F.count_if(~used & won), F.count_if(~used)), 1).alias("win_rate_without"),
    )


def lead_predictability(matches: DataFrame, by) -> DataFrame:
    """Share of the most common lead of both sides, and the result against the opponent's."""
    out = decided(matches).select(*by).distinct()
    for side, prefix in (("player", ""), ("opponent", "opponent_")):
        table = by_lead(matches, by, side)
        first = F.struct((-F.col("total")).alias("n"), F.col("first_seen"), F.col("name"))
        top = table.groupBy(*by).agg(
            F.min_by(F.struct("name", "wins", "total"), first).alias("_top"), F.sum("total").alias("_all"))
        top = top.select(
            *by,
            F.col("_top.name").alias(f"{prefix}most_common"),
            F.bround(c.ratio_pct(F.col("_top.total"), F.col("_all")), 1).alias(f"{prefix}predictability_pct"),
            *([F.bround(c.ratio_pct(F.col("_top.wins"), F.col("_top.total")), 1).alias(
                "win_rate_vs_opponent_most_common"),
               F.col("_top.total").alias("vs_opponent_most_common_n")] if prefix else []),
        )
        out = out.join(top, by, "left")
    return out.fillna("(n/a)", ["most_common", "opponent_most_common"]).fillna(0)


def throws(matches: DataFrame, by) -> DataFrame:
    """Lost matches in which the player once led in knockouts."""
    lost = matches.where(F.col("winner") == "opponent")
    return lost.groupBy(*by).agg(
        F.count_if("was_ahead").alias("throws"), F.count(F.lit(1)).alias("losses"))


def _whole(value):
    return F.rint(value).cast("bigint").cast("string")


def coaching_flags(matches: DataFrame, by, min_sample=3, tera_legal=True, per_kind=None) -> DataFrame:
    """Rows (kind, subject, flag); `per_kind` keeps the first few per kind as the text report does."""
    totals = decided(matches).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    lead = by_lead(matches, by)
    first = F.struct((-F.col("total")).alias("n"), F.col("first_seen"), F.col("name"))
    top = lead.groupBy(*by).agg(F.min_by(F.struct("name", "total"), first).alias("_t"), F.sum("total").alias("_all"))
    share = c.ratio_pct(F.col("_t.total"), F.col("_all"))
    predictable = totals.join(top, by).where((F.col("n") >= min_sample) & (share >= 50)).select(
        *by, F.lit("predictable_lead").alias("kind"), F.col("_t.name").alias("subject"),
        F.concat(F.lit("Predictable leads - "), _whole(share), F.lit("% of games open with "),
                 F.col("_t.name"), F.lit(".")).alias("flag"))

    used, won = F.col("tera_n") > 0, F.col("won")
    tera = (decided(matches) if tera_legal else decided(matches).where(F.lit(False))).groupBy(*by).agg(
        F.count_if(used).alias("a"), F.count_if(~used).alias("b"),
        c.ratio_pct(F.count_if(used & won), F.count_if(used)).alias("x"),
        c.ratio_pct(F.count_if(~used & won), F.count_if(~used)).alias("y"))
    tera = tera.where((F.col("a") >= min_sample) & (F.col("b") >= min_sample) & (F.col("x") < F.col("y") - 10))
    tera = tera.select(
        *by, F.lit("tera_not_helping").alias("kind"), F.lit("").alias("subject"),
        F.concat(F.lit("Tera not helping - "), _whole(F.col("x")), F.lit("% win with Tera vs "),
                 _whole(F.col("y")), F.lit("% without.")).alias("flag"))

    bring = by_bring(matches, by).join(totals, by)
    rate = c.ratio_pct("wins", "total")
    total = F.col("total")
    order = [-total, F.col("first_seen"), F.col("name")]
    keep = (lambda rows: rows) if per_kind is None else (lambda rows: top_n(rows, by, order, per_kind))
    low = keep(bring.where((total >= min_sample) & (rate < 40))).select(
        *by, F.lit("low_value_bring").alias("kind"), F.col("name").alias("subject"),
        F.concat(F.lit("Low-value bring: "), F.col("name"), F.lit(" - "), _whole(rate), F.lit("% win across "),
                 total, F.lit(" brings.")).alias("flag"))
    rare = (total >= 2) & (total < F.greatest(F.lit(2.0), F.col("n") * 0.3)) & (rate >= 65)
    under = keep(bring.where(rare)).select(
        *by, F.lit("underused_asset").alias("kind"), F.col("name").alias("subject"),
        F.concat(F.lit("Underused asset: "), F.col("name"), F.lit(" - "), _whole(rate),
                 F.lit("% win but only brought "), total, F.lit("x.")).alias("flag"))
    thrown = throws(matches, by).where("throws > 0").select(
        *by, F.lit("throws").alias("kind"), F.lit("").alias("subject"),
        F.concat(F.col("throws"), F.lit(" likely thrown game(s) - lost after being ahead in KOs.")).alias("flag"))
    flags = reduce(DataFrame.unionByName, [predictable, tera, low, under, thrown])
    quiet = real_matches(matches).select(*by).distinct().join(flags.select(*by).distinct(), by, "left_anti")
    quiet = quiet.select(
        *by, F.lit("none").alias("kind"), F.lit("").alias("subject"),
        F.lit("No strong patterns yet - need more matches for confident coaching signals.").alias("flag"))
    return flags.unionByName(quiet)


def usage_counts(events: DataFrame, by) -> DataFrame:
    """Rows (kind, name, n): moves, users of moves, species on the field, brought, leads, Teras."""
    actor = F.lower(F.trim(F.col("actor")))
    mine = actor == "player"
    moved = (F.col("event") == "move_used") & mine
    preview = F.col("event") == "team_preview"

    def words(kind, condition, value):
        return F.when(condition, F.transform(value, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name"))))

    one = lambda column: F.filter(F.array(F.trim(F.col(column))), lambda x: x != "")
    nothing = F.array().cast("array<struct<kind:string,name:string>>")
    tagged = F.concat(*[F.coalesce(x, nothing) for x in [
        words("move", moved, one("detail")),
        words("move_user", moved, one("pokemon")),
        words("on_field", F.col("event") == "field_state", F.col("player_active")),
        words("brought", preview, F.col("player_brought")),
        words("lead", preview, F.col("player_lead")),
        words("tera", (F.col("event") == "terastallized") & mine, one("pokemon")),
    ]])
    rows = events.select(*by, "event_idx", F.explode(tagged).alias("_x"))
    return rows.groupBy(*by, F.col("_x.kind").alias("kind"), F.col("_x.name").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("event_idx")).alias("first_seen"))


def entropy(options: DataFrame, by, name, out) -> DataFrame:
    """Normalised Shannon entropy 0..100 of the options in each group."""
    counts = options.groupBy(*by, name).agg(F.count(F.lit(1)).alias("_c"))
    log = F.col("_c") * F.ln("_c")
    sums = counts.groupBy(*by).agg(
        F.sum("_c").alias("_n"), F.sum(log).alias("_s"), F.count(F.lit(1)).alias("_k"))
    return sums.select(*by, entropy_of(F.col("_n"), F.col("_s"), F.col("_k")).alias(out))


def entropy_of(n, log_sum, k):
    """Entropy from the total, the sum of c*ln(c) and the number of options."""
    spread = (F.ln(n) - F.try_divide(log_sum, n)) / F.ln(k)
    return F.when((n <= 1) | (k <= 1), 0.0).otherwise(c.clamp(spread * 100, 0.0, 100.0))


def skill_sums():
    """Additive parts of the skill scores."""
    return {
        "n": F.count(F.lit(1)),
        "ko_diff": F.sum(F.col("o_faints") - F.col("p_faints")),
        "first_kos": F.count_if(F.col("first_ko") == "player"),
        "o_total": F.sum("o_faints"),
        "p_total": F.sum("p_faints"),
        "losses": F.count_if(F.col("winner") == "opponent"),
        "throws": F.count_if((F.col("winner") == "opponent") & F.col("was_ahead")),
        "ahead": F.count_if("was_ahead"),
        "converted": F.count_if(F.col("was_ahead") & F.col("won")),
        "wins": F.count_if("won"),
        "margin_sum": F.sum(F.when(F.col("won"), F.col("margin_read") / F.col("brought_n")).otherwise(0.0)),
    }


def lead_choice():
    return F.when(F.size("player_lead") > 0, F.array_join("player_lead", " + "))


def bring_choice():
    names = F.array_sort(F.array_distinct("player_brought_read"))
    return F.when(F.size(names) > 0, F.array_join(names, "|"))


def score_columns():
    """The four scores and their mean from skill_sums and two entropies."""
    n = F.col("n")
    over = lambda a, b, default: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(default))
    tempo = c.clamp(0.5 * c.scale(F.col("ko_diff") / n, -2, 2) + 0.5 * (F.col("first_kos") / n) * 100)
    adaptability = c.clamp(0.5 * F.coalesce("lead_entropy", F.lit(0.0)) + 0.5 * F.coalesce("bring_entropy", F.lit(0.0)))
    share = F.coalesce(F.try_divide(F.col("o_total").cast("double"), F.col("o_total") + F.col("p_total")), F.lit(0.5))
    execution = c.clamp(0.7 * share * 100 + 0.3 * (1 - over("throws", "losses", 0.0)) * 100)
    closing = c.clamp(0.6 * over("converted", "ahead", 0.0) * 100 + 0.4 * over("margin_sum", "wins", 0.0) * 100)
    overall = (tempo + adaptability + execution + closing) / 4
    scores = {"tempo": tempo, "adaptability": adaptability, "execution": execution, "closing": closing,
              "overall": overall}
    tier = c.confidence_tier(n)
    return [n.alias("matches_analyzed"), tier["tier"].alias("tier"),
            tier["matches_to_next_tier"].alias("matches_to_next_tier"),
            *[F.bround(v, 1).alias(k) for k, v in scores.items()]]


def skill_scores(matches: DataFrame, by) -> DataFrame:
    """Tempo, adaptability, execution and closing per group; groups without decided matches give no row."""
    games = decided(matches)
    sums = games.groupBy(*by).agg(*[v.alias(k) for k, v in skill_sums().items()])
    for choice, out in ((lead_choice(), "lead_entropy"), (bring_choice(), "bring_entropy")):
        options = games.select(*by, choice.alias("_o")).where(F.col("_o").isNotNull())
        sums = sums.join(entropy(options, by, "_o", out), by, "left")
    return sums.select(*by, *score_columns())


def match_list(matches: DataFrame) -> DataFrame:
    """Display row per match with the completeness flags."""
    known = F.size("player_brought") >= 4
    return matches.select(
        *KEY, "winner", "player_lead", "player_brought", "opponent_brought", "player_team", "opponent_team",
        "p_faints", "o_faints", "illegal_species_detected",
        known.alias("player_team_known"), (F.size("opponent_brought") >= 4).alias("opponent_team_known"),
        (known & (F.size("illegal_species_detected") == 0)).alias("complete_data"))


def completeness_counts(matches: DataFrame, by) -> DataFrame:
    rows = match_list(matches)
    unsure = ~F.col("complete_data") | (F.col("winner") == "unknown")
    return rows.groupBy(*by).agg(
        F.count_if(unsure).alias("incomplete"),
        F.count_if(F.size("illegal_species_detected") > 0).alias("with_illegal_species"))


def system_read(matches: DataFrame) -> DataFrame:
    return matches.select(
        *KEY, "player_team", "opponent_team", F.col("player_brought_read").alias("player_brought"),
        "opponent_brought", "illegal_species_detected", "winner", "winner_detail")


def own_meta(matches: DataFrame, by) -> DataFrame:
    """Usage, leads and threats over all matches; undecided ones count as not won."""
    lead = matches.where(F.size("player_lead") > 0).select(
        *by, F.lit("leads").alias("part"), F.array_join("player_lead", " + ").alias("name"), "won", "seen")
    used = _named(matches, by, F.col("player_brought_read")).withColumn("part", F.lit("pokemon_usage"))
    faced = _named(matches, by, F.col("opponent_brought")).withColumn("part", F.lit("opponent_threats"))
    return winrate_table(lead.unionByName(used).unionByName(faced), [*by, "part"])


def worst_matchups(matches: DataFrame, by, n=6) -> DataFrame:
    threats = own_meta(matches, by).where(F.col("part") == "opponent_threats")
    return top_n(threats, by, [F.col("win_pct"), -F.col("total"), F.col("first_seen"), F.col("name")], n)


def profile_summary(matches: DataFrame, by, leads=6, brings=10) -> DataFrame:
    """The four text lines of a player profile."""
    games = decided(matches)
    used, won = F.col("tera_n") > 0, F.col("won")
    base = matches.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    sums = games.groupBy(*by).agg(
        F.count_if(won).alias("w"), F.count(F.lit(1)).alias("n"),
        F.count_if(used & won).alias("tw"), F.count_if(used).alias("tn"),
        F.count_if(~used & won).alias("nw"), F.count_if(~used).alias("nn"))
    meta = own_meta(matches, by)
    order = [-F.col("total"), F.col("first_seen"), F.col("name")]
    out = base.join(sums, by, "left").fillna(0)
    for part, limit, column in (("leads", leads, "_leads"), ("pokemon_usage", brings, "_brings")):
        best = top_n(meta.where(F.col("part") == part), by, order, limit)
        line = F.concat(F.col("name"), F.lit(" "), F.col("wins"), F.lit("/"), F.col("total"))
        # At most `limit` rows per group reach this list.
        lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"])
        out = out.join(best.groupBy(*by).agg(F.array_join(lines, "; ").alias(column)), by, "left")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    col = lambda name: F.col(name).cast("string")
    return out.select(*by, F.concat_ws(
        "\n",
        text("RECORD: ", col("w"), "-", (F.col("n") - F.col("w")).cast("string"), " (",
             _whole(c.ratio_pct("w", "n")), "%) over ", col("n"), " matches."),
        text("LEADS (win rate): ", F.coalesce("_leads", F.lit(""))),
        text("BRINGS (wins/brought): ", F.coalesce("_brings", F.lit(""))),
        text("TERA: with ", col("tw"), "/", col("tn"), ", without ", col("nw"), "/", col("nn"), "."),
    ).alias("profile"))


def collapse_bursts(marks: DataFrame, keys, order, time="timestamp", gap=90.0, floor=None) -> DataFrame:
    """Chains of marks closer than `gap` become one mark: the last of the chain."""
    limit = gap if floor is None else max(gap, floor)
    back = scan(marks, keys, order, {"_before": last_of(F.struct(F.col(time).alias("t")), inclusive=False)})
    fresh = F.col("_before").isNull() | (F.col(time) - F.col("_before.t") >= limit)
    chained = scan(back, keys, order, {"_chain": count_of(fresh)})
    row = F.struct(*marks.columns)
    last = chained.groupBy(*keys, "_chain").agg(F.max_by(row, F.col(order)).alias("_r"))
    return last.select("_r.*")


def matches_from_previews(events: DataFrame, keys=JOB, order="event_idx", gap=90.0) -> DataFrame:
    """Each (collapsed) preview owns the time up to the next; the last end screen inside decides it."""
    timed = events.withColumn("timestamp", F.coalesce("timestamp", F.lit(0.0)))
    slim = timed.select(*keys, order, "timestamp", "event", "winner", "detail", "actor")
    ends = slim.where(F.col("event") == "battle_end")
    previews = collapse_bursts(slim.where(F.col("event") == "team_preview"), keys, order, gap=gap)
    marks = previews.unionByName(ends)
    owned = scan(marks, keys, order, {
        "_no": count_of(F.col("event") == "team_preview"),
        "_start": last_of(F.when(F.col("event") == "team_preview", F.col("timestamp")))})
    verdict = c.winner_by_text("winner", "detail", "actor")
    is_end = F.when(F.col("event") == "battle_end", F.col(order))
    found = owned.where("_no > 0").groupBy(*keys, "_no").agg(
        F.max_by(F.struct("timestamp", verdict.alias("winner"), "detail"), is_end).alias("_e"),
        F.max("_start").alias("_start"))
    found = found.select(
        *keys,
        F.coalesce("_e.timestamp", F.bround("_start", 1)).alias("timestamp"),
        F.coalesce("_e.winner", F.lit("unknown")).alias("winner"),
        F.when(F.col("_e").isNull(), "(no end-of-match screen captured)")
        .otherwise(F.coalesce("_e.detail", F.lit(""))).alias("detail"))
    bare = ends.join(previews.select(*keys).distinct(), keys, "left_anti")
    loose = collapse_bursts(bare, keys, order, gap=gap, floor=150.0).select(
        *keys, "timestamp", verdict.alias("winner"), F.coalesce("detail", F.lit("")).alias("detail"))
    return found.unionByName(loose)


def failure_runs(matches: DataFrame, keys, order, failed, limit=3) -> DataFrame:
    """Longest run of failed matches per group, and whether the breaker would stop it."""
    counted = scan(matches, keys, order, {"_good": count_of(~failed)})
    runs = counted.where(failed).groupBy(*keys, "_good").agg(F.count(F.lit(1)).alias("_run"))
    worst = runs.groupBy(*keys).agg(F.max("_run").alias("longest_run"))
    return worst.withColumn("stops", F.col("longest_run") >= limit)


