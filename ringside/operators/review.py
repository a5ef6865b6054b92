"""What happened on the board at each event, and which readings need a human look."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.contracts import KEY, SIDES
from ringside.functions import columns as c
from ringside.functions import fixed_values as fixed
from ringside.operators.turns import pairs_of
from ringside.plans.folds import fold
from ringside.plans.scan import count_of, last_of, null_safe, scan, sum_of

_NAMES = "array<string>"


def needs_clarification():
    """Not corrected, and read with low confidence or in conflict with the roster."""
    open_ = ~F.coalesce("corrected", F.lit(False))
    low = F.coalesce(F.col("confidence") < fixed.LOW_CONFIDENCE, F.lit(False))
    return open_ & (low | F.coalesce("roster_conflict", F.lit(False)))


def _is_identity():
    return (F.col("event") != "team_preview") & F.coalesce(F.col("pokemon") != "", F.lit(False)) & F.coalesce(
        F.col("actor") != "", F.lit(False))


def _side():
    return F.when(F.col("actor") == "opponent", "opponent").otherwise("player")


def _photo():
    return F.when(F.col("reference_frame") != "", F.struct(
        F.col("reference_frame").alias("frame"), F.col("event_idx").alias("idx"),
        F.col("reference_frame_shows_subject").alias("shows")))


def clarification_events(events: DataFrame) -> DataFrame:
    """The single doubtful sightings behind each identity question."""
    return events.where(_is_identity() & needs_clarification()).select(
        *KEY, _side().alias("side"), F.col("pokemon").alias("guess"), "event_idx", "confidence")


def clarification_queue(events: DataFrame) -> DataFrame:
    """One identity question per side and guessed species that has any photo to show."""
    on = [*KEY, "side", "guess"]
    sightings = events.where(_is_identity()).withColumns({"side": _side(), "guess": F.col("pokemon")})
    doubt = sightings.where(needs_clarification())
    order = F.when(_photo().isNotNull(), F.col("event_idx"))
    groups = doubt.groupBy(*on).agg(
        F.count(F.lit(1)).alias("count"), F.min("confidence").alias("min_confidence"), F.min_by(_photo(), order).alias("_own"))
    borrowed = sightings.groupBy(*on).agg(F.min_by(_photo(), order).alias("_borrowed"))
    conflicts = doubt.select(*on, "event_idx", F.posexplode("roster_conflict_species").alias("_p", "name"))
    conflicts = conflicts.groupBy(*on, "name").agg(F.min(F.struct("event_idx", "_p")).alias("at"))
    # Conflicting names are legal species, each once.
    conflicts = conflicts.groupBy(*on).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("_conflicts"))
    preview = events.where(F.col("event") == "team_preview").groupBy(*KEY).agg(F.min_by(F.struct(
        "player_brought", "opponent_brought", F.when(F.col("reference_frame") != "", F.col("reference_frame")).alias("frame")),
        "event_idx").alias("_tp"))
    rows = groups.join(borrowed, on, "left").join(conflicts, on, "left").join(preview, KEY, "left")
    seen = F.coalesce("_own", "_borrowed")
    brought = F.when(F.col("side") == "player", F.col("_tp.player_brought")).otherwise(F.col("_tp.opponent_brought"))
    none = F.array().cast(_NAMES)
    names = F.concat(F.array("guess"), F.coalesce("_conflicts", none), F.coalesce(brought, none))
    rows = rows.withColumns({
        "reference_frame": F.coalesce(seen["frame"], F.col("_tp.frame")),
        "reference_frame_idx": seen["idx"], "shows_subject": seen["shows"],
        "is_preview_fallback": seen.isNull() & F.col("_tp.frame").isNotNull(),
        "candidates": F.filter(F.array_distinct(names), lambda x: x != ""),
    })
    return rows.where(F.col("reference_frame").isNotNull()).select(
        *on, "count", "min_confidence", "candidates", "reference_frame", "reference_frame_idx", "shows_subject", "is_preview_fallback")


def winner_clarifications(events: DataFrame) -> DataFrame:
    """Matches with an end screen but no winner, with the latest photographed event."""
    ended = F.col("event") == "battle_end"
    shown = F.when((F.col("event") != "team_preview") & (F.col("reference_frame") != ""), F.struct(
        F.coalesce("timestamp", F.lit(0.0)), "event_idx"))
    rows = events.groupBy(*KEY).agg(
        F.count_if(ended).alias("ends"), F.count_if(ended & F.col("winner").isin(*SIDES)).alias("_known"),
        F.max_by(F.struct("reference_frame", "timestamp", F.col("reference_frame_shows_subject").alias("shows_subject")), shown).alias("_p"))
    rows = rows.where((F.col("ends") > 0) & (F.col("_known") == 0) & F.col("_p").isNotNull())
    return rows.select(*KEY, "ends", "_p.*")


def generic_clarifications(events: DataFrame) -> DataFrame:
    """Doubtful events that are not about identity and have a photo."""
    rows = events.where(~F.col("event").isin("team_preview", "battle_end") & needs_clarification() & ~_is_identity())
    return rows.where(F.col("reference_frame") != "").select(
        *KEY, "event_idx", "event", "actor", "timestamp", F.coalesce("detail", F.lit("")).alias("detail"), "confidence", "reference_frame",
        "reference_frame_shows_subject")


def _board_changes(events, order):
    """Per side: rows that replace the board (`shown`) or bring one species onto it (`came`)."""
    kind, empty = F.col("event"), F.array().cast(_NAMES)
    preview, state = kind == "team_preview", kind == "field_state"
    parts = []
    for s in SIDES:
        listed = F.when(preview, F.coalesce(f"{s}_lead", empty)).when(
            state & (F.size(F.coalesce(f"{s}_active", empty)) > 0), F.col(f"{s}_active"))
        came = F.when(~preview & ~state & (F.col("actor") == s) & (F.col("pokemon") != ""), F.col("pokemon"))
        parts.append(F.struct(F.lit(s).alias("side"), listed.alias("shown"), came.alias("came")))
    rows = events.select(*KEY, order, F.inline(F.array(*parts)))
    return rows.where(F.col("shown").isNotNull() | F.col("came").isNotNull())


def _boards_of(rows, keys):
    """All boards that a stretch can show: up to two of its species, or the list that opens it."""
    listed = rows.where("reset").select(*keys, F.col("mons").alias("state"))
    pairs = pairs_of(rows, keys, F.explode("mons"))
    few = pairs.select(*[F.col(k).alias(f"_l{j}") for j, k in enumerate(keys)]).distinct()
    listed = listed.join(few, null_safe(listed, few, [(k, f"_l{j}") for j, k in enumerate(keys)]), "left_semi")
    return pairs.unionByName(listed)


def boards_by_event(events: DataFrame, order="event_idx", width=None) -> DataFrame:
    """Species on the field after every event, per side."""
    keys = [*KEY, "side"]
    changes = _board_changes(events, order)
    changes = scan(changes, keys, order, {"stretch": count_of(F.col("shown").isNotNull())})
    out_at = events.where((F.col("event") == "pokemon_fainted") & F.col("actor").isin(*SIDES)).groupBy(
        *KEY, F.col("actor").alias("side"), F.col("pokemon").alias("name")).agg(F.min(order).cast("bigint").alias("out"))
    named = changes.select(*keys, "stretch", order, F.col("shown").isNotNull().alias("reset"), F.posexplode_outer(
        F.coalesce("shown", F.array("came"))).alias("at", "name")).join(out_at, [*keys, "name"], "left")
    item = F.when(F.col("name").isNotNull(), F.struct("at", "name", "out"))
    # One event and side per group: its reported list, or one arrival.
    rows = named.groupBy(*keys, "stretch", order, "reset").agg(F.transform(
        F.sort_array(F.collect_list(item)), lambda x: F.struct(x["name"].alias("name"), x["out"].alias("out"))).alias("mons"))

    def step(state, row):
        def drop(acc):
            gone = F.array_position(F.transform(acc, lambda y: F.coalesce(y["out"] <= row[order], F.lit(False))), True)
            at = F.greatest(gone, F.lit(1)).cast("int")
            return F.concat(F.slice(acc, F.lit(1), at - 1), F.slice(acc, at + 1, F.size(acc)))

        def arrive(acc, x):
            grown = F.concat(acc, F.array(x))
            surplus = F.when(F.size(grown) > 2, F.sequence(F.lit(3), F.size(grown))).otherwise(F.array().cast("array<int>"))
            capped = F.aggregate(surplus, grown, lambda names, _: drop(names))
            return F.when(F.exists(acc, lambda y: y["name"] == x["name"]), acc).otherwise(capped)

        now = F.when(row["reset"], row["mons"]).otherwise(F.aggregate(row["mons"], state, arrive))
        return F.struct(now.alias("state"), F.transform(now, lambda y: y["name"]).alias("out"))

    folded = fold(rows, [*keys, "stretch"], order, ["reset", "mons"], F.array(), step,
                  "array<struct<name:string,out:bigint>>", _NAMES, width, lambda long: _boards_of(long, [*keys, "stretch"]))
    out = events.select(*KEY, order)
    for s in SIDES:
        mine = folded.where(F.col("side") == s).select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate([*KEY, order])], F.struct(F.col("out")).alias(f"_{s}"))
        out = out.join(mine, null_safe(out, mine, [(k, f"_k{i}") for i, k in enumerate([*KEY, order])]), "left").drop(
            *[f"_k{i}" for i in range(len(KEY) + 1)])
    filled = scan(out, KEY, order, {f"{s}_board": last_of(F.col(f"_{s}")) for s in SIDES})
    none = F.array().cast(_NAMES)
    return filled.select(*KEY, order, *[F.coalesce(F.col(f"{s}_board.out"), none).alias(f"{s}_board") for s in SIDES])


def timeline(events: DataFrame, order="event_idx", width=None) -> DataFrame:
    """One row per event: caption, turn and both boards after it."""
    rows = events.where(F.col("match").isNotNull())
    boards = boards_by_event(rows, order, width)
    turns = scan(rows, KEY, order, {"turn_now": last_of(F.when(F.col("event") == "field_state", F.col("turn")))})
    both = turns.join(boards, [*KEY, order])
    return both.withColumn("caption", c.caption("event", "player_board", "opponent_board"))


def timeline_species(events: DataFrame, line: DataFrame, order="event_idx") -> DataFrame:
    """State of every species on the field after every event: hp, status, Tera, fainted."""
    keys = [*KEY, "side", "species"]
    at = F.col(order).cast("bigint")
    hit = events.where(F.col("actor").isin(*SIDES) & (F.col("pokemon") != ""))
    kind = F.col("event")
    hp = F.when(kind == "pokemon_fainted", 0.0).when(kind == "hp_change", F.col("hp_percent"))
    marks = hit.select(
        *KEY, F.col("actor").alias("side"), F.col("pokemon").alias("species"), (at * 2).alias("_at"), hp.alias("_hp"),
        F.when((kind == "status_inflicted") & (F.col("detail") != ""), F.col("detail")).alias("_status"),
        (kind == "terastallized").cast("int").alias("_tera"), (kind == "pokemon_fainted").cast("int").alias("_out"))
    shown = line.select(*KEY, order, F.inline(F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(f"{s}_board").alias("board")) for s in SIDES])))
    asked = shown.select(*KEY, order, "side", F.posexplode("board").alias("place", "species")).withColumn("_at", at * 2 + 1)
    axis = asked.unionByName(marks, allowMissingColumns=True)
    filled = scan(axis, keys, "_at", {
        "hp": last_of(F.col("_hp")), "status": last_of(F.col("_status")), "_t": sum_of(F.col("_tera")), "_o": sum_of(F.col("_out"))})
    return filled.where(F.col("place").isNotNull()).select(
        *KEY, order, "side", "place", "species", F.coalesce("hp", F.lit(100.0)).alias("hp"), "status",
        (F.col("_t") > 0).alias("tera"), (F.col("_o") > 0).alias("fainted"))


def frame_context(queue: DataFrame, line: DataFrame, species: DataFrame, order="event_idx") -> DataFrame:
    """For each question: state of the guess and of its partners at the last event that shares the photo."""
    asked = queue.where(F.col("reference_frame_idx").isNotNull())
    last = line.where(F.col("reference_frame") != "").groupBy(*KEY, "reference_frame").agg(F.max(order).alias(order))
    rows = asked.join(last, [*KEY, "reference_frame"]).join(species, [*KEY, order, "side"], "left")
    own = F.col("species") == F.col("guess")
    partner = F.when(~own & (F.col("species") != ""), F.struct("place", F.concat(
        "species", F.lit(" "), F.col("hp").cast("string"))))
    # One board of one side per group.
    return rows.groupBy(*KEY, "side", "guess").agg(
        F.max(F.when(own, F.col("hp"))).alias("own_hp"), F.max(F.when(own, F.col("status"))).alias("own_status"),
        F.transform(F.sort_array(F.collect_list(partner)), lambda x: x["col2"]).alias("others"))


def match_recap(line: DataFrame, reports: DataFrame, recap_events) -> DataFrame:
    """Timeline rows of the recap kinds with the strategic report of their turn."""
    rows = line.where(F.col("event").isin(list(recap_events)))
    told = reports.select(*KEY, F.col("turn").alias("turn_now"), "score", "position", "band", "win_probability")
    return rows.join(told, [*KEY, "turn_now"], "left")


def open_questions(events: DataFrame) -> DataFrame:
    """Number of open questions per match."""
    parts = [rows.select(*KEY) for rows in (clarification_queue(events), winner_clarifications(events), generic_clarifications(events))]
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return everything.groupBy(*KEY).agg(F.count(F.lit(1)).alias("questions"))

