"""What each side had available at the start of every turn.

All tables are long or one row per (match, turn, side); a list column never
holds more than a roster, a board or the names of one turn. `order` is the
arrival order (`event_idx`) or, for rows not written in time order, the
`time_idx` of `plans.ordering.in_time_order`.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.contracts import KEY, SIDES
from ringside.functions import columns as c
from ringside.plans.folds import fold
from ringside.plans.ordering import materialise
from ringside.plans.scan import count_of, last_of, null_safe, scan

SLIM = [
    "event_idx", "event", "actor", "pokemon", "move", "detail", "hp_percent", "turn", "tailwind", "trick_room",
    "weather", "terrain", "screens", "player_active", "opponent_active", "player_team", "opponent_team",
    "player_brought", "opponent_brought",
]
#: Species of one side and stretch up to which boards are listed: a roster has 6, misreadings add some.
TABLED_SPECIES = 20
CONDITIONS = ["tailwind", "trick_room", "weather", "terrain", "screens"]


def forward_fill_turn(events: DataFrame, order="event_idx", name="turn_now") -> DataFrame:
    """Turn of the latest readable field state at each event."""
    read = F.when(F.col("event") == "field_state", F.col("turn"))
    return scan(events, KEY, order, {name: last_of(read)})


@dataclass(frozen=True)
class Turns:
    """Turn-tagged events (written once) and the turns they contain."""

    events: DataFrame
    grid: DataFrame
    order: str


def turns_of(events: DataFrame, order="event_idx") -> Turns:
    slim = events.where(F.col("match").isNotNull())
    slim = slim.select(*KEY, *[x for x in dict.fromkeys([order, *SLIM]) if x in events.columns])
    for missing in ("move",):
        if missing not in slim.columns:
            slim = slim.withColumn(missing, F.lit(None).cast("string"))
    tagged = materialise(forward_fill_turn(slim, order))
    state = tagged.where((F.col("event") == "field_state") & F.col("turn_now").isNotNull())
    grid = state.groupBy(*KEY, F.col("turn_now").alias("turn")).agg(F.lit(None).cast("int").alias("_")).drop("_")
    return Turns(tagged, grid, order)


def _of_side(rows):
    """Rows of exactly 'player' or 'opponent' that name a species, inside a turn."""
    named = rows.where(F.col("actor").isin(*SIDES) & (F.col("pokemon") != "") & F.col("turn_now").isNotNull())
    return named.withColumnRenamed("actor", "side").withColumn("turn", F.col("turn_now"))


def turn_actions(t: Turns) -> DataFrame:
    """Switches, moves and faints by turn and side, with the arrival order kept in `seq`."""
    kind = (
        F.when(F.col("event") == "pokemon_sent_out", "switch")
        .when(F.col("event") == "move_used", "move")
        .when(F.col("event") == "pokemon_fainted", "fainted")
    )
    rows = _of_side(t.events).withColumn("type", kind).where(F.col("type").isNotNull())
    move = F.when(F.col("type") == "move", c.move_name("move", "detail"))
    return rows.select(*KEY, "turn", "side", F.col(t.order).alias("seq"), "type", "pokemon", move.alias("move_name"))


def turn_conditions(t: Turns) -> DataFrame:
    """The last field state of each literally read turn."""
    rows = t.events.where((F.col("event") == "field_state") & F.col("turn").isNotNull())
    return rows.groupBy(*KEY, "turn").agg(
        F.max_by(F.struct(*CONDITIONS), F.col(t.order)).alias("_c")).select(*KEY, "turn", "_c.*")


def roster_slots(t: Turns) -> DataFrame:
    """One row per brought species and side, with the turn in which it first fainted."""
    empty = F.array().cast("array<string>")
    listed = lambda name: F.coalesce(F.col(name), empty)
    sides = F.array(*[
        F.struct(F.lit(s).alias("side"), F.when(F.size(listed(f"{s}_brought")) > 0, listed(f"{s}_brought"))
                 .otherwise(listed(f"{s}_team")).alias("names")) for s in SIDES])
    preview = t.events.where(F.col("event") == "team_preview").groupBy(*KEY).agg(
        F.min_by(sides, F.col(t.order)).alias("_s"))
    slots = preview.select(*KEY, F.inline("_s")).select(*KEY, "side", F.posexplode("names").alias("slot", "pokemon"))
    slots = slots.withColumn("species", c.species_key("pokemon"))
    fallen = turn_actions(t).where("type = 'fainted'").groupBy(*KEY, "side", c.species_key("pokemon").alias("species"))
    return slots.join(fallen.agg(F.min("turn").alias("faint_turn")), [*KEY, "side", "species"], "left")


def pairs_of(rows: DataFrame, keys, mons) -> DataFrame:
    """(keys, state): every board of up to two of a group's species, in either order, for groups with few species."""
    seen = rows.select(*keys, mons.alias("x")).distinct()
    few = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") <= TABLED_SPECIES)
    few = few.select(*[F.col(k).alias(f"_f{j}") for j, k in enumerate(keys)])
    seen = seen.join(few, null_safe(seen, few, [(k, f"_f{j}") for j, k in enumerate(keys)]), "left_semi")
    xs = seen.groupBy(*keys).agg(F.collect_set("x").alias("xs"))  # at most TABLED_SPECIES
    two = F.flatten(F.transform("xs", lambda x: F.transform("xs", lambda y: F.array(x, y))))
    boards = F.concat(F.array(F.slice("xs", 1, 0)), F.transform("xs", lambda x: F.array(x)), two)
    return xs.select(*keys, F.explode(boards).alias("state"))


def board(t: Turns, width=None) -> DataFrame:
    """Species on the field per turn and side, as of the start of the turn.

    A turn that reports its active list restarts the board, so the fold runs
    over the stretch between two such turns only.
    """
    keys = [*KEY, "side"]
    reported = t.events.where((F.col("event") == "field_state") & F.col("turn_now").isNotNull())
    pairs = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_active").alias("names")) for s in SIDES])
    reported = reported.select(*KEY, F.col("turn_now").alias("turn"), F.col(t.order).alias("seq"), F.inline(pairs))
    updates = reported.where(F.size("names") > 0).groupBy(*keys, "turn").agg(F.max_by("names", "seq").alias("names"))

    actions = turn_actions(t)
    arrivals = actions.where("type = 'switch'").groupBy(*keys, "turn", "pokemon").agg(F.min("seq").alias("at"))
    fallen = actions.where("type = 'fainted'").groupBy(*keys, "pokemon").agg(F.min("turn").alias("out"))
    listed = updates.select(*keys, "turn", F.posexplode("names").alias("at", "pokemon")).select(
        *keys, "turn", "pokemon", F.col("at").cast("bigint").alias("at"), F.lit(True).alias("shown"))
    named = listed.unionByName(arrivals.withColumn("shown", F.lit(False)))
    named = named.join(fallen, [*keys, "pokemon"], "left")
    item = F.struct("at", F.col("pokemon").alias("name"), "out")
    # One turn and side per group: its reported names and the distinct arrivals.
    lists = named.groupBy(*keys, "turn").agg(
        F.sort_array(F.collect_list(F.when(F.col("shown"), item))).alias("shown"),
        F.sort_array(F.collect_list(F.when(~F.col("shown"), item))).alias("arrived"))
    sides = F.array(*[F.lit(s) for s in SIDES])
    rows = t.grid.withColumn("side", F.explode(sides)).join(lists, [*keys, "turn"], "left")
    rows = scan(rows, keys, "turn", {"stretch": count_of(F.size(F.coalesce("shown", F.array())) > 0)})

    mon = "array<struct<name:string,out:int>>"
    bare = lambda items: F.transform(F.coalesce(items, F.array().cast("array<struct<at:bigint,name:string,out:int>>")),
                                     lambda x: F.struct(x["name"].alias("name"), x["out"].alias("out")))
    rows = rows.select(*keys, "stretch", "turn", bare(F.col("shown")).alias("shown"), bare(F.col("arrived")).alias("arrived"))

    def step(state, row):
        now = F.when(F.size(row["shown"]) > 0, row["shown"]).otherwise(state)
        extended = F.aggregate(
            row["arrived"], now,
            lambda acc, x: F.when(F.exists(acc, lambda y: y["name"] == x["name"]), acc)
            .otherwise(F.concat(acc, F.array(x))))

        def drop_one(acc, _):
            gone = F.array_position(F.transform(acc, lambda y: F.coalesce(y["out"] <= row["turn"], F.lit(False))), True)
            at = F.greatest(gone, F.lit(1)).cast("int")
            return F.concat(F.slice(acc, F.lit(1), at - 1), F.slice(acc, at + 1, F.size(acc)))

        surplus = F.when(F.size(extended) > 2, F.sequence(F.lit(3), F.size(extended))).otherwise(
            F.array().cast("array<int>"))
        capped = F.aggregate(surplus, extended, drop_one)
        return F.struct(capped.alias("state"), F.transform(now, lambda y: y["name"]).alias("out"))

    mons = F.explode(F.array_union(F.col("shown"), F.col("arrived")))
    folded = fold(rows, [*keys, "stretch"], "turn", ["shown", "arrived"], F.array(), step, mon, "array<string>", width,
                  lambda long: pairs_of(long, [*keys, "stretch"], mons))
    return folded.select(*keys, "turn", F.col("out").alias("board"))


def available(t: Turns, slots: DataFrame = None) -> DataFrame:
    """Brought species that had not fainted before the turn, one row per turn, side and slot."""
    slots = roster_slots(t) if slots is None else slots
    rows = t.grid.join(slots, KEY)
    return rows.where(F.col("faint_turn").isNull() | (F.col("faint_turn") >= F.col("turn"))).select(
        *KEY, "turn", "side", *[x for x in ("slot", "pokemon", "species") if x in slots.columns])


def first_reveals(t: Turns) -> DataFrame:
    """First time each species showed each move, with its place in the order of reveals."""
    moves = turn_actions(t).where((F.col("type") == "move") & F.col("move_name").isNotNull())
    return moves.groupBy(*KEY, "side", "pokemon", "move_name").agg(F.min(F.struct("turn", "seq")).alias("first"))


def known_moves(t: Turns, boards: DataFrame = None) -> DataFrame:
    """Moves of the species on the board that were revealed before the turn, in long form."""
    boards = board(t) if boards is None else boards
    shown = boards.select(*KEY, "side", "turn", F.explode(F.array_distinct("board")).alias("pokemon"))
    joined = shown.join(first_reveals(t), [*KEY, "side", "pokemon"])
    return joined.where(F.col("first.turn") < F.col("turn")).select(
        *KEY, "turn", "side", "pokemon", "move_name", F.col("first.seq").alias("seq"))


def decision_windows(t: Turns, boards: DataFrame = None) -> DataFrame:
    """One row per match, turn and side: board, available, switch options, moves known of the board, and what it then chose."""
    boards = board(t) if boards is None else boards
    slot = F.struct("slot", "pokemon")
    # The group is one roster of one side.
    alive = available(t).groupBy(*KEY, "turn", "side").agg(F.sort_array(F.collect_list(slot)).alias("_a"))
    chosen = turn_actions(t).where("type <> 'fainted'").groupBy(*KEY, "turn", "side").agg(
        F.count_if(F.col("type") == "move").alias("moves"), F.count_if(F.col("type") == "switch").alias("switches"),
        # What one side does in one turn.
        F.sort_array(F.collect_list(F.struct("seq", "type", "pokemon", "move_name"))).alias("_did"))
    reveal = F.sort_array(F.collect_list(F.struct("seq", "move_name")))
    shown = known_moves(t, boards).groupBy(*KEY, "turn", "side", "pokemon").agg(F.transform(reveal, lambda x: x["move_name"]).alias("_moves"))
    known = shown.groupBy(*KEY, "turn", "side").agg(F.map_from_entries(F.collect_list(F.struct("pokemon", "_moves"))).alias("_known"))
    rows = boards
    for part in (alive, chosen, known):
        rows = rows.join(part, [*KEY, "turn", "side"], "left")
    names = F.coalesce(F.transform("_a", lambda x: x["pokemon"]), F.array().cast("array<string>"))
    rows = rows.withColumn("available", names)
    return rows.select(
        *KEY, "turn", "side", "board", "available",
        F.filter("available", lambda x: ~F.array_contains("board", x)).alias("switch_options"),
        F.coalesce("moves", F.lit(0)).alias("moves"), F.coalesce("switches", F.lit(0)).alias("switches"),
        F.transform("board", lambda p: F.struct(p.alias("pokemon"), F.coalesce(F.try_element_at("_known", p), F.array().cast("array<string>")).alias("moves"))).alias("known_moves"),
        F.coalesce(F.transform("_did", lambda x: F.struct(x["type"].alias("type"), x["pokemon"].alias("pokemon"), x["move_name"].alias("move"))),
                   F.array().cast("array<struct<type:string,pokemon:string,move:string>>")).alias("chosen_actions"))


def hp_at_start(t: Turns, slots: DataFrame = None, windows: Turns = None) -> DataFrame:
    """Last known HP of every available slot as of the start of the turn.

    `windows` gives the turns and slots when these follow another order than the HP rows.
    """
    hits = _of_side(t.events).where((F.col("event") == "hp_change") & F.col("hp_percent").isNotNull())
    keys = [*KEY, "side", "species"]
    hits = hits.groupBy(*KEY, "side", c.species_key("pokemon").alias("species"), "turn").agg(
        F.max_by("hp_percent", t.order).alias("hp"))
    marks = hits.withColumn("_at", F.col("turn").cast("bigint") * 2 + 1)
    asked = available(windows or t, slots).withColumn("_at", F.col("turn").cast("bigint") * 2)
    axis = asked.unionByName(marks, allowMissingColumns=True)
    filled = scan(axis, keys, "_at", {"known_hp": last_of(F.col("hp"))})
    return filled.where(F.col("slot").isNotNull()).drop("_at", "hp")


def speed_tools(t: Turns) -> DataFrame:
    """First reveal of each speed item or ability per species."""
    rows = _of_side(t.events).where(F.col("event") == "item_or_ability_activated")
    rows = rows.withColumn("tool", c.speed_tool("detail")).where(F.col("tool").isNotNull())
    return rows.groupBy(*KEY, "side", "pokemon", "tool").agg(F.min("turn").alias("turn"))


def turn_faints(t: Turns) -> DataFrame:
    return turn_actions(t).where("type = 'fainted'").select(*KEY, "turn", "side", "seq", "pokemon")


def stat_changes(t: Turns) -> DataFrame:
    rows = _of_side(t.events).where(F.col("event") == "stat_change")
    rows = rows.withColumn("_s", c.stat_change("detail")).where(F.col("_s").isNotNull())
    return rows.select(*KEY, "turn", "side", F.col(t.order).alias("seq"), "pokemon", "_s.stat", "_s.direction")


def trick_room_setters(t: Turns) -> DataFrame:
    rows = t.events.where((F.col("event") == "move_used") & F.col("actor").isin(*SIDES))
    rows = rows.where(F.lower(c.move_name("move", "detail")) == "trick room")
    return rows.select(*KEY, F.col("actor").alias("side")).distinct()
