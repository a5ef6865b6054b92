"""Match tables derived from the given test tables.

Each expression is text that Spark and an ANSI SQL engine read alike, so a
check in another engine can start from the same rows. A match is 40 rows of
`events` in arrival order, a job is 8 matches.
"""

from pyspark.sql import DataFrame, SparkSession

from ringside.contracts import NAME_LIST_COLUMNS
from ringside.functions.columns import split_names

ROSTER = ",".join([
    "Garchomp", "Incineroar", "Sylveon", "Kingambit", "Charizard", "Whimsicott",
    "Basculegion", "Sneasler", "Archaludon", "Sinistcha", "Rotom-Wash", "Ninetales-Alola",
    "Farigiraf", "Excadrill", "Talonflame", "Venusaur", "Gengar", "Metagross",
    "Swampert", "Snorlax", "Mawile", "Hydreigon", "Smeargle", "Zoroark-Hisui",
])
MOVES = ",".join([
    "Protect", "Earthquake", "Fake Out", "Follow Me", "Trick Room", "Heat Wave",
    "Tailwind", "Icy Wind", "Draco Meteor", "Rage Powder", "Moonblast", "Rock Slide",
])
TOOLS = ",".join(["item: Choice Scarf", "ability: Swift Swim", "item: Leftovers", "Item: Booster Energy",
                  "ability: Intimidate", "activated"])
STAT_LINES = ",".join(["Attack rose", "Speed sharply rose", "Attack fell", "Defense wont go any higher",
                       "Sp. Atk rose", "Sp. Def harshly fell", "Defense rose", "attack rose"])


def _pick(words, index):
    return f"split_part('{words}', ',', cast({index} as int))"


def _slot(base, step, number):
    return _pick(ROSTER, f"({base} + {number} * {step}) % 24 + 1")


def _team(base, step):
    return " || ', ' || ".join(_slot(base, step, f"{j}") for j in range(6))


def _brought(base, step, count):
    return " || ', ' || ".join(_slot(base, step, f"((match_id + {j}) % 6)") for j in range(count))


_P, _O = ("p_base", 7), ("o_base", 5)

LAYERS = [
    {
        "match_id": "cast(floor(event_id / 40) as bigint)",
        "pos": "cast(event_id % 40 as int)",
        "k": "cast(regexp_extract(props, '([0-9]+)', 1) as int)",
    },
    {
        "job_no": "cast(floor(match_id / 8) as bigint)",
        "match": "cast(match_id % 8 + 1 as int)",
        "event_idx": "event_id % 320",
        "timestamp": "cast(pos * 5 as double)",
        "event": (
            "case when pos = 0 then 'team_preview' when pos = 39 then 'battle_end' when pos % 5 = 1 then 'field_state'"
            " when event_type = 'click' and k % 5 = 3 then 'pokemon_sent_out'"
            " when event_type = 'click' then 'move_used'"
            " when event_type = 'view' and k % 5 = 4 then 'status_inflicted'"
            " when event_type = 'view' then 'hp_change'"
            " when event_type = 'error' and k % 3 <> 0 then 'move_used'"
            " when event_type = 'error' then 'pokemon_fainted'"
            " when event_type = 'signup' and k % 9 = 2 then 'terastallized'"
            " when event_type = 'signup' then 'stat_change'"
            " else 'item_or_ability_activated' end"
        ),
    },
    {
        "user_id_text": "'u' || cast(job_no % 10 as varchar(20))",
        "job_id": "'j' || cast(job_no as varchar(20))",
        "p_base": "cast(case when job_no % 4 = 1 and match = 3 then job_no % 5 + 9 else job_no % 5 end as int)",
        "o_base": "cast((match_id * 11) % 7 as int)",
        "actor": (
            "case when event in ('team_preview', 'field_state') then 'both'"
            " when event = 'battle_end' and k < 45 then 'player'"
            " when event = 'battle_end' and k < 90 then 'opponent'"
            " when event = 'battle_end' then 'unknown'"
            " when k % 23 = 5 then 'unknown'"
            " when k % 2 = 0 then 'player' else 'opponent' end"
        ),
        "turn_raw": (
            "case when event = 'field_state' then case when k % 7 = 0 then 'unknown'"
            " when k % 7 = 1 then ' ' || cast(cast(floor(pos / 5) + 1 as int) as varchar(20))"
            " else cast(cast(floor(pos / 5) + 1 as int) as varchar(20)) end end"
        ),
        "hp_raw": (
            "case when event = 'hp_change' then case when k % 7 = 0 then 'not visible'"
            " when k % 7 = 1 then cast(k as varchar(20)) || '%'"
            " when k % 7 = 2 then cast(k as varchar(20)) || '/200'"
            " when k % 7 = 3 then cast(k as varchar(20)) || ' / 0'"
            " else cast(k as varchar(20)) end end"
        ),
        "confidence": "cast(k + 1 as double) / 100",
        "winner": (
            "case when event = 'battle_end' then case when k < 45 then 'player' when k < 90 then 'opponent'"
            " else 'unknown' end end"
        ),
    },
    {
        "pokemon": (
            "case when actor in ('player', 'unknown') and event not in ('battle_end') then "
            + _slot(*_P, "((match_id + user_id % 4) % 6)")
            + " when actor = 'opponent' and event not in ('battle_end') then "
            + _slot(*_O, "((match_id + user_id % 4) % 6)") + " end"
        ),
        "turn": (
            "case when event = 'field_state' and k % 7 <> 0 then cast(floor(pos / 5) + 1 as int) end"
        ),
        "hp_percent": (
            "case when event = 'hp_change' and k % 7 = 2 then cast(k as double) / 200 * 100"
            " when event = 'hp_change' and k % 7 not in (0, 3) then cast(k as double)"
            " when event = 'pokemon_fainted' then cast(0 as double) end"
        ),
        "detail": (
            "case when event = 'move_used' and k % 11 = 0 then " + _pick(MOVES, "k % 12 + 1") + " || ' (failed)'"
            " when event = 'move_used' then " + _pick(MOVES, "k % 12 + 1")
            + " when event = 'stat_change' and k % 8 = 3 then 'Defense won''t go any higher'"
            " when event = 'stat_change' then " + _pick(STAT_LINES, "k % 8 + 1")
            + " when event = 'item_or_ability_activated' then " + _pick(TOOLS, "k % 6 + 1")
            + " when event = 'status_inflicted' and k % 2 = 0 then 'burn' when event = 'status_inflicted' then 'par'"
            " when event = 'battle_end' then case when k % 6 = 0 then 'You won the battle!'"
            " when k % 6 = 1 then 'You were defeated' when k % 6 = 2 then 'Opponent won'"
            " when k % 6 = 3 then 'You win' else 'result screen' end"
            " when event = 'hp_change' and k % 13 = 6 then"
            " 'Read ''Gengar'' and ''Mew'' on screen, reporting closest match, Garchomp.'"
            " when event = 'field_state' then 'field' else event end"
        ),
        "item": (
            "case when event = 'item_or_ability_activated' and k % 6 = 0 then 'Choice Scarf'"
            " when event = 'item_or_ability_activated' and k % 6 = 2 then 'Leftovers'"
            " when event = 'item_or_ability_activated' and k % 6 = 3 then 'Booster Energy' end"
        ),
        "status": "case when event = 'status_inflicted' and k % 2 = 0 then 'burn' when event = 'status_inflicted' then 'par' end",
        "weather": "case when event = 'field_state' then " + _pick("none,rain,sun,unknown,sand", "k % 5 + 1") + " end",
        "terrain": "case when event = 'field_state' then " + _pick("none,grassy,none,psychic", "k % 4 + 1") + " end",
        "trick_room": "case when event = 'field_state' then k % 3 = 0 end",
        "tailwind": "case when event = 'field_state' then " + _pick("none,player,opponent,both", "(k + pos) % 4 + 1") + " end",
        "screens": (
            "case when event = 'field_state' then case when k % 6 = 1 then 'player Reflect'"
            " when k % 6 = 2 then 'opponent Light Screen, player Reflect'"
            " when k % 6 = 3 then 'opponent Aurora Veil' else 'none' end end"
        ),
        "player_active": (
            "case when event = 'field_state' and k % 3 <> 0 then " + _slot(*_P, "((match_id + k % 4) % 6)")
            + " || ', ' || " + _slot(*_P, "((match_id + (k + 1) % 4) % 6)") + " end"
        ),
        "opponent_active": (
            "case when event = 'field_state' and k % 4 <> 0 then " + _slot(*_O, "((match_id + k % 4) % 6)")
            + " || ', ' || " + _slot(*_O, "((match_id + (k + 1) % 4) % 6)") + " end"
        ),
        "player_team": "case when event = 'team_preview' then " + _team(*_P) + " end",
        "opponent_team": "case when event = 'team_preview' then " + _team(*_O) + " end",
        "player_brought": (
            "case when event = 'team_preview' and k % 10 = 9 then '' when event = 'team_preview' and k % 10 = 8 then "
            + _brought(*_P, 3) + " when event = 'team_preview' then " + _brought(*_P, 4) + " end"
        ),
        "opponent_brought": (
            "case when event = 'team_preview' and k % 10 = 7 then '' when event = 'team_preview' then "
            + _brought(*_O, 4) + " end"
        ),
        "player_lead": "case when event = 'team_preview' and k % 10 <> 9 then " + _brought(*_P, 2) + " end",
        "opponent_lead": "case when event = 'team_preview' then " + _brought(*_O, 2) + " end",
        "illegal_species_detected": (
            "case when event = 'team_preview' and match_id % 9 = 0 then 'Bisharp'"
            " when event = 'team_preview' then '' end"
        ),
        "roster_conflict": "event not in ('team_preview', 'battle_end') and k % 13 = 6",
        "roster_conflict_species": (
            "case when event not in ('team_preview', 'battle_end') and k % 13 = 6 then "
            + _slot("o_base", 5, "(match_id + k % 2) % 6 + 7") + " end"
        ),
        "reference_frame": (
            "case when event <> 'battle_end' and k % 4 <> 0 then 'frame' || cast(cast(floor(pos / 3) as int) as varchar(20)) end"
        ),
        "reference_frame_shows_subject": (
            "case when event <> 'battle_end' and k % 4 <> 0 and k % 5 < 4 then k % 5 < 2 end"
        ),
        "corrected": "k % 17 = 4",
        "event_kind_raw": "event_type",
    },
]


def oracle_view(name="ev") -> str:
    """The bridge as a chain of SQL common table expressions that ends in `name`."""
    parts, source = [], "events"
    for i, layer in enumerate(LAYERS):
        alias = name if i == len(LAYERS) - 1 else f"{name}_{i}"
        extra = ", ".join(f"{expr} AS {column}" for column, expr in layer.items())
        parts.append(f"{alias} AS (SELECT *, {extra} FROM {source})")
        source = alias
    return ", ".join(parts)


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge rows with name lists still in comma form."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    for layer in LAYERS:
        df = df.selectExpr("*", *[f"{expr} AS {column}" for column, expr in layer.items()])
    return df


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge rows as the typed event table, written in time order of each match."""
    df = raw_matches(spark, sf_dir)
    lists = [c for c in NAME_LIST_COLUMNS if c in df.columns]
    df = df.withColumns({c: split_names(c) for c in lists})
    return df.withColumn("user_id", df["user_id_text"])
