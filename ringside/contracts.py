"""Table contracts: key columns and the typed event table."""

from pyspark.sql import types as T

KEY = ["user_id", "job_id", "match"]
SIDES = ("player", "opponent")

_names = T.ArrayType(T.StringType())

EVENTS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("match", T.IntegerType()),
    T.StructField("event_idx", T.LongType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("event", T.StringType()),
    T.StructField("actor", T.StringType()),
    T.StructField("pokemon", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("hp_percent", T.DoubleType()),
    T.StructField("turn", T.IntegerType()),
    T.StructField("winner", T.StringType()),
    T.StructField("move", T.StringType()),
    T.StructField("player_active", _names),
    T.StructField("opponent_active", _names),
    T.StructField("weather", T.StringType()),
    T.StructField("terrain", T.StringType()),
    T.StructField("trick_room", T.BooleanType()),
    T.StructField("tailwind", T.StringType()),
    T.StructField("screens", T.StringType()),
    T.StructField("field_status", T.StringType()),
    T.StructField("player_team", _names),
    T.StructField("opponent_team", _names),
    T.StructField("player_brought", _names),
    T.StructField("opponent_brought", _names),
    T.StructField("player_lead", _names),
    T.StructField("opponent_lead", _names),
    T.StructField("illegal_species_detected", _names),
    T.StructField("likely_missed_opponent_species", _names),
    T.StructField("stat", T.StringType()),
    T.StructField("stages", T.IntegerType()),
    T.StructField("item", T.StringType()),
    T.StructField("ability", T.StringType()),
    T.StructField("tera_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("reference_frame", T.StringType()),
    T.StructField("reference_frame_shows_subject", T.BooleanType()),
    T.StructField("roster_conflict", T.BooleanType()),
    T.StructField("roster_conflict_species", _names),
    T.StructField("corrected", T.BooleanType()),
    T.StructField("corrected_at", T.DoubleType()),
    T.StructField("corrected_by", T.StringType()),
    T.StructField("source", T.StringType()),
])

NAME_LIST_COLUMNS = [f.name for f in EVENTS.fields if isinstance(f.dataType, T.ArrayType)]
