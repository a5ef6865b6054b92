"""Readers: files to bronze rows and typed tables. Unreadable input gives no rows, never a failed job."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringside.contracts import EVENTS, NAME_LIST_COLUMNS
from ringside.functions import columns as c
from ringside.plans.ordering import materialise, ranked


def _job_of(path):
    """The folder of a file, as a plain name or as a partition of the writers."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -2), "^job_id=", "")


def _numbered(rows, path, name):
    """Add `name`: the row's number in its own file, from 0, in reading order.

    The running ids are written before they are compared, and a file's ids are gap-free as each file here is one split.
    """
    rows = materialise(rows.withColumn("_id", F.monotonically_increasing_id()))
    first = rows.groupBy(F.col(path).alias("_path")).agg(F.min("_id").alias("_first"))
    return rows.join(first, F.col(path) == F.col("_path")).withColumn(name, F.col("_id") - F.col("_first")).drop("_id", "_path", "_first")


def _array_rows(parsed):
    """Rows of an array, or of a list under a known key, or one event on its own."""
    lists = [F.try_variant_get(parsed, f"$.{k}", "array<variant>") for k in ("events", "results", "data", "items")]
    single = F.when(F.try_variant_get(parsed, "$.event", "string").isNotNull(), F.array(parsed))
    return F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), *lists, single)


def normalize_ai_payload(texts: DataFrame, keys, text="text") -> DataFrame:
    """(keys, pos, value) of every event in a JSON text of any accepted shape."""
    rows = texts.select(*keys, F.try_parse_json(F.col(text)).alias("_v"))
    return rows.select(*keys, F.posexplode(_array_rows(F.col("_v"))).alias("pos", "value"))


def read_events_json(spark: SparkSession, path) -> DataFrame:
    """Bronze rows (job_id, pos, value) of event files: one JSON text, or one event per line as the writer leaves them.

    The job is the folder. `pos` is the row's own event_idx if every event of its file has one and no two share it, else the
    place in the file: the two number lines never mix.
    """
    files = spark.read.text(path, wholetext=True).select(_job_of(F.col("_metadata.file_path")).alias("job_id"), F.col("value").alias("text"))
    lines = F.filter(F.transform(F.split("text", "\\R"), lambda x: F.try_parse_json(x)), lambda x: x.isNotNull())
    rows = files.select("job_id", F.coalesce(_array_rows(F.try_parse_json("text")), lines).alias("_events"))
    own = F.transform("_events", lambda x: F.try_variant_get(x, "$.event_idx", "int"))
    numbered = F.forall(own, lambda x: x.isNotNull()) & (F.size(F.array_distinct(own)) == F.size("_events"))
    rows = rows.select("job_id", numbered.alias("_own"), F.posexplode("_events").alias("pos", "value"))
    return rows.select("job_id", F.when(F.col("_own"), F.try_variant_get("value", "$.event_idx", "int")).otherwise(F.col("pos")).alias("pos"), "value")


def silver_events(bronze: DataFrame, user=None) -> DataFrame:
    """The typed event table of bronze rows."""
    v = F.col("value")
    get = lambda name, kind="string": F.try_variant_get(v, f"$.{name}", kind)
    special = {
        "user_id": F.lit(None).cast("string") if user is None else user, "job_id": F.col("job_id"),
        "event_idx": F.col("pos").cast("bigint"), "timestamp": get("timestamp", "double"),
        "event": F.trim(get("event")), "hp_percent": c.coerce_hp(F.try_variant_get(v, "$.hp_percent", "variant")),
        "turn": c.normalize_turn(F.try_variant_get(v, "$.turn", "variant")),
        "pokemon": F.get(c.names_of(F.try_variant_get(v, "$.pokemon", "variant")), F.lit(0)),
        "field_status": F.to_json(F.try_variant_get(v, "$.field_status", "variant")),
    }
    out = []
    for field in EVENTS.fields:
        if field.name in special:
            column = special[field.name]
        elif field.name in NAME_LIST_COLUMNS:
            column = c.names_of(F.try_variant_get(v, f"$.{field.name}", "variant"))
        else:
            column = get(field.name, field.dataType.simpleString())
        out.append(column.cast(field.dataType).alias(field.name))
    return bronze.select(*out)


def read_events_csv(spark: SparkSession, path) -> DataFrame:
    """Bronze rows (job_id, pos, value) of CSV event files, all fields text.

    Multi-line reading keeps a file in one split, so row numbers follow its lines; each file counts from 0.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    value = F.try_parse_json(F.to_json(F.struct(*rows.columns)))
    rows = _numbered(rows.select(F.col("_metadata.file_path").alias("_file"), value.alias("value")), "_file", "pos")
    return rows.select(_job_of(F.col("_file")).alias("job_id"), "pos", "value")


def read_match_windows(spark: SparkSession, path, by_order=False) -> DataFrame:
    """Match windows of CSV files; rows that do not parse are dropped. `by_order` numbers them by row."""
    lines = spark.read.text(path, wholetext=True).select(
        _job_of(F.col("_metadata.file_path")).alias("job_id"), F.split("value", "\\r?\\n").alias("_l"))
    head = F.transform(F.split(F.get("_l", F.lit(0)), ","), lambda x: F.trim(x))
    rows = lines.select("job_id", head.alias("_h"), F.posexplode(F.slice("_l", F.lit(2), F.size("_l"))).alias("line", "_t"))
    rows = rows.where(F.trim("_t") != "").withColumn("_m", F.map_from_entries(F.arrays_zip("_h", F.slice(
        F.concat(F.split("_t", ","), F.array_repeat(F.lit(""), F.size("_h"))), F.lit(1), F.size("_h")))))
    field = lambda name, kind: F.trim(F.try_element_at("_m", F.lit(name))).try_cast(kind)
    number = (F.col("line") + 1).cast("int") if by_order else field("match", "int")
    rows = rows.select("job_id", number.alias("match"), field("start_seconds", "double").alias("start_seconds"),
                       field("end_seconds", "double").alias("end_seconds"), field("duration_seconds", "double").alias("duration_seconds"), "line")
    need = ["start_seconds", "end_seconds"] if by_order else ["match", "duration_seconds"]
    return rows.dropna(subset=need)


def read_replays(spark: SparkSession, path, player="p1") -> DataFrame:
    """Replay sources of any kind, one row per file with all that the import asks for.

    A path ends in user/job/file; `ord` numbers the files of an upload by name.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("replay_id"), F.col("value").alias("raw"))
    files = files.withColumns({"player": F.lit(player), "user_id": F.element_at(F.split("replay_id", "/"), -3), "job_id": _job_of(F.col("replay_id"))})
    return ranked(files, ["user_id", "job_id"], ["replay_id"], "ord")


def read_texts(spark: SparkSession, path, encoding="UTF-8") -> DataFrame:
    """(source, text) of whole text files in any encoding; a leading byte order mark is dropped."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", encoding)
    return files.select(F.col("path").alias("source"), F.regexp_replace(text, "^\\uFEFF", "").alias("text"))


def read_frame_manifest(spark: SparkSession, path) -> DataFrame:
    """(job_id, path, t, ord) of frame lists; a frame without a time gets its place in seconds."""
    rows = F.split("value", "\\r?\\n")
    lines = spark.read.text(path, wholetext=True).select(_job_of(F.col("_metadata.file_path")).alias("job_id"), F.posexplode(
        F.slice(rows, F.lit(2), F.size(rows))).alias("ord", "_t"))
    cell = lambda i: F.trim(F.get(F.split("_t", ","), F.lit(i)))
    return lines.where(cell(0) != "").select("job_id", cell(0).alias("path"), F.coalesce(cell(1).try_cast("double"), F.col("ord").cast("double")).alias("t"), "ord")


def audit_rows(lines: DataFrame, order) -> DataFrame:
    """Typed audit rows of JSON lines; malformed lines are skipped."""
    rows = lines.withColumn("payload", F.try_parse_json("value"))
    rows = rows.where(F.col("payload").isNotNull() & F.schema_of_variant("payload").startswith("OBJECT"))
    return rows.select(order, F.try_variant_get("payload", "$.event_type", "string").alias("event_type"),
                       F.try_variant_get("payload", "$.created_at", "double").alias("created_at"), "payload")


def last_rows(rows: DataFrame, order, n=200) -> DataFrame:
    """The last n rows, oldest first."""
    return rows.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def read_audit(spark: SparkSession, path, n=200) -> DataFrame:
    """The last n audit rows; several files follow each other by name."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = spark.read.text(path).withColumn("line_no", place)
    return last_rows(audit_rows(lines, "line_no"), "line_no", n)


def batch_results(lines: DataFrame) -> DataFrame:
    """(match, chunk, events, error) of batch answers: exactly one of events and error is set.

    Code fences are removed, and an array or object inside other text is used.
    """
    v = F.try_parse_json("line")
    rows = lines.withColumn("_v", v).where(F.col("_v").isNotNull())
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    said = F.trim(F.coalesce(get("$.response.candidates[0].content.parts[0].text"), F.lit("")))
    bare = F.when(said.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(said, "^```[a-zA-Z]*\\n?", ""), "\\n?```$", ""))).otherwise(said)
    inner = F.regexp_extract(bare, "(?s)([\\[{].*[\\]}])", 1)
    parsed = F.coalesce(F.try_parse_json(bare), F.when(inner != "", F.try_parse_json(inner)))
    has_text = get("$.response.candidates[0].content.parts[0].text").isNotNull()
    failed = get("$.error")
    empty = get("$.response", "variant").isNull() | F.coalesce(F.is_variant_null(get("$.response", "variant")), F.lit(False))
    error = (
        F.when(failed != "", failed)
        .when(empty, "empty response (no 'response' field in result line)")
        .when(~has_text, "response had no text content")
        .when(parsed.isNull(), F.concat(F.lit("could not parse response text as JSON: "), F.substring(bare, 1, 100)))
    )
    key = c.parse_event_key(get("$.key"))
    rows = rows.select(key["match"].alias("match"), key["chunk"].alias("chunk"), F.when(error.isNull(), parsed).alias("events"), error.alias("error"))
    return rows.where(F.col("match").isNotNull())


def read_transcript(spark: SparkSession, path) -> DataFrame:
    shape = T.StructType([T.StructField("match", T.IntegerType()), T.StructField("start", T.DoubleType()),
                          T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())])
    rows = spark.read.schema(shape).option("multiLine", True).json(path)
    return rows.select(_job_of(F.col("_metadata.file_path")).alias("job_id"), "*")


def read_jobs(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path) -> DataFrame:
    """Signals, label series, frame vectors and other tables that arrive as Parquet."""
    return spark.read.parquet(path)


def read_reference(spark: SparkSession, path, name="species", values="moves", encoding="UTF-8") -> DataFrame:
    """(name, value) pairs of a JSON object file that maps names to lists, in any encoding."""
    rows = read_texts(spark, path, encoding).select(F.from_json("text", "map<string,array<string>>").alias("_m"))
    return rows.select(F.explode("_m").alias(name, "_l")).select(name, F.explode("_l").alias(values))


def override_reference(base: DataFrame, override: DataFrame, key="species") -> DataFrame:
    """Names in the override replace their whole base entry."""
    return base.join(override.select(key).distinct(), key, "left_anti").unionByName(override)


