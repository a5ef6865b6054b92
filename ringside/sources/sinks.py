"""Writers. Spark's commit protocol makes each write all-or-nothing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_events(events: DataFrame, path, partition=("job_id",)):
    """Typed Parquet, one folder per upload; only the uploads present are replaced."""
    (events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path))


def events_csv(events: DataFrame) -> DataFrame:
    """Flat text columns: lists become comma text, other nested values JSON."""
    out = []
    for field in events.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            column = F.array_join(column, ", ")
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(column)
        out.append(column.cast("string").alias(field.name))
    return events.select(*out)


def write_events_csv(events: DataFrame, path):
    events_csv(events).write.mode("overwrite").option("header", True).csv(path)


def write_events_json(events: DataFrame, path, partition=("job_id",)):
    """JSON lines, one folder per upload."""
    (events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).json(path))


def write_csv(rows: DataFrame, path):
    """Match windows, record rows or keep segments."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def report_text(lines: DataFrame, by, part="part", place="place", line="line") -> DataFrame:
    """One report per group from its ordered lines; a report has a few dozen lines by design."""
    ordered = F.sort_array(F.collect_list(F.struct(part, place, F.col(line).alias("_t"))))
    return lines.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["_t"]), "\n").alias("value"))


def write_report_md(reports: DataFrame, path, by):
    reports.select(*by, "value").write.mode("overwrite").partitionBy(*by).text(path)


def append_audit(rows: DataFrame, path) -> bool:
    """Append audit rows; a failure is reported to the caller but never raised."""
    try:
        rows.write.mode("append").json(path)
        return True
    except Exception:  # noqa: BLE001 - logging must not break the work it logs
        return False
