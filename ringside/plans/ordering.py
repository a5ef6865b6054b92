"""Exact order numbers for groups of any length, and lineage cuts that survive lost executors."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.plans.scan import count_of, scan


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the cluster's checkpoint folder and read it back; files go when the driver's JVM ends.

    The folder is the session's `spark.checkpoint.dir` or the context's own checkpoint folder. Read from files, a table keeps
    its size for the choice of joins and is read by column. Spark takes the size of the files for the size of the rows, so they are
    written plain: packed, millions of keys look small enough to be sent through the driver to every task.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    path = f"{folder.rstrip('/')}/ringside-{uuid.uuid4().hex}"
    df.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def sorted_index(df: DataFrame, columns, name="_seq") -> DataFrame:
    """Number the rows in global `columns` order: unique and increasing, not gap-free.

    Range partitioning splits a long group over many tasks because the order
    columns take part in the ranges. The result is written before anyone uses
    the numbers, so a retried task cannot see other range bounds.
    """
    ordered = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return materialise(ordered.withColumn(name, F.monotonically_increasing_id()))


def ranked(df: DataFrame, keys, columns, name="rank", width=None) -> DataFrame:
    """row_number() of each row in its group, without one task per group."""
    indexed = sorted_index(df, [*keys, *columns], "_seq")
    return scan(indexed, keys, "_seq", {name: count_of()}, width=width).drop("_seq")


def in_time_order(events: DataFrame, name="time_idx") -> DataFrame:
    """Add `time_idx`: the position of an event in (timestamp, arrival) order of its match."""
    from ringside.contracts import KEY

    timed = events.withColumn("_t", F.coalesce(F.col("timestamp"), F.lit(0.0)))
    return sorted_index(timed, [*KEY, "_t", "event_idx"], name).drop("_t")
