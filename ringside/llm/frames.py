"""Tables, lineage cuts and row-wise Arrow maps shared by the operators of this subpackage."""

import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

FOLDS = 5
#: Rows in one Arrow batch: long texts pile up in a batch, in the JVM and in Python alike.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or the context's own checkpoint folder where the session sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    return folder.rstrip("/")


def stored(df: DataFrame, name="step", partition_by=None) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: lost executors cost no earlier work.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def discard(step: DataFrame) -> None:
    """Delete the folder of a `stored` step that nothing reads any more."""
    spark, files = step.sparkSession, step.inputFiles()
    if files:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if hadoop.getName().startswith("llm-"):
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def fold(column="doc_id"):
    """crc32 of the id as text, mod 5; a missing id counts as the empty text (remainder 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0)) % FOLDS


def held_out(column="doc_id"):
    return fold(column) == 0


#: Python workers live on between tasks: large buffers go back to the system as they are freed.
GIVE_BACK = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "8388608", "MALLOC_TRIM_THRESHOLD_": "33554432", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def reach(df: DataFrame) -> None:
    """Let Python workers find this library where the driver does, or else as it is installed there, and give memory back."""
    for name, value in GIVE_BACK.items():
        df.sparkSession.sparkContext.environment.setdefault(name, value)
    environment, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def _map(df: DataFrame, run, schema) -> DataFrame:
    reach(df)
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def added(df: DataFrame, make, fields: dict[str, str], drop=()) -> DataFrame:
    """`df` with columns that Python computes from Arrow batches; one map, no shuffle.

    make() is called once per task and returns batch -> list of arrays, one per
    entry of `fields`. Columns of `df` with these names are replaced; `drop` names go.
    """
    kept = [f for f in df.schema.fields if f.name not in fields and f.name not in drop]
    new = [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()]
    arrow = [to_arrow_type(f.dataType) for f in new]
    names = [f.name for f in kept]

    def run(batches):
        compute = make()
        for batch in batches:
            columns = compute(batch)
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            arrays += [pa.array(c, type=t) if not isinstance(c, pa.Array) else c.cast(t) for c, t in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names + list(fields))

    return _map(df, run, T.StructType(kept + new))


def emitted(df: DataFrame, make, schema: str) -> DataFrame:
    """Rows that Python makes from Arrow batches: make() returns (batch -> columns, end -> columns or None)."""
    struct = T._parse_datatype_string(schema)
    types, names = [to_arrow_type(f.dataType) for f in struct.fields], struct.names

    def batch_of(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches):
        step, end = make()
        for batch in batches:
            columns = step(batch)
            if columns is not None and len(columns[0]):
                yield batch_of(columns)
        columns = end() if end else None
        if columns is not None and len(columns[0]):
            yield batch_of(columns)

    return _map(df, run, struct)


def whole(rows: DataFrame, vector: str):
    """Whether the vector is there and all its entries are finite numbers."""
    v = F.col(vector)
    if rows.schema[vector].dataType.elementType.typeName() not in ("float", "double"):
        v = v.cast("array<double>")
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def matrices(column):
    """(row numbers, matrix of doubles) for each length of vector in an Arrow list column without nulls."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)].astype(np.float64)
