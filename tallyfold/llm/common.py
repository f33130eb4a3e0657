"""Helpers that the corpus operators share: session settings, shared tables, Arrow rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that go to Python at once: texts may be long, so batches stay small.
ROWS_PER_BATCH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows in an Arrow batch, so that a worker's memory follows the batch, not the partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one on a local master, and an error on a cluster, whose nodes share none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyfold-"))
        found = sc.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read again: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tallyfold/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that `cut` wrote and that no later step reads."""
    for df in tables:
        if path := getattr(df, "_cut_path", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(run, schema)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of the files under `df`; read from the plan, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def labelled_sample(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most `bound` rows (doc_id, y) of `labels` in the order of a hash of doc_id; null ids and labels are left out."""
    rows = labels.select(F.col("doc_id"), F.col(column).cast("int").alias("y"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(bound)


def groups_for(df: DataFrame, group_bytes: int) -> int:
    """Groups of about `group_bytes` input bytes each; where the plan knows no size, rows are counted."""
    size = input_bytes(df)
    if size >= 1 << 52:
        size = 2048 * df.count()
    return max(1, -(-size // group_bytes))


def release(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of tables that have been written: they are freed when their plans are collected as garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Measured bytes of a side that is broadcast on purpose, at most.
BROADCAST_BYTES = 16 << 20


def _width(kind: T.DataType, c: Column) -> Column:
    """Bytes that a value takes in memory, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, c.getField(f.name)) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        fixed = isinstance(kind.elementType, (T.StructType, T.NumericType, T.BooleanType))
        one = 16 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 8
        return F.coalesce(F.size(c), F.lit(0)) * one + 16 if fixed else F.octet_length(F.to_json(F.struct(c))) + 16
    return F.lit(8)


def narrow(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcast if its rows are measured to take at most BROADCAST_BYTES; else it is left to a shuffled join."""
    row = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(16)).cast("long")
    size = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
