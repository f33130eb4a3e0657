"""Runs of a stream over the files that are there, into Parquet, from where the last run stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.exprs import col
from tallyfold.storage import new_path


def source(spark: SparkSession, path: str, time: str | None = None, files: int | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A stream of the Parquet files at `path` (a file, a folder or a pattern); `files` at most in a batch, oldest first.

    `time` is read as an instant of the session's zone, as a watermark needs it.
    """
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files_of = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files_of.exists(place) and files_of.getFileStatus(place).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    rows = reader.parquet(path)
    return rows.withColumn(time, col(time).cast("timestamp")) if time else rows


def drained(stream: DataFrame, sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs the stream over all that is there now, appends what is final to the Parquet table `sink`, and reads the table.

    Offsets and state live in `checkpoint`: a later run with the same folder takes only new
    files, keeps the open windows and the watermark, and writes each window once, also
    after a lost executor or a killed driver. Both folders lie in the shared one unless given. A
    window is final, and written, when the watermark has passed its end; rows behind the
    watermark of earlier batches are dropped.
    """
    spark = stream.sparkSession
    base = new_path(spark)
    sink, checkpoint = sink or f"{base}/sink", checkpoint or f"{base}/checkpoint"
    running = stream.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return spark.read.schema(stream.schema).parquet(sink)


def over(spark: SparkSession, path: str, time: str, make: Callable[[DataFrame], DataFrame], sink: str | None = None, checkpoint: str | None = None, files: int | None = None) -> DataFrame:
    """`make` (an operator of `windows`) run over the stream of `path`; start and end come back in the type of `time`."""
    kind = spark.read.parquet(path).schema[time].dataType
    out = drained(make(source(spark, path, time, files)), sink, checkpoint)
    return out.withColumns({c: F.col(c).cast(kind) for c in ("start", "end") if c in out.columns})
