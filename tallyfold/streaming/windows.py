"""Windowed aggregates over event time; they run on streams and on tables alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col


def tumbling(df: DataFrame, time: str, width: str, late: str, by: Sequence[str], value: str, slide: str | None = None) -> DataFrame:
    """start, end, keys, n, total and mean of each window; rows later than `late` behind the newest are dropped by a stream."""
    w = F.window(col(time), width, slide) if slide else F.window(col(time), width)
    out = df.withWatermark(time, late).groupBy(w.alias("w"), *map(col, by)).agg(F.count("*").alias("n"), F.sum(col(value)).alias("total"), F.avg(col(value)).alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *map(col, by), "n", "total", "mean")


def sessions(df: DataFrame, time: str, gap: str, late: str, by: Sequence[str]) -> DataFrame:
    """start, end, keys and n of runs of events with no gap of `gap` or more."""
    out = df.withWatermark(time, late).groupBy(F.session_window(col(time), gap).alias("w"), *map(col, by)).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *map(col, by), "n")


def first_of_each(df: DataFrame, time: str, keys: Sequence[str], late: str) -> DataFrame:
    """One row for each combination of keys within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))
