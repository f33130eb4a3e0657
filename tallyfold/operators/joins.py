"""Joins. Which algorithm runs is left to adaptive execution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col
from tallyfold.operators.fuzzy import partial_ratio, ratio, similar, token_sort_ratio  # noqa: F401
from tallyfold.operators.transform import need

_HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


def merge(df: DataFrame, other: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on one column or several. Null keys never match; clashing columns of `other` get the suffix _right; a full join keeps both keys."""
    if how == "cross":
        return df.crossJoin(other.select(*(col(c).alias(f"{c}_right" if c in df.columns else c) for c in other.columns)))
    keys = [on] if isinstance(on, str) else list(on)
    need(df, *keys)
    need(other, *keys)
    own = {k: f"__key{i}" for i, k in enumerate(keys)}
    renamed = other.select(*(col(c).alias(own.get(c) or (f"{c}_right" if c in df.columns else c)) for c in other.columns))
    out = df.join(renamed, [col(k) == F.col(own[k]) for k in keys], _HOW[how])
    if how in ("outer", "full"):
        return out.withColumnsRenamed({own[k]: f"{k}_right" for k in keys})
    if how == "right":
        out = out.withColumns({k: F.col(own[k]) for k in keys})
    return out.drop(*own.values())


def anti_join(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Rows whose key `other` does not hold; null keys stay."""
    need(df, on)
    return df.join(other.select(col(on).alias("__key")), col(on) == F.col("__key"), "left_anti")


def semi_join(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    need(df, on)
    return df.join(other.select(col(on).alias("__key")), col(on) == F.col("__key"), "left_semi")


def fuzzy_join(df: DataFrame, other: DataFrame, on: str, threshold: float = 80, method: str = "ratio") -> DataFrame:
    """The best match in `other` of each text, if its ratio is `threshold` or more: _fuzzy_match, _fuzzy_score, and other's columns as _r_*.

    Of equal scores the least text wins. All pairs that can reach the threshold are
    compared, found by the index in operators/fuzzy.py; null texts match nothing.
    """
    need(df, on)
    need(other, on)
    pairs = similar(df.select(col(on).alias("text")), other.select(col(on).alias("text")), threshold, method)
    best = pairs.groupBy(F.col("a").alias("__l")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("b").alias("m"))).alias("__b"))
    top = best.select("__l", F.col("__b.m").alias("_fuzzy_match"), (-F.col("__b.s")).alias("_fuzzy_score"))
    right = other.select(*(col(c).alias(f"_r_{c}") for c in other.columns))
    out = df.join(top, col(on).cast("string") == F.col("__l"), "left").drop("__l")
    return out.join(right, F.col("_fuzzy_match") == F.col(f"_r_{on}").cast("string"), "left")


def asof_join(df: DataFrame, other: DataFrame, on: str, by: str, value: str) -> DataFrame:
    """For each row the last `value` of `other` at or before its `on`, within `by`: a union and one window, no range join."""
    both = df.select("*", F.lit(None).cast(other.schema[value].dataType).alias("__v"), F.lit(1).alias("__side")).unionByName(
        other.select(col(on), col(by), col(value).alias("__v"), F.lit(0).alias("__side")), allowMissingColumns=True
    )
    w = Window.partitionBy(col(by)).orderBy(col(on), "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"{value}_asof", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__v", "__side")
