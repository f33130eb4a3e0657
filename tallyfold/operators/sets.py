"""Set operations, sampling and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col
from tallyfold.operators.transform import need


def sample(df: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Exactly n rows, or a fraction of them (one at least), without replacement."""
    if n is None:
        n = max(1, int(df.count() * fraction))
    return df.orderBy(F.rand(seed)).limit(n)


def sample_stratified(df: DataFrame, by: str, n: int | None = None, fraction: float | None = None, seed: int = 42, order: Sequence[str] = ()) -> DataFrame:
    """n rows (or as many as there are) or a fraction (one at least) of each stratum; rows of a null stratum are lost."""
    need(df, by)
    rows = df.where(col(by).isNotNull())
    rank = F.row_number().over(Window.partitionBy(col(by)).orderBy(F.xxhash64(F.lit(seed), *(col(c) for c in order or df.columns))))
    sizes = rows.groupBy(col(by).alias("__s")).agg(F.count("*").alias("__n"))
    limit = F.lit(n) if n is not None else F.greatest(F.lit(1), F.floor(F.col("__n") * fraction))
    return rows.withColumn("__r", rank).join(sizes, col(by) == F.col("__s")).where(F.col("__r") <= limit).drop("__r", "__s", "__n")


def duplicates(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """rows, unique and duplicates, on the columns (all, if none are named)."""
    need(df, *columns)
    groups = df.groupBy(*map(col, columns or df.columns)).agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count("*").alias("unique")).withColumn("duplicates", F.col("rows") - F.col("unique"))


def drop_duplicates(df: DataFrame, columns: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """The first row, in `order`, of each combination; min_by is merged before the shuffle, so a frequent one is no burden."""
    need(df, *columns)
    if not columns or set(columns) >= set(df.columns):
        return df.distinct()
    row = F.struct(*(col(c) for c in df.columns))
    key = F.struct(*(col(c) for c in [*order, *(c for c in df.columns if c not in order)]))
    firsts = df.groupBy(*(col(c).alias(f"__k{i}") for i, c in enumerate(columns))).agg(F.min_by(row, key).alias("__row"))
    return firsts.select(*(F.col("__row").getField(c).alias(c) for c in df.columns))


def unique(df: DataFrame, column: str) -> DataFrame:
    need(df, column)
    return df.select(col(column)).distinct().orderBy(col(column).asc_nulls_first())


def append(df: DataFrame, other: DataFrame, force: bool = False) -> DataFrame:
    """UNION ALL by name. Other columns are refused, or with `force` filled with null."""
    if set(df.columns) != set(other.columns) and not force:
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(other.columns))}")
    return df.unionByName(other, allowMissingColumns=force)
