"""Mergeable sketches: approximate distinct counts (HyperLogLog) and quantiles (KLL) of groups.

A sketch is a binary column of bounded size. Tables of sketches can be stored, appended
and merged to coarser groups, so that a rollup reads sketches and not the rows again.
They are an opt-in: all other operators are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.exprs import col
from tallyfold.operators.transform import need

#: Suffixes of the columns that hold sketches.
HLL, KLL, ROWS = "__hll", "__kll", "rows"


def distinct_error(lg: int = 12) -> float:
    """The relative standard error of a distinct count with 2^lg registers, after merging."""
    return 1.04 / math.sqrt(2**lg)


def rank_error(k: int = 200) -> float:
    """The rank error of a quantile, as a share of the rows, that 99 % of the estimates keep (Karnin, Lang and Liberty's sketch as DataSketches builds it)."""
    return 2.296 / k**0.9021  # fixed values: the library's published fit of the single-sided error


def _item(df: DataFrame, name: str) -> Column:
    """A value that the distinct sketch takes: whole numbers and texts as they are, others as text (-0.0 as 0.0)."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
        return col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (col(name) + F.lit(0.0)).cast("string")
    return col(name).cast("string")


def sketched(df: DataFrame, by: Sequence[str] = (), distinct: Sequence[str] = (), quantiles: Sequence[str] = (), lg: int = 12, k: int = 200) -> DataFrame:
    """A row for each group: its keys, rows, and `<column>__hll` and `<column>__kll`.

    Null values enter no sketch, NaN no quantile; null is a group. Tasks send sketches, not
    rows, so a group that holds most rows costs its task no more than others.
    """
    need(df, *by, *distinct, *quantiles)
    if not distinct and not quantiles:
        raise ValueError("name columns for distinct or quantiles")
    made = [F.hll_sketch_agg(_item(df, c), F.lit(lg)).alias(c + HLL) for c in distinct]
    number = lambda c: F.when(~F.isnan(col(c).cast("double")), col(c).cast("double"))
    made += [F.kll_sketch_agg_double(number(c), F.lit(k)).alias(c + KLL) for c in quantiles]
    return df.groupBy(*map(col, by)).agg(F.count(F.lit(1)).alias(ROWS), *made)


def _sketches(df: DataFrame, end: str) -> list[str]:
    return [c for c in df.columns if c.endswith(end)]


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of the coarser groups `by`; a table of other columns raises."""
    need(sketches, *by, ROWS)
    if not _sketches(sketches, HLL) and not _sketches(sketches, KLL):
        raise ValueError("the table holds no sketches")
    both = [F.hll_union_agg(col(c), F.lit(True)).alias(c) for c in _sketches(sketches, HLL)] + [F.kll_merge_agg_double(col(c)).alias(c) for c in _sketches(sketches, KLL)]
    return sketches.groupBy(*map(col, by)).agg(F.coalesce(F.sum(ROWS), F.lit(0)).alias(ROWS), *both)


def estimated(sketches: DataFrame, at: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The other columns, `<column>_distinct`, and `<column>_q<100 q>` for each quantile; null where a sketch saw no value."""
    if any(not 0 <= q <= 1 for q in at):
        raise ValueError("quantiles lie in 0 to 1")
    out = {c.removesuffix(HLL) + "_distinct": F.hll_sketch_estimate(col(c)) for c in _sketches(sketches, HLL)}
    for c in _sketches(sketches, KLL):
        some = F.kll_sketch_get_n_double(col(c)) > 0
        out |= {f"{c.removesuffix(KLL)}_q{100 * q:g}": F.when(some, F.kll_sketch_get_quantile_double(col(c), F.lit(float(q)))) for q in at}
    return sketches.select(*(col(c) for c in sketches.columns if not c.endswith((HLL, KLL))), *(v.alias(n) for n, v in out.items()))
