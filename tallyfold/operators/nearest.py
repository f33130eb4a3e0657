"""The k nearest donors of one-dimensional queries, by ranks and without pairs of ranges.

Donors are numbered in their global order and a running count over donors and queries
together gives each query its place among them. Its k nearest donors have ranks within k
of that place, so that a query asks for 2k ranks, and an equi-join on the rank fetches
them: one row for each asked rank, whatever lies in the donors' ranges or how far they
reach. No bucket, range or hot value is collected in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col
from tallyfold.operators.ordered import numbered, running


def nearest(queries: DataFrame, donors: DataFrame, value: str, k: int, by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Each row of `queries` with its `k` nearest `donors` in `value`, inside groups of `by`: one row for each, with the donor as a
    struct `donor`, `distance`, and `near`, its place from 1. Of equal distances the donor that comes first by (value, ties) is nearer.

    A query without a donor in its group, and queries and donors whose `value` is null, are left out.
    Rows of `queries` need not differ; equal values ask once.
    """
    order = [*by, value, *ties]
    given = numbered(donors.where(col(value).isNotNull()).select(*(col(c).alias(c) for c in donors.columns)), order)
    given = given.select(F.struct(*(col(c) for c in donors.columns)).alias("donor"), F.col("__rn").alias("__rank"))
    keys = [*by, value]
    asked = queries.where(col(value).isNotNull()).select(*map(col, keys)).distinct()
    marks = asked.select(*map(col, keys), F.lit(0).alias("__count"), F.lit(1).alias("__asks"))
    counts = donors.where(col(value).isNotNull()).groupBy(*map(col, keys)).agg(F.count("*").alias("__count")).withColumn("__asks", F.lit(0))
    placed = running(marks.unionByName(counts), [*keys, "__asks"], "__count", "sum").where("__asks = 1")
    ranks = F.explode(F.sequence(F.col("__run") - k, F.col("__run") + (k - 1)))
    wide = placed.select(*(col(c).alias(f"__k{i}") for i, c in enumerate(keys)), ranks.alias("__rank")).join(given, "__rank")
    for i, c in enumerate(by):
        wide = wide.where(F.col(f"__k{i}").eqNullSafe(F.col("donor")[c]))
    # rank runs against the order below a query and along it above: the one that comes first is nearer of equal distances
    wide = wide.withColumn("distance", F.abs(F.col("donor")[value] - F.col(f"__k{len(by)}")))
    own = [f"__k{i}" for i in range(len(keys))]
    near = wide.withColumn("near", F.row_number().over(Window.partitionBy(*own).orderBy("distance", "__rank"))).where(F.col("near") <= k).drop("__rank")
    match = [col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]
    return queries.join(near, match).drop(*own)
