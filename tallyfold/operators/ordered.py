"""Operations in a global row order without a single-task window.

Rows are dealt to ranges of the whole order key (cut at the quantiles of a bounded
sample), each range is numbered by a window of its own, and the ranges' counts give the
offsets. There are as many ranges as the rows ask for; only rows whose keys are equal in
every order column are never parted. A
frame of a few rows is then evaluated in blocks of consecutive rows, with copies of the
neighbouring rows that a block's frames reach into.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col

RN, BUCKET = "__rn", "__bucket"
#: Rows of a block in which frames are evaluated.
BLOCK = 50_000


#: Rows of the sample whose quantiles cut the ranges; ranges at most.
SAMPLE, MOST_BUCKETS, SEED = 10_000, 2_000, 42


def _pick(key: Column, cuts: Sequence[Column], low: int, high: int) -> Column:
    """How many of cuts[low:high] are below the key, plus low: a tree of comparisons."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(key > cuts[middle], _pick(key, cuts, middle + 1, high)).otherwise(_pick(key, cuts, low, middle))


def _rank(x: object) -> tuple:
    """A value's place among others as Spark orders them: null first, NaN last."""
    return (0, 0) if x is None else (2, 0) if x != x else (1, x)


def bucketed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with BUCKET, an int that does not fall in the row order. Nulls come first, as in `sort`."""
    spark = df.sparkSession
    keys = df.select(*(col(c).alias(f"k{i}") for i, c in enumerate(order)))
    # rows are drawn, not keys: a key that many rows share is drawn as often; results do not hang on the draw
    drawn = sorted(keys.orderBy(F.rand(SEED)).limit(SAMPLE).collect(), key=lambda r: tuple(map(_rank, r)))
    rows = len(drawn) if len(drawn) < SAMPLE else keys.count()
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BLOCK)), MOST_BUCKETS, max(1, rows // 1000))
    if n < 2:
        return df.withColumn(BUCKET, F.lit(0))
    cuts = list(dict.fromkeys(drawn[i * len(drawn) // n] for i in range(1, n)))
    kinds = keys.schema
    literal = lambda r: F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in kinds.fields))
    key = F.struct(*(col(c).alias(f"k{i}") for i, c in enumerate(order)))
    return df.withColumn(BUCKET, _pick(key, [literal(r) for r in cuts], 0, len(cuts)).cast("int"))


def _order(order: Sequence[str]) -> list[Column]:
    return [col(c).asc_nulls_first() for c in order]


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with RN, the row's place (from 0) in the global order."""
    rows = bucketed(df, order)
    counts = rows.groupBy(BUCKET).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(BUCKET, before.alias("__before"))  # a row for each bucket
    local = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*_order(order)))
    return rows.withColumn(RN, local).join(F.broadcast(offsets), BUCKET).withColumn(RN, (F.col(RN) - 1 + F.col("__before")).cast("long")).drop(BUCKET, "__before")


def framed(df: DataFrame, order: Sequence[str], before: int, after: int, make: Callable[[Window], dict[str, Column]], by: Sequence[str] = ()) -> DataFrame:
    """df with columns over frames that reach `before` rows back and `after` rows on; make gets the window to build them on.

    With `by` the order holds inside each group, and windows are partitioned by it.
    """
    if by:
        w = Window.partitionBy(*map(col, by)).orderBy(*_order(order))
        return df.withColumns(make(w))
    rows = numbered(df, order)
    block = F.floor(F.col(RN) / BLOCK).cast("long")
    place = F.col(RN) % BLOCK
    copies = [block]
    if before:
        copies.append(F.when(place >= BLOCK - before, block + 1))
    if after:
        copies.append(F.when(place < after, block - 1))
    rows = rows.withColumn("__block", F.explode(F.array_compact(F.array(*copies))))
    rows = rows.withColumns(make(Window.partitionBy("__block").orderBy(RN)))
    return rows.where(F.col("__block") == block).drop("__block", RN)


def running_all(df: DataFrame, order: Sequence[str], wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """df with, for each new name, the running sum, prod, max, min, count or last non-null value of a column, given as (column, how), in the global order."""
    last = lambda c: F.last(c, ignorenulls=True)
    whole = {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min, "count": F.count, "last": last}
    merge = whole | {"count": F.sum}
    rows = bucketed(df, order)
    rank = F.struct(*(x for i, o in enumerate(order) for x in (col(o).isNotNull().alias(f"{i}n"), col(o).alias(f"{i}v"))))
    items = list(wanted.items())
    total = lambda c, how: F.max_by(c, F.when(c.isNotNull(), rank)) if how == "last" else whole[how](c)
    totals = rows.groupBy(BUCKET).agg(*(total(col(c), how).alias(f"__total{i}") for i, (_, (c, how)) in enumerate(items)))
    earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(BUCKET, *(merge[how](F.col(f"__total{i}")).over(earlier).alias(f"__earlier{i}") for i, (_, (_, how)) in enumerate(items)))  # a row for each bucket
    upto = Window.partitionBy(BUCKET).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__local{i}": whole[how](col(c)).over(upto) for i, (_, (c, how)) in enumerate(items)}).join(F.broadcast(offsets), BUCKET)
    out = {}
    for i, (name, (_, how)) in enumerate(items):
        a, b = F.col(f"__local{i}"), F.col(f"__earlier{i}")
        both = {"sum": a + b, "prod": a * b, "max": F.greatest(a, b), "min": F.least(a, b), "count": a + b, "last": a}[how]
        out[name] = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)
    return rows.withColumns(out).drop(BUCKET, *(f"__{x}{i}" for i in range(len(items)) for x in ("local", "earlier")))


def running(df: DataFrame, order: Sequence[str], column: str, how: str) -> DataFrame:
    """df with __run, one running value of `running_all`."""
    return running_all(df, order, {"__run": (column, how)})


def quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float], method: str = "nearest") -> DataFrame:
    """(variable, q, value): exact quantiles of several columns from one count of their distinct values."""
    spark = df.sparkSession
    long = df.select(*(col(c).cast("double").alias(c) for c in columns)).unpivot([], [F.col(f"`{c}`") for c in columns], "variable", "v").where("v is not null")
    counts = long.groupBy("variable", "v").agg(F.count("*").alias("n"))
    totals = {r["variable"]: r["n"] for r in counts.groupBy("variable").agg(F.sum("n").alias("n")).collect()}  # a row for each column
    asked, before = [], 0
    for c in sorted(totals):
        for q in at:
            k = q * (totals[c] - 1)
            low = round(k) if method == "nearest" else int(k // 1)
            parts = [(low, 1.0)] if method == "nearest" else [(low, 1 - (k - low)), (min(low + 1, totals[c] - 1), k - low)]
            asked += [(c, float(q), before + i, w) for i, w in parts]
        before += totals[c]
    upto = running(counts, ["variable", "v"], "n", "sum").select("v", (F.col("__run") - F.col("n")).alias("first"), (F.col("__run") - 1).alias("last"))
    table = spark.createDataFrame(asked, "variable string, q double, k long, w double")
    return upto.join(F.broadcast(table), (F.col("k") >= F.col("first")) & (F.col("k") <= F.col("last"))).groupBy("variable", "q").agg(F.sum(F.col("v") * F.col("w")).alias("value"))


def order_statistics(df: DataFrame, column: str, at: Sequence[float], method: str = "nearest") -> DataFrame:
    """(q, value): exact quantiles without holding the values in one task. `nearest` takes a value, `linear` interpolates."""
    return quantiles(df.select(col(column).alias("v0")), ["v0"], at, method).select("q", "value")
