"""Aggregation, reshaping, windows over groups, and tabular reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions import dsl
from tallyfold.functions.exprs import col, count_if, n_unique
from tallyfold.operators.ordered import RN, numbered, quantiles
from tallyfold.operators.transform import need, numeric_columns
from tallyfold.stats.frames import few

#: Columns that a wide table may get from the levels of one.
MOST_COLUMNS = 10_000


def aggregator(how: str, c: Column, order: Sequence[str] = ()) -> Column:
    """One aggregate by its name. The sum of no values is 0; first and last are by `order` and may be null."""
    key = F.struct(*(col(o) for o in order)) if order else None
    return {
        "mean": lambda: F.avg(c), "sum": lambda: F.coalesce(F.sum(c), F.lit(0)), "min": lambda: F.min(c), "max": lambda: F.max(c),
        "std": lambda: F.stddev_samp(c), "sd": lambda: F.stddev_samp(c), "var": lambda: F.var_samp(c), "median": lambda: F.median(c), "p50": lambda: F.median(c),
        "count": lambda: F.count(c), "n": lambda: F.count(c), "nunique": lambda: n_unique(c),
        "approx_nunique": lambda: F.approx_count_distinct(c), "approx_median": lambda: F.percentile_approx(c, F.lit(0.5)),
        "first": lambda: F.min_by(F.struct(c.alias("v")), key).getField("v"), "last": lambda: F.max_by(F.struct(c.alias("v")), key).getField("v"),
    }[how]()


def group_by(df: DataFrame, by: Sequence[str], aggs: Sequence[tuple[str, str] | tuple[str, str, str]], order: Sequence[str] = ()) -> DataFrame:
    """(column, function[, alias]) for each aggregate; null is a group; sorted by the keys."""
    need(df, *by, *(a[0] for a in aggs))
    columns = [aggregator(a[1], col(a[0]), order).alias(a[2] if len(a) > 2 else f"{a[0]}_{a[1]}") for a in aggs]
    return df.groupBy(*map(col, by)).agg(*columns).orderBy(*(col(c).asc_nulls_first() for c in by))


def collapse(df: DataFrame, how: str, columns: Sequence[str], by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """One statistic of the columns, under their own names."""
    need(df, *columns, *by)
    aggs = [aggregator(how, col(c), order).alias(c) for c in columns]
    return df.groupBy(*map(col, by)).agg(*aggs).orderBy(*(col(c).asc_nulls_first() for c in by)) if by else df.agg(*aggs)


def pivot(df: DataFrame, value: str, by: str, over: Sequence[str] = (), how: str = "first", order: Sequence[str] = ()) -> DataFrame:
    """Long to wide. Without `over` all other columns are the index. count counts rows, null values included."""
    need(df, value, by, *over)
    index = list(over) or [c for c in df.columns if c not in (value, by)]
    values = [r[0] for r in few(df.select(col(by)).distinct().orderBy(col(by).asc_nulls_first()), f"levels of {by}", MOST_COLUMNS)]
    agg = F.count(F.lit(1)) if how == "count" else aggregator(how, col(value), order or [value])
    return df.groupBy(*map(col, index)).pivot(by, values).agg(agg)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Wide to long; nulls stay."""
    need(df, *ids, *values)
    return df.unpivot([col(c) for c in ids], [col(c) for c in values], var_name, value_name)


def reshape_long(df: DataFrame, stub: str, i: Sequence[str], j: str) -> DataFrame:
    """Columns that begin with `stub` become rows: j is the rest of the name, the value is named stub. Other columns are dropped."""
    need(df, *i)
    values = [c for c in df.columns if c.startswith(stub) and c not in i]
    if not values:
        raise KeyError(f"no column begins with {stub}")
    long = melt(df, i, values, j, stub)
    return long.withColumn(j, F.substring(col(j), len(stub) + 1, 1 << 20))


def reshape_wide(df: DataFrame, values: Sequence[str], i: Sequence[str], j: str, order: Sequence[str] = ()) -> DataFrame:
    """A column `<value><j>` (several values: `<value>_<j>`) for each level of j; of several rows the first."""
    need(df, *values, *i, j)
    levels = [r[0] for r in few(df.select(col(j)).distinct().orderBy(col(j).asc_nulls_first()), f"levels of {j}", MOST_COLUMNS)]
    sep = "_" if len(values) > 1 else ""
    key = F.struct(*(col(o) for o in order)) if order else None

    def cell(v: str, x: object) -> Column:
        here = col(j).eqNullSafe(F.lit(x))
        return F.min_by(col(v), F.when(here, key)) if key is not None else F.min(F.when(here, col(v)))

    cells = [cell(v, x).alias(f"{v}{sep}{x}") for v in values for x in levels]
    return df.groupBy(*map(col, i)).agg(*cells)


def egen(df: DataFrame, new: str, how: str, columns: Sequence[str], by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """A group's statistic beside each row (mean sum min max median count), rank (ordinal), group (dense), rowtotal or rowmean.

    A statistic is aggregated, then joined, so that a group that holds most rows is not one task.
    """
    need(df, *columns, *by)
    if how == "rowtotal":
        return df.withColumn(new, sum((F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0)))
    if how == "rowmean":
        total = sum((F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
        n = sum((col(c).isNotNull().cast("int") for c in columns), F.lit(0))
        return df.withColumn(new, F.when(n > 0, total / n))
    c = columns[0]
    if how == "rank":
        if not by:
            ranked = numbered(df.where(col(c).isNotNull()), [c, *order])
            nulls = df.where(col(c).isNull()).withColumn(new, F.lit(None).cast("long"))
            return ranked.withColumn(new, F.col(RN) + 1).drop(RN).unionByName(nulls)
        w = Window.partitionBy(*map(col, by)).orderBy(col(c).asc_nulls_last(), *(col(o) for o in order))
        return df.withColumn(new, F.when(col(c).isNotNull(), F.row_number().over(w)).cast("long"))
    if how == "group":
        from tallyfold.operators.transform import encode

        return encode(df, c, new)
    stats = df.groupBy(*(col(b).alias(f"__b{k}") for k, b in enumerate(by))).agg(aggregator(how, col(c)).alias(new))
    if not by:
        return df.crossJoin(F.broadcast(stats))
    on = [col(b).eqNullSafe(F.col(f"__b{k}")) for k, b in enumerate(by)]
    return df.join(stats, on, "left").drop(*(f"__b{k}" for k in range(len(by))))


def missing_pattern(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """variable, missing, percent; and a last row of complete cases."""
    columns = list(columns) or df.columns
    need(df, *columns)
    complete = col(columns[0]).isNotNull()
    for c in columns[1:]:
        complete = complete & col(c).isNotNull()
    wide = df.agg(F.count("*").alias("n"), count_if(complete).alias("complete"), *(count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)))
    cells = [F.struct(F.lit(c).alias("variable"), F.col(f"m{i}").alias("missing"), (100 * F.col(f"m{i}") / F.col("n")).alias("percent")) for i, c in enumerate(columns)]
    cells.append(F.struct(F.lit("complete cases").alias("variable"), F.col("complete").alias("missing"), (100 * F.col("complete") / F.col("n")).alias("percent")))
    return wide.select(F.inline(F.array(*cells)))


def assert_rule(df: DataFrame, expression: str) -> DataFrame:
    """checked, failed and passed; rows for which the condition is null do not fail."""
    condition = dsl.expression(expression, df)
    return df.agg(F.count("*").alias("checked"), count_if(~condition).alias("failed")).withColumn("passed", F.col("failed") == 0)


def validate(df: DataFrame, column: str, rules: Mapping[str, object]) -> DataFrame:
    """rule, failed, passed for notnull, unique, positive, nonneg, min, max, between, oneof and regex."""
    need(df, column)
    c = col(column)
    tests = {
        "notnull": lambda _: c.isNull(), "positive": lambda _: c <= 0, "nonneg": lambda _: c < 0, "min": lambda v: c < F.lit(v), "max": lambda v: c > F.lit(v),
        "between": lambda v: (c < F.lit(v[0])) | (c > F.lit(v[1])), "oneof": lambda v: ~c.isin(list(v)), "regex": lambda v: ~c.cast("string").rlike(v),
    }
    aggs = [count_if(tests[r](v)).alias(f"f{i}") if r != "unique" else (F.count(c) - F.count_distinct(c)).alias(f"f{i}") for i, (r, v) in enumerate(rules.items())]
    cells = [F.struct(F.lit(r).alias("rule"), F.col(f"f{i}").alias("failed"), (F.col(f"f{i}") == 0).alias("passed")) for i, r in enumerate(rules)]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summarize(df: DataFrame, columns: Sequence[str] = (), method: str = "nearest") -> DataFrame:
    """n, mean, sd, min, quartiles and max of each numeric column; nulls are left out."""
    columns = list(columns) or numeric_columns(df)
    need(df, *columns)
    moments = {"n": F.count, "mean": F.avg, "sd": F.stddev_samp, "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")}
    wide = df.agg(*(f(col(c)).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in moments.items()))
    base = wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("variable"), *(F.col(f"{k}_{i}").alias(k) for k in moments)) for i, c in enumerate(columns)))))
    parts = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
    q = quantiles(df, columns, [p for _, p in parts], method).groupBy("variable").agg(*(F.max(F.when(F.col("q") == p, F.col("value"))).alias(n) for n, p in parts))
    return base.join(F.broadcast(q), "variable", "left")


def tabulate(df: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """value, count and percent of all rows; the `limit` most frequent. Null is a level."""
    need(df, column)
    total = df.agg(F.count("*").alias("__n"))
    counts = df.groupBy(col(column).alias("value")).count()
    return counts.crossJoin(F.broadcast(total)).select("value", "count", F.round(100 * F.col("count") / F.col("__n"), 1).alias("percent")).orderBy(F.desc("count"), F.col("value").asc_nulls_first()).limit(limit)


def corr(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """var1, var2 and r of all pairs, over rows where no column is null; undefined is 0. One pass."""
    columns = list(columns) or numeric_columns(df)
    rows = df.select(*(col(c).cast("double").alias(c) for c in columns)).dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = rows.agg(*(F.coalesce(F.nanvl(F.corr(col(a), col(b)), F.lit(0.0)), F.lit(0.0)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))))


def average_rank(df: DataFrame, column: str, new: str) -> DataFrame:
    """df (rows with a value) with ranks from 1 on; ties share the mean. Ranks come from the counts of distinct values, not from one sorted task."""
    from tallyfold.operators.ordered import running

    c = col(column)
    counts = df.where(c.isNotNull()).groupBy(c.alias("__v")).agg(F.count("*").alias("__n"))
    ranks = running(counts, ["__v"], "__n", "sum").select("__v", (F.col("__run") - (F.col("__n") - 1) / 2).alias(new), F.col("__n").alias(f"{new}_ties"))
    return df.join(ranks, c == F.col("__v")).drop("__v")


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """var1, var2, n and rho of each pair, over the rows where both have a value."""
    need(df, *columns)
    rows = df.select(*(col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    holes = rows.agg(*(count_if(F.col(c).isNull()).alias(c) for c in rows.columns)).first()
    if not any(holes):  # the ranks of a column are the same in all pairs
        for i in range(len(columns)):
            rows = average_rank(rows, f"v{i}", f"r{i}")
        wide = rows.agg(F.count("*").alias("n"), *(F.corr(f"r{i}", f"r{j}").alias(f"p{i}_{j}") for i, j in pairs))
        cells = [F.struct(F.lit(columns[i]).alias("var1"), F.lit(columns[j]).alias("var2"), F.col("n"), F.col(f"p{i}_{j}").alias("rho")) for i, j in pairs]
        return wide.select(F.inline(F.array(*cells)))
    parts = []
    for i, j in pairs:
        both = rows.select(F.col(f"v{i}").alias("a"), F.col(f"v{j}").alias("b")).where("a is not null and b is not null")
        ranked = average_rank(average_rank(both, "a", "ra"), "b", "rb")
        parts.append(ranked.agg(F.lit(columns[i]).alias("var1"), F.lit(columns[j]).alias("var2"), F.count("*").alias("n"), F.corr("ra", "rb").alias("rho")))
    return _union(parts)


def profile(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """A row for each numeric column: missing, unique, mean, std, min, median, max, skew, excess kurtosis, zeros, negatives. One pass."""
    columns = list(columns) or numeric_columns(df)
    need(df, *columns)
    stats = {
        "missing": lambda c: count_if(c.isNull()), "unique": n_unique, "mean": F.avg, "std": F.stddev_samp, "min": lambda c: F.min(c).cast("double"), "median": F.median, "max": lambda c: F.max(c).cast("double"),
        "skew": F.skewness, "kurtosis": F.kurtosis, "zeros": lambda c: count_if(c == 0), "negatives": lambda c: count_if(c < 0),
    }
    wide = df.agg(*(f(col(c)).alias(f"{s}_{i}") for i, c in enumerate(columns) for s, f in stats.items()))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("variable"), *(F.col(f"{s}_{i}").alias(s) for s in stats)) for i, c in enumerate(columns)))))


def data_dictionary(df: DataFrame) -> DataFrame:
    """name, type, missing, percent missing, unique, and notes: the mean and range of numbers, the three most frequent texts."""
    from tallyfold.operators.transform import describe

    notes = []
    for c in df.columns:
        if c in numeric_columns(df):
            notes.append(df.agg(F.lit(c).alias("name"), F.format_string("mean %.4g, range %.4g to %.4g", F.avg(col(c)), F.min(col(c)).cast("double"), F.max(col(c)).cast("double")).alias("notes")))
        else:
            top = df.where(col(c).isNotNull()).groupBy(col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(3)
            notes.append(top.agg(F.lit(c).alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "v"))), lambda s: s["v"]), ", ").alias("notes")))
    total = F.col("non_null") + F.col("missing")
    base = describe(df).select(F.col("column").alias("name"), "type", "missing", F.round(100 * F.col("missing") / total, 1).alias("percent_missing"), "unique")
    return base.join(_union(notes), "name", "left")


def tabstat(df: DataFrame, columns: Sequence[str], stats: Sequence[str] = ("mean", "sd", "min", "max", "n"), by: str | None = None) -> DataFrame:
    """A row for each variable (and group) with the statistics as columns."""
    need(df, *columns)
    keys = [col(by).alias(by)] if by else []
    wide = df.groupBy(*keys).agg(*(aggregator(s, col(c)).cast("double").alias(f"{s}_{i}") for i, c in enumerate(columns) for s in stats))
    cells = F.array(*(F.struct(F.lit(c).alias("variable"), *(F.col(f"{s}_{i}").alias(s) for s in stats)) for i, c in enumerate(columns)))
    return wide.select(*([col(by)] if by else []), F.inline(cells))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts and row percents of all cells with margins (null stands for a total); rows with null are left out."""
    need(df, row, column)
    rows = df.where(col(row).isNotNull() & col(column).isNotNull()).select(col(row).alias("row"), col(column).alias("col"))
    cells = rows.cube("row", "col").agg(F.count("*").alias("n"))
    totals = cells.where("col is null").select(F.col("row").alias("__row"), F.col("n").alias("__total"))
    return cells.join(F.broadcast(totals), F.col("row").eqNullSafe(F.col("__row"))).select("row", "col", "n", (100 * F.col("n") / F.col("__total")).alias("row_percent"))


def smooth_ma(df: DataFrame, column: str, window: int, order: Sequence[str], new: str | None = None) -> DataFrame:
    """Centred moving average; the edges shrink."""
    from tallyfold.operators.transform import rolling

    return rolling(df, column, window, "mean", order, new or f"{column}_ma", center=True)


def smooth_exp(df: DataFrame, column: str, alpha: float, order: Sequence[str], by: Sequence[str] = (), new: str | None = None) -> DataFrame:
    """s(t) = alpha * y(t) + (1 - alpha) * s(t - 1), from the first value on; a series is one group of `by`."""
    need(df, column, *order, *by)
    items = F.array_sort(F.collect_list(F.struct(*(col(o) for o in order), col(column).cast("double").alias("__y"), F.struct(*(col(c) for c in df.columns)).alias("__row"))))
    series = df.groupBy(*(col(b).alias(f"__b{i}") for i, b in enumerate(by))).agg(items.alias("xs"))
    step = lambda acc, x: F.struct(
        F.when(acc["s"].isNull(), x["__y"]).otherwise(alpha * x["__y"] + (1 - alpha) * acc["s"]).alias("s"),
        F.concat(acc["out"], F.array(F.when(acc["s"].isNull(), x["__y"]).otherwise(alpha * x["__y"] + (1 - alpha) * acc["s"]))).alias("out"),
    )
    start = F.struct(F.lit(None).cast("double").alias("s"), F.array().cast("array<double>").alias("out"))
    done = series.select(F.inline(F.arrays_zip(F.transform("xs", lambda x: x["__row"]).alias("row"), F.aggregate("xs", start, step)["out"].alias("s"))).alias("row", "s"))
    return done.select("row.*", F.col("s").alias(new or f"{column}_exp"))
