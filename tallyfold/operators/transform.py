"""Projection, filters, and row and column transforms. Each takes a DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions import dsl
from tallyfold.functions.exprs import clip, col, count_if, java_format, n_unique, strip
from tallyfold.operators.ordered import RN, framed, numbered, order_statistics, running

TYPES = {"int": "long", "float": "double", "str": "string", "bool": "boolean", "date": "date", "datetime": "timestamp_ntz"}


def need(df: DataFrame, *columns: str) -> None:
    """Raises for columns that df does not have."""
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.FloatType, T.DoubleType))]


def describe(df: DataFrame) -> DataFrame:
    """A row for each column: type, non-null, missing and unique values (null counts as a value). One pass."""
    wide = df.agg(*(x for i, c in enumerate(df.columns) for x in (F.count(col(c)).alias(f"a{i}"), count_if(col(c).isNull()).alias(f"b{i}"), n_unique(col(c)).alias(f"c{i}"))))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"a{i}").alias("non_null"), F.col(f"b{i}").alias("missing"), F.col(f"c{i}").alias("unique")) for i, (c, t) in enumerate(df.dtypes)))
    return wide.select(F.inline(rows))


def head(df: DataFrame, n: int = 10, order: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*(col(c).asc_nulls_first() for c in order)).limit(n) if order else df.limit(n)


def tail(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    last = df.orderBy(*(col(c).desc_nulls_last() for c in order)).limit(n)
    return last.orderBy(*(col(c).asc_nulls_first() for c in order))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which the expression is true."""
    return df.filter(dsl.expression(expression, df))


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    need(df, *columns)
    return df.select(*map(col, columns))


def derive(df: DataFrame, new: str, expression: str) -> DataFrame:
    return df.withColumn(new, dsl.expression(expression, df))


def drop_null(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Rows without null in the columns (all, if none are named); NaN stays."""
    need(df, *columns)
    out = df
    for c in columns or df.columns:
        out = out.filter(col(c).isNotNull())
    return out


def sort(df: DataFrame, columns: Sequence[str], desc: bool = False) -> DataFrame:
    """Nulls come first either way."""
    need(df, *columns)
    return df.orderBy(*(col(c).desc_nulls_first() if desc else col(c).asc_nulls_first() for c in columns))


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    need(df, old)
    if new in df.columns:
        raise KeyError(f"there is a column {new} already")
    return df.withColumnRenamed(old, new)


def _is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def replace(df: DataFrame, column: str, old: object, new: object) -> DataFrame:
    """Equal values become `new`; a numeric column widens to double."""
    need(df, column)
    if _is_number(df, column):
        c = col(column).cast("double")
        return df.withColumn(column, F.when(c == float(old), F.lit(float(new))).otherwise(c))
    return df.withColumn(column, F.when(col(column) == F.lit(old), F.lit(new)).otherwise(col(column)))


def encode(df: DataFrame, column: str, new: str | None = None) -> DataFrame:
    """Codes 0, 1, ... of the sorted distinct values; null sorts first and has a code if there is one."""
    need(df, column)
    codes = numbered(df.select(col(column).alias("__v")).distinct(), ["__v"]).withColumnRenamed(RN, "__code")
    return df.join(codes, col(column).eqNullSafe(F.col("__v")), "left").drop("__v").withColumnRenamed("__code", new or f"{column}_encoded")


def recode(df: DataFrame, column: str, mapping: Mapping[object, object]) -> DataFrame:
    """All values are tested as they were; where several match, the last mapping wins. Other values stay."""
    need(df, column)
    out: Column = col(column)
    if _is_number(df, column) and any(not isinstance(v, (int, float)) for v in mapping.values()):
        out = out.cast("string")
    for old, new in mapping.items():
        out = F.when(col(column) == F.lit(old), F.lit(new)).otherwise(out)
    return df.withColumn(column, out)


def fill_null(df: DataFrame, column: str, strategy: str, value: object = None, order: Sequence[str] = ()) -> DataFrame:
    """mean, median, mode (the least of ties), value, forward or backward (these two in `order`)."""
    need(df, column)
    c = col(column)
    if strategy == "value":
        return df.withColumn(column, F.coalesce(c, F.lit(value)))
    if strategy in ("forward", "backward"):
        if strategy == "forward":
            return running(df, order, column, "last").withColumn(column, F.col("__run")).drop("__run")
        return _backward(df, column, order)
    if strategy == "median":
        one = order_statistics(df, column, [0.5], "linear").select(F.col("value").alias("__fill"))
    elif strategy == "mode":
        top = df.where(c.isNotNull()).groupBy(c.alias("__fill")).count().orderBy(F.desc("count"), F.asc("__fill")).limit(1)
        one = top.select("__fill")
    else:
        one = df.agg(F.avg(c).alias("__fill"))
    one = one.agg(F.first("__fill").alias("__fill"))  # one row, also without values
    return df.crossJoin(F.broadcast(one)).withColumn(column, F.coalesce(c, F.col("__fill"))).drop("__fill")


def _backward(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """The next value that is not null: the forward fill in the reversed order, whose keys are counted from the end."""
    rows = numbered(df, order).withColumn("__back", -F.col(RN)).drop(RN)
    return running(rows, ["__back"], column, "last").withColumn(column, F.col("__run")).drop("__run", "__back")


def cast(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Strict casts: a value that has no meaning in the type is an error."""
    need(df, *pairs)
    return df.withColumns({c: col(c).cast(TYPES.get(t, t)) for c, t in pairs.items()})


def bin_values(df: DataFrame, column: str, bins: int, new: str | None = None, labels: Sequence[str] = (), equal_freq: bool = False) -> DataFrame:
    """Equal-width or equal-frequency bins (lo, hi]; the least value belongs to the first, the greatest to the last."""
    need(df, column)
    if equal_freq:
        got = {r["q"]: r["value"] for r in order_statistics(df, column, [i / bins for i in range(bins + 1)], "linear").collect()}
        edges = [got[i / bins] for i in range(bins + 1)] if got else []
    else:
        low, high = df.agg(F.min(col(column)).cast("double"), F.max(col(column)).cast("double")).first()
        edges = [] if low is None else [low + (high - low) * i / bins for i in range(bins)] + [high]
    out = F.lit(None).cast("string")
    for i in range(bins - 1, -1, -1):
        if edges:
            text = labels[i] if i < len(labels) else f"({edges[i]:.4g}, {edges[i + 1]:.4g}]"
            inside = (col(column) <= F.lit(edges[i + 1])) if i + 1 < bins else col(column).isNotNull()
            out = F.when(inside, F.lit(text)).otherwise(out)
    return df.withColumn(new or f"{column}_bin", out)


def anonymize(df: DataFrame, columns: Sequence[str], method: str = "mask", noise_sd: float = 1.0, seed: int = 42) -> DataFrame:
    """mask keeps the first and the last character, hash is SHA-256, noise is Gaussian, drop drops."""
    need(df, *columns)
    if method == "drop":
        return df.drop(*columns)
    out = df
    for i, c in enumerate(columns):
        s, n = col(c).cast("string"), F.char_length(col(c).cast("string"))
        masked = F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(s, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(s, -1, 1)))
        out = out.withColumn(c, {"mask": masked, "hash": F.sha2(s, 256), "noise": col(c) + F.randn(seed + i) * noise_sd}[method])
    return out


def winsor(df: DataFrame, column: str, p: float = 0.05, new: str | None = None) -> DataFrame:
    """Values outside the p and 1 - p quantiles (nearest) become these."""
    need(df, column)
    q = order_statistics(df, column, [p, 1 - p]).agg(F.min("value").alias("__low"), F.max("value").alias("__high"))
    return df.crossJoin(F.broadcast(q)).withColumn(new or f"{column}_w", clip(col(column).cast("double"), F.col("__low"), F.col("__high"))).drop("__low", "__high")


def _scaled(df: DataFrame, columns: Sequence[str], prefix: str | None, suffix: str, stats, make) -> DataFrame:
    need(df, *columns)
    one = df.agg(*(s(col(c)).cast("double").alias(f"__{k}{i}") for i, c in enumerate(columns) for k, s in enumerate(stats)))
    out = df.crossJoin(F.broadcast(one))
    for i, c in enumerate(columns):
        a, b = F.col(f"__0{i}"), F.col(f"__1{i}")
        out = out.withColumn(f"{prefix}{c}" if prefix else f"{c}{suffix}", make(col(c), a, b))
    return out.drop(*one.columns)


def standardize(df: DataFrame, columns: Sequence[str], prefix: str | None = None) -> DataFrame:
    return _scaled(df, columns, prefix, "_z", (F.avg, F.stddev_samp), lambda x, m, s: (x - m) / F.greatest(s, F.lit(1e-10)))


def normalize(df: DataFrame, columns: Sequence[str], prefix: str | None = None) -> DataFrame:
    return _scaled(df, columns, prefix, "_norm", (F.min, F.max), lambda x, a, b: (x - a) / F.greatest(b - a, F.lit(1e-10)))


def datetime_extract(df: DataFrame, column: str, part: str, new: str | None = None) -> DataFrame:
    """year, month, day, hour, minute, weekday (ISO, Monday is 1) or quarter."""
    need(df, column)
    c = col(column)
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "weekday": lambda x: F.weekday(x) + 1, "quarter": F.quarter}
    return df.withColumn(new or f"{column}_{part}", parts[part](c).cast("long"))


_MICROS = {"seconds": 1e6, "minutes": 6e7, "hours": 3.6e9, "days": 8.64e10}


def datetime_diff(df: DataFrame, a: str, b: str, unit: str = "days", new: str | None = None) -> DataFrame:
    """a - b in the unit, in double."""
    need(df, a, b)
    return df.withColumn(new or f"{a}_{b}_{unit}", F.timestamp_diff("MICROSECOND", col(b), col(a)) / F.lit(_MICROS[unit]))


def datetime_format(df: DataFrame, column: str, pattern: str, new: str | None = None) -> DataFrame:
    need(df, column)
    return df.withColumn(new or f"{column}_fmt", F.date_format(col(column), java_format(pattern)))


def datetime_parse(df: DataFrame, column: str, pattern: str, new: str | None = None) -> DataFrame:
    """Text that does not fit the pattern is null."""
    need(df, column)
    return df.withColumn(new or f"{column}_dt", F.try_to_timestamp(col(column), F.lit(java_format(pattern))).cast("timestamp_ntz"))


def datetime_shift(df: DataFrame, column: str, n: int, unit: str, new: str | None = None) -> DataFrame:
    need(df, column)
    unit = unit.lower().rstrip("s")
    days, hours, minutes, seconds = (n * (unit == u) for u in ("day", "hour", "minute", "second"))
    days = n * 7 if unit == "week" else n if unit not in ("hour", "minute", "second") else days
    return df.withColumn(new or f"{column}_shift", col(column).cast("timestamp_ntz") + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds)))


def regex_extract(df: DataFrame, column: str, pattern: str, new: str | None = None, group: int | None = None) -> DataFrame:
    """The first group if the pattern has one, else the match; null without a match."""
    import re

    need(df, column)
    g = group if group is not None else min(1, re.compile(pattern).groups)
    return df.withColumn(new or f"{column}_extract", F.when(col(column).rlike(pattern), F.regexp_extract(col(column), pattern, g)))


def regex_replace(df: DataFrame, column: str, pattern: str, by: str, new: str | None = None) -> DataFrame:
    need(df, column)
    return df.withColumn(new or column, F.regexp_replace(col(column), pattern, by))


def regex_match(df: DataFrame, column: str, pattern: str, new: str | None = None) -> DataFrame:
    need(df, column)
    return df.withColumn(new or f"{column}_match", F.coalesce(col(column).rlike(pattern), F.lit(False)).cast("tinyint"))


def regex_split(df: DataFrame, column: str, pattern: str, new: str | None = None) -> DataFrame:
    """An array of the parts."""
    need(df, column)
    return df.withColumn(new or f"{column}_split", F.split(col(column), pattern))


def decode(df: DataFrame, codes: str, labels: str, new: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """The label that stands beside each code; of several the last in `order`."""
    need(df, codes, labels)
    key = F.struct(*(col(c) for c in order)) if order else col(labels)
    known = df.where(col(codes).isNotNull()).groupBy(col(codes).alias("__code")).agg(F.max_by(col(labels), key).alias("__label"))
    return df.join(known, col(codes) == F.col("__code"), "left").withColumn(new or f"{codes}_label", F.col("__label")).drop("__code", "__label")


def split_text(df: DataFrame, column: str, sep: str = " ", prefix: str | None = None, parts: int | None = None) -> DataFrame:
    """Columns prefix1, prefix2, ... of the parts between literal separators; as many as the longest has."""
    import re

    need(df, column)
    pieces = F.split(col(column), "\\Q" + sep + "\\E" if re.escape(sep) != sep else sep)
    k = parts or df.agg(F.max(F.size(pieces))).first()[0] or 0
    return df.withColumns({f"{prefix or column}{i + 1}": F.get(pieces, F.lit(i)) for i in range(k)})


def text_trim(df: DataFrame, column: str, new: str | None = None) -> DataFrame:
    need(df, column)
    return df.withColumn(new or column, strip(col(column)))


def text_upper(df: DataFrame, column: str, new: str | None = None) -> DataFrame:
    need(df, column)
    return df.withColumn(new or column, F.upper(col(column)))


def text_lower(df: DataFrame, column: str, new: str | None = None) -> DataFrame:
    need(df, column)
    return df.withColumn(new or column, F.lower(col(column)))


def text_replace(df: DataFrame, column: str, old: str, by: str, new: str | None = None) -> DataFrame:
    """`old` is a regular expression."""
    return regex_replace(df, column, old, by, new)


def lag(df: DataFrame, column: str, n: int = 1, order: Sequence[str] = (), new: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The value n rows before (after, if n < 0)."""
    need(df, column, *order)
    return framed(df, order, max(n, 0), max(-n, 0), lambda w: {new or f"{column}_lag{n}": F.lag(col(column), n).over(w)}, by)


def lead(df: DataFrame, column: str, n: int = 1, order: Sequence[str] = (), new: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    return lag(df, column, -n, order, new or f"{column}_lead{n}", by)


def cumulative(df: DataFrame, column: str, how: str, order: Sequence[str], new: str | None = None) -> DataFrame:
    """Running sum, prod, max, min or count; a null row stays null, but for count."""
    need(df, column, *order)
    keep = F.lit(True) if how == "count" else col(column).isNotNull()
    out = running(df, order, column, how)
    run = F.coalesce("__run", F.lit(0)) if how == "count" else F.col("__run")
    return out.withColumn(new or f"{column}_cum{how}", F.when(keep, run)).drop("__run")


def rolling(df: DataFrame, column: str, window: int, how: str, order: Sequence[str], new: str | None = None, center: bool = False, min_periods: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """mean, sum, min, max, std, var or median of a frame of `window` rows, which ends at the row or has it in the middle."""
    need(df, column, *order)
    before = window // 2 if center else window - 1
    after = window - 1 - before
    c = col(column)

    def make(w: Window) -> dict[str, Column]:
        w = w.rowsBetween(-before, after)
        if how == "median":
            values = F.array_sort(F.array_compact(F.collect_list(c).over(w)))
            n = F.size(values)
            out = F.when(n > 0, (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2)
        else:
            out = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp}[how](c).over(w)
        return {new or f"{column}_roll_{how}": F.when(F.count(c).over(w) >= min_periods, out)}

    return framed(df, order, before, after, make, by)
