"""Column expressions with the engine's own arithmetic: IEEE division, floored remainder, guarded logarithms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = F.lit, float("nan")


def name(column: str) -> str:
    """The quoted form of a column name, whatever characters it holds."""
    return "`" + column.replace("`", "``") + "`"


def col(column: str | Column) -> Column:
    return F.col(name(column)) if isinstance(column, str) else column


def ieee_div(a: Column, b: Column) -> Column:
    """a / b in double: x / 0 is +-inf, 0 / 0 is NaN, null stays null. The zero branch never divides."""
    x, y = a.cast("double"), b.cast("double")
    zero = F.when((x == 0) | F.isnan(x), F.lit(NAN)).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, zero).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; null for a zero divisor of whole numbers."""
    safe = F.when(b != 0, b)
    return a - safe * F.floor(a / safe)


def safe_log(x: Column) -> Column:
    """Natural logarithm: -inf at 0, NaN below."""
    x = x.cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(NAN)).otherwise(F.ln(F.when(x > 0, x)))


def safe_log10(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(NAN)).otherwise(F.log10(F.when(x > 0, x)))


def strip(x: Column) -> Column:
    """Without white space at both ends; all of Unicode's white space counts."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clip(x: Column, low: Column, high: Column) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNull(), x).when(x < low, low).when(x > high, high).otherwise(x)


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def n_unique(x: Column) -> Column:
    """Distinct values; null counts as one."""
    return (F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0))).cast("long")


#: Patterns of strftime letters and what date_format calls them.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%p": "a", "%I": "hh", "%f": "SSSSSS", "%%": "%"}


def java_format(pattern: str) -> str:
    """A strftime pattern as a date_format pattern; other letters are quoted."""
    out, i, plain = [], 0, ""

    def flush() -> None:
        nonlocal plain
        if plain:
            out.append("'" + plain.replace("'", "''") + "'" if any(c.isalpha() for c in plain) else plain)
            plain = ""

    while i < len(pattern):
        if pattern[i : i + 2] in STRFTIME:
            flush()
            out.append(STRFTIME[pattern[i : i + 2]])
            i += 2
        else:
            plain += pattern[i]
            i += 1
    flush()
    return "".join(out)
