"""Result frames, and sufficient statistics that one aggregation brings to the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _plain(x: object) -> object:
    if isinstance(x, (np.floating, float)):
        return float(x)
    if isinstance(x, np.bool_):
        return bool(x)
    return int(x) if isinstance(x, np.integer) else x


def _kind(values: Sequence[object]) -> str:
    kinds = {type(v) for v in values if v is not None}
    return "boolean" if kinds == {bool} else "long" if kinds and kinds <= {int, bool} else "string" if str in kinds else "double"


def frame(spark: SparkSession, rows: Sequence[Mapping[str, object]], schema: str | None = None) -> DataFrame:
    """A small DataFrame of plain values; whole numbers are long, others double."""
    rows = [{k: _plain(v) for k, v in r.items()} for r in rows]
    if schema is None:
        names = list(rows[0])
        schema = ", ".join(f"`{n}` {_kind([r.get(n) for r in rows])}" for n in names)
        rows = [{n: float(v) if _kind([r.get(n) for r in rows]) == "double" and v is not None else v for n, v in x.items()} for x in rows]
    kinds = {(f.split("`")[1] if "`" in f else f.split()[0]): f.split()[-1] for f in schema.split(", ")}
    fit = {"double": float, "long": int}
    return spark.createDataFrame([tuple(fit.get(k, lambda x: x)(r[n]) if r.get(n) is not None else None for n, k in kinds.items()) for r in rows], schema)


def few(df: DataFrame, what: str, most: int) -> list:
    """The rows of a table that must be small; more than `most` raise, and no more than one above is read."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most}")
    return rows


@dataclass(frozen=True)
class Moments:
    """Weighted cross-products of named columns (the first is the constant), over rows without null or NaN; `centred` are those around `shift`."""

    names: tuple[str, ...]
    n: int
    xx: np.ndarray
    centred: np.ndarray | None = None
    shift: tuple[float, ...] = ()

    def block(self, rows: Sequence[str], columns: Sequence[str]) -> np.ndarray:
        i, j = ([self.names.index(x) for x in part] for part in (rows, columns))
        return self.xx[np.ix_(i, j)]


CONST = "const"


def design(columns: Mapping[str, Column]) -> dict[str, Column]:
    return {CONST: F.lit(1.0), **{k: v.cast("double") for k, v in columns.items()}}


def cross_products(columns: Mapping[str, Column], weight: Column | None, shift: Mapping[str, float] | None = None) -> list[Column]:
    """Sums of all products of the columns, upper triangle."""
    names = list(columns)
    moved = {k: (v - F.lit(shift[k]) if shift and k in shift and k != CONST else v) for k, v in columns.items()}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    w = weight.cast("double") if weight is not None else F.lit(1.0)
    return [F.sum(w * moved[a] * moved[b]).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]


def _matrix(row: Sequence[float | None], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = [x or 0.0 for x in row]
    return out + np.triu(out, 1).T


def complete(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Rows where every column has a number, with the columns under safe names c0, c1, ..."""
    out = df
    for c in columns.values():
        x = c.cast("double")
        out = out.where(x.isNotNull() & ~F.isnan(x))
    return out


def moments(df: DataFrame, columns: Mapping[str, Column], weight: Column | None = None) -> Moments:
    """One pass for the means of a first look, one for the products around them: large means do not cost digits."""
    rows = complete(df, columns)
    cols = design(columns)
    names = tuple(cols)
    means = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols.values()))).first()
    shift = {n: (m if m is not None and math.isfinite(m) else 0.0) for n, m in zip(names, means, strict=True)}
    row = rows.agg(F.count("*").alias("n"), *cross_products(cols, weight, shift)).first()
    centred = _matrix(row[1:], len(names))
    back = np.eye(len(names))
    back[:, 0] = [0.0 if n == CONST else shift[n] for n in names]
    back[0, 0] = 1.0
    return Moments(names, int(row[0]), back @ centred @ back.T, centred, tuple(float(v) for v in back[:, 0]))
