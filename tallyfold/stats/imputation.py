"""Multiple imputation by chained equations: linear draws, logistic draws and predictive mean matching.

The m copies of the table are rows of one table under `_mi`. A column's regression on
the others is fitted in every copy from one aggregation by copy; its parameters are
drawn from their posterior on the driver (a small vector for each copy), and the missing
cells are filled by Column expressions, or by the nearest donors of operators/nearest.py.
Draws of rows come from hashes of a row number that is written once, so that they are
the same wherever a row is processed. Each round is written, which ends its lineage.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col
from tallyfold.operators.nearest import nearest
from tallyfold.stats.frames import CONST, _matrix, cross_products
from tallyfold.stats.regression import _inverse
from tallyfold.storage import discard, written

METHODS = ("regress", "logit", "pmm")
#: Newton steps of a logistic fit.
STEPS = 12
_ID, _COPY = "__id", "_mi"


def _uniform(*parts: object) -> Column:
    """A number in (0, 1) for each row and copy."""
    return (F.pmod(F.xxhash64(_ID, _COPY, *(F.lit(p) for p in parts)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(*parts: object) -> Column:
    """Box and Muller on two hashes."""
    return F.sqrt(-2 * F.log(_uniform(*parts, 0))) * F.cos(2 * math.pi * _uniform(*parts, 1))


def _by_copy(values: dict[int, Sequence[float]], i: int) -> Column:
    """Entry i of a small vector for each copy."""
    return F.element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(float(v[i]))))), F.col(_COPY))


def _linear(values: dict[int, Sequence[float]], xs: Sequence[Column]) -> Column:
    out = _by_copy(values, 0)
    for i, x in enumerate(xs, 1):
        out = out + _by_copy(values, i) * x
    return out


def _products(rows: DataFrame, xs: Sequence[Column], y: Column, weight: Column | None = None) -> dict[int, tuple[int, np.ndarray]]:
    """Rows and products of (1, x..., y) for each copy: one aggregation."""
    names = {CONST: F.lit(1.0), **{f"x{i}": x for i, x in enumerate(xs)}, "y": y}
    k = len(names)
    got = rows.groupBy(_COPY).agg(F.count("*").alias("n"), *cross_products(names, weight)).collect()
    return {r[_COPY]: (r["n"], _matrix(r[2:], k)) for r in got}


def _draw_linear(products: dict[int, tuple[int, np.ndarray]], rng: np.random.Generator, draw: bool) -> tuple[dict, dict, dict]:
    """Estimates, drawn coefficients and drawn standard deviations for each copy."""
    best, drawn, sd = {}, {}, {}
    for k, (n, a) in sorted(products.items()):
        inv = _inverse(a[:-1, :-1])
        b = inv @ a[:-1, -1]
        d = max(n - len(b), 1)
        rss = max(float(a[-1, -1] - b @ a[:-1, -1]), 0.0)
        s2 = rss / rng.chisquare(d) if draw else rss / d
        best[k], sd[k] = b, [math.sqrt(s2)]
        drawn[k] = rng.multivariate_normal(b, s2 * inv, method="eigh") if draw else b
    return best, drawn, sd


def _draw_logit(rows: DataFrame, xs: Sequence[Column], y: Column, rng: np.random.Generator, copies: int) -> dict[int, np.ndarray]:
    """Coefficients of a logistic fit in each copy, drawn from their normal approximation; all copies step together."""
    b = {k: np.zeros(len(xs) + 1) for k in range(1, copies + 1)}
    for _ in range(STEPS):
        eta = _linear(b, xs)
        p = 1 / (1 + F.exp(-eta))
        weight = F.greatest(p * (1 - p), F.lit(1e-9))
        got = _products(rows, xs, eta + (y - p) / weight, weight)
        new = {k: _inverse(a[:-1, :-1] + 1e-9 * np.eye(len(a) - 1)) @ a[:-1, -1] for k, (_, a) in got.items()}
        gap = max(float(np.abs(new[k] - b[k]).max()) for k in new)
        b = new
        if gap < 1e-8:
            break
    return {k: rng.multivariate_normal(b[k], _inverse(a[:-1, :-1] + 1e-9 * np.eye(len(a) - 1)), method="eigh") for k, (_, a) in sorted(got.items())}


def _match(rows: DataFrame, c: str, flag: str, xs: Sequence[Column], best: dict, drawn: dict, knn: int, pick: Column) -> DataFrame:
    """rows with missing cells of `c` taken from one of the `knn` observed rows whose predicted means are nearest; `pick` chooses among them."""
    donors = rows.where(~F.col(flag)).select(_COPY, _linear(best, xs).alias("__hat"), F.col(_ID).alias("__donor"), col(c).alias("__value"))
    asks = rows.where(F.col(flag)).select("*", _linear(drawn, xs).alias("__hat"))
    found = nearest(asks, donors, "__hat", knn, by=[_COPY], ties=["__donor"])
    found = found.groupBy(_ID, _COPY).agg(F.count("*").alias("__k"), F.collect_list(F.struct("near", F.col("donor.__value").alias("v"))).alias("__near"))
    found = found.withColumn("__taken", F.array_sort("__near")[F.least(F.floor(pick * F.col("__k")), F.col("__k") - 1).cast("int")]["v"])
    out = rows.join(found.select(_ID, _COPY, "__taken"), [_ID, _COPY], "left")
    return out.withColumn(c, F.when(F.col(flag), F.coalesce("__taken", col(c))).otherwise(col(c))).drop("__taken").select(*rows.columns)


def impute(df: DataFrame, methods: dict[str, str], m: int = 5, rounds: int = 10, knn: int = 5, seed: int = 42, draw: bool = True) -> DataFrame:
    """m completed copies of df under `_mi`; `methods` maps each column of the model to regress, logit or pmm.

    Cells that are null or NaN are filled; columns without such cells only predict.
    With pmm a filled value is always one that another row holds. Without `draw` the
    estimates themselves predict, and linear draws add no noise.
    """
    for c, how in methods.items():
        if how not in METHODS:
            raise ValueError(f"{how} for {c}: there are {', '.join(METHODS)}")
    columns = list(methods)
    flags = {c: f"__na{i}" for i, c in enumerate(columns)}
    base = df.withColumns({f: col(c).isNull() | F.isnan(col(c).cast("double")) for c, f in flags.items()}).withColumn(_ID, F.monotonically_increasing_id())
    base = written(base)
    row = base.agg(*(F.avg(F.when(~F.col(f), col(c).cast("double"))) for c, f in flags.items()), *(F.count(F.when(F.col(f), 1)) for f in flags.values())).first()
    start, missing = row[: len(columns)], [c for c, k in zip(columns, row[len(columns) :], strict=True) if k]
    if any(v is None for v in start):
        raise ValueError(f"no value of {', '.join(c for c, v in zip(columns, start, strict=True) if v is None)}")
    filled = {c: F.when(F.col(flags[c]), F.lit(v)).otherwise(col(c).cast("double")) for c, v in zip(columns, start, strict=True)}
    out = base.withColumns(filled).withColumn(_COPY, F.explode(F.sequence(F.lit(1), F.lit(m))))
    rng, last = np.random.default_rng(seed), base
    for r in range(rounds if missing else 0):
        for i, c in enumerate(missing):
            flag, xs, seen = flags[c], [col(x) for x in columns if x != c], out.where(~F.col(flags[c]))
            if methods[c] == "logit":
                drawn = _draw_logit(seen, xs, col(c), rng, m)
                value = (_uniform(seed, r, i) < 1 / (1 + F.exp(-_linear(drawn, xs)))).cast("double")
                out = out.withColumn(c, F.when(F.col(flag), value).otherwise(col(c)))
                continue
            best, drawn, sd = _draw_linear(_products(seen, xs, col(c)), rng, draw)
            if methods[c] == "pmm":
                out = _match(out, c, flag, xs, best, drawn, knn, _uniform(seed, r, i))
            else:
                noise = _by_copy(sd, 0) * _normal(seed, r, i) if draw else F.lit(0.0)
                out = out.withColumn(c, F.when(F.col(flag), _linear(drawn, xs) + noise).otherwise(col(c)))
        out = written(out)
        discard(last)
        last = out
    return out.drop(_ID, *flags.values())


def mice(df: DataFrame, columns: Sequence[str], m: int = 5, rounds: int = 5, seed: int = 42) -> DataFrame:
    """`impute` by linear draws for all columns."""
    return impute(df, dict.fromkeys(columns, "regress"), m, rounds, seed=seed)
