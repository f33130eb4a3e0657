"""Splines as Column expressions, and local regression from window moments that one pass a step adds up."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.dsl import Formula
from tallyfold.functions.exprs import col
from tallyfold.operators.ordered import order_statistics, quantiles
from tallyfold.stats.frames import complete, frame
from tallyfold.stats.regression import Fit, ols

#: Points at which a local fit is made; between them it is interpolated on straight lines.
VERTICES = 200
#: Parts of a range of distances in one pass of the search for a radius; passes at most.
PARTS, PASSES = 256, 12
#: Rows that a task weighs at a time.
CHUNK = 4_000


def natural(u: Column, at: Sequence[float]) -> list[Column]:
    """Natural cubic splines on the knots `at` (the first and last are the boundary), without the constant."""
    cube = lambda k: F.when(u > F.lit(k), (u - F.lit(k)) ** 3).otherwise(0.0)
    d = lambda k: (cube(k) - cube(at[-1])) / F.lit(at[-1] - k)
    return [u, *(d(at[i]) - d(at[-2]) for i in range(len(at) - 2))]


def b_splines(u: Column, at: Sequence[float], degree: int = 3) -> list[Column]:
    """B-splines on the knots `at` by the recursion of Cox and de Boor, without the first; zero outside the boundary."""
    t = [at[0]] * degree + list(at) + [at[-1]] * degree
    last = len(t) - degree - 2  # the interval that the upper boundary belongs to

    def indicator(i: int) -> Column:
        upper = (u <= F.lit(t[i + 1])) if i == last else (u < F.lit(t[i + 1]))
        return ((u >= F.lit(t[i])) & upper).cast("double")

    basis: list[Column | None] = [indicator(i) if t[i] < t[i + 1] else None for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        new: list[Column | None] = []
        for i in range(len(t) - 1 - d):
            parts = []
            if basis[i] is not None:
                parts.append((u - F.lit(t[i])) / F.lit(t[i + d] - t[i]) * basis[i])
            if basis[i + 1] is not None:
                parts.append((F.lit(t[i + d + 1]) - u) / F.lit(t[i + d + 1] - t[i + 1]) * basis[i + 1])
            new.append(sum(parts[1:], parts[0]) if parts else None)
        basis = new
    return [b for b in basis[1:] if b is not None]


def _knots(df: DataFrame, columns: Sequence[str], knots: int | Sequence[float]) -> dict[str, list[float]]:
    """The knots of each column with its minimum and maximum: quantiles, or the positions that are given."""
    inner = [i / (knots + 1) for i in range(1, knots + 1)] if isinstance(knots, int) else []
    names = {f"v{i}": c for i, c in enumerate(columns)}
    got: dict[str, dict[float, float]] = {}
    for r in quantiles(df.select(*(col(c).alias(n) for n, c in names.items())), list(names), [0.0, *inner, 1.0], "linear").collect():  # a row for each knot
        got.setdefault(names[r["variable"]], {})[r["q"]] = r["value"]
    out = {}
    for c in columns:
        low, high = got[c][0.0], got[c][1.0]
        if not low < high:
            raise ValueError(f"{c} has one value")
        mid = [got[c][q] for q in inner] if isinstance(knots, int) else sorted(set(knots))
        if not isinstance(knots, int) and any(not low < k < high for k in mid):
            raise ValueError(f"knots must lie inside the values of {c}: {low} to {high}")
        out[c] = [low, *dict.fromkeys(k for k in mid if low < k < high), high]  # quantiles of many ties fall together
    return out


def spline_fit(df: DataFrame, y: str, xs: Sequence[str], knots: int | Sequence[float] = 4, kind: str = "natural") -> tuple[DataFrame, Fit]:
    """Complete rows with the basis as columns, and the least squares fit on it.

    `knots` inside each column: a number (at its quantiles) or positions. `natural` is
    linear outside the boundary knots, `bs` a cubic B-spline. Names are `<x>` and `s1` ...
    for the natural spline of one column, else `<x>_s1` ...
    """
    if kind not in ("natural", "bs"):
        raise ValueError("a spline is natural or bs")
    used = list(dict.fromkeys(xs))
    rows = complete(df, {c: col(c) for c in [y, *used]})
    added: dict[str, Column] = {}
    terms: list[str] = []
    for c, at in _knots(rows, used, knots).items():
        u = col(c).cast("double")
        prefix = "s" if kind == "natural" and len(used) == 1 else f"{c}_s"
        basis = natural(u, at) if kind == "natural" else b_splines(u, at)
        if kind == "natural":
            terms.append(c)
            basis = basis[1:]
        names = [f"{prefix}{i + 1}" for i in range(len(basis))]
        clash = set(names) & set(df.columns)
        if clash:
            raise ValueError(f"the table has a column {sorted(clash)[0]}")
        added |= dict(zip(names, basis, strict=True))
        terms += names
    rows = rows.withColumns(added)
    return rows, ols(rows, Formula(y, tuple((t,) for t in terms)))


def spline(df: DataFrame, y: str, x: str | Sequence[str], knots: int | Sequence[float] = 4, kind: str = "natural") -> DataFrame:
    """term, coef and se of a spline regression; the basis is made of Column expressions."""
    return spline_fit(df, y, [x] if isinstance(x, str) else x, knots, kind)[1].tidy(df)


def _accuracy(df: DataFrame, y: str, fitted: str) -> dict[str, float]:
    """n, r2 and the residuals' mean, sd, min, max and rmse over rows that have both."""
    e = col(y).cast("double") - F.col(fitted)
    r = df.where(e.isNotNull()).agg(F.count("*"), F.var_pop(col(y).cast("double")), F.avg(e), F.stddev_pop(e), F.min(e), F.max(e), F.avg(e * e)).first()
    return {"n": r[0], "r2": 1 - r[6] / r[1] if r[1] else math.nan, "mean_residual": r[2], "sd_residual": r[3], "min_residual": r[4], "max_residual": r[5], "rmse": math.sqrt(r[6])}


def spline_summary(df: DataFrame, y: str, xs: Sequence[str], knots: int | Sequence[float] = 4, kind: str = "natural") -> DataFrame:
    """measure and value: the fit's n, r2, aic, bic and residuals."""
    rows, fit = spline_fit(df, y, xs, knots, kind)
    found = _accuracy(rows.withColumn("__fit", fit.linear()), y, "__fit") | {k: fit.stats[k] for k in ("aic", "bic")}
    return frame(df.sparkSession, [{"measure": k, "value": v} for k, v in found.items()], "measure string, value double")


def spline_values(df: DataFrame, y: str, xs: Sequence[str], knots: int | Sequence[float] = 4, kind: str = "natural", new: str = "smooth") -> DataFrame:
    """Complete rows with the fitted value."""
    rows, fit = spline_fit(df, y, xs, knots, kind)
    return rows.withColumn(new, fit.linear()).select(*(F.col(f"`{c}`") for c in df.columns if c != new), new)


def _radii(counts: DataFrame, at: np.ndarray, k: int) -> np.ndarray:
    """The distance of the k-th nearest row from each point; counts: x and n.

    A pass counts rows in parts of each point's range of distances and keeps the smallest
    and largest distance in the part that holds the k-th; it is found once these agree.
    """
    g = len(at)
    span = counts.agg(F.min("x"), F.max("x")).first()
    low, high, before = np.zeros(g), np.maximum(at - span[0], span[1] - at), np.zeros(g)
    done, out = np.zeros(g, bool), np.zeros(g)
    for _ in range(PASSES):
        open_ = np.flatnonzero(~done)
        if not len(open_):
            break
        lo, hi, v = low[open_], high[open_], at[open_]
        width = np.where(hi > lo, hi - lo, 1.0)

        def bins(it: Iterator) -> Iterator:
            import pandas as pd

            m = len(v)
            n, a, b = np.zeros(m * PARTS), np.full(m * PARTS, np.inf), np.full(m * PARTS, -np.inf)
            for pdf in it:
                for s in range(0, len(pdf), CHUNK):
                    x, w = pdf["x"].to_numpy()[s : s + CHUNK], pdf["n"].to_numpy()[s : s + CHUNK].astype(float)
                    d = np.abs(x[:, None] - v)
                    inside = (d >= lo) & (d <= hi)
                    place = (np.minimum((d - lo) / width * PARTS, PARTS - 1).clip(0).astype(np.int64) + np.arange(m) * PARTS)[inside]
                    n += np.bincount(place, np.broadcast_to(w[:, None], d.shape)[inside], m * PARTS)
                    np.minimum.at(a, place, d[inside])
                    np.maximum.at(b, place, d[inside])
            hit = np.flatnonzero(n)
            yield pd.DataFrame({"v": (hit // PARTS).astype(np.int32), "part": (hit % PARTS).astype(np.int32), "n": n[hit], "a": a[hit], "b": b[hit]})

        parts = counts.mapInPandas(bins, "v int, part int, n double, a double, b double").groupBy("v", "part").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
        upto = F.sum("n").over(Window.partitionBy("v").orderBy("part"))
        first = F.array(*(F.lit(float(k - c)) for c in before[open_]))
        found = parts.withColumn("upto", upto).withColumn("goal", F.element_at(first, F.col("v") + 1)).where("upto >= goal and upto - n < goal")
        for r in found.collect():  # a row for each point
            i = open_[r["v"]]
            before[i] += r["upto"] - r["n"]
            low[i], high[i] = r["a"], r["b"]
            done[i], out[i] = r["a"] == r["b"], r["b"]
    return out


def _local(rows: DataFrame, at: np.ndarray, radius: np.ndarray, last: np.ndarray | None, scale: float) -> np.ndarray:
    """Local lines at each point by tricube weights, times bisquare weights of the last fit's residuals."""

    def add(it: Iterator) -> Iterator:
        import pandas as pd

        total = np.zeros((len(at), 5))
        for pdf in it:
            for s in range(0, len(pdf), CHUNK):
                part = pdf.iloc[s : s + CHUNK]
                x, y, n = (part[c].to_numpy().astype(float) for c in ("x", "y", "n"))
                if last is not None:
                    e = np.abs(y - np.interp(x, at, last))
                    u = np.minimum(e / (6 * scale), 1) if scale > 0 else (e > 0).astype(float)
                    n = n * (1 - u * u) ** 2
                d = x[:, None] - at
                with np.errstate(divide="ignore", invalid="ignore"):
                    share = np.abs(d) / radius
                share = np.where(radius > 0, share, np.where(d == 0, 0.0, np.inf))
                w = np.where(share <= 0.001, 1.0, np.where(share <= 0.999, (1 - np.minimum(share, 1) ** 3) ** 3, 0.0)) * n[:, None]
                wd = w * d
                total += np.column_stack((w.sum(0), wd.sum(0), (wd * d).sum(0), w.T @ y, wd.T @ y))
        yield pd.DataFrame({"v": np.arange(len(at), dtype=np.int32), **{f"s{i}": total[:, i] for i in range(5)}})

    sums = rows.mapInPandas(add, "v int, " + ", ".join(f"s{i} double" for i in range(5))).groupBy("v").agg(*(F.sum(f"s{i}") for i in range(5))).orderBy("v").collect()
    w, d, dd, y, dy = np.array([r[1:] for r in sums]).T
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, middle = d / w, y / w
        spread = dd / w - mean**2
        slope = np.where(spread > 1e-12 * np.maximum(radius, 1e-300) ** 2, (dy / w - mean * middle) / np.where(spread > 0, spread, 1), 0.0)
        out = middle - slope * mean
    return np.where(w > 0, out, last if last is not None else np.nan)


def loess_vertices(df: DataFrame, y: str, x: str, frac: float = 0.3, rounds: int = 3, vertices: int = VERTICES) -> tuple[np.ndarray, np.ndarray]:
    """Points and the local fit there.

    Every point's window holds the nearest int(frac * n) rows (two at least), weighted by tricubes of
    their distance over the window's radius. `rounds` times the fit is repeated with
    bisquare weights of the residuals over six times their median size; a point whose rows
    all lose their weight keeps its last value. The points are all distinct values of x
    where there are at most `vertices`, else their quantiles, both ends included: every row
    enters each window that it belongs to, and a pass costs rows times points.
    """
    if not 0 < frac <= 1:
        raise ValueError("frac must be above 0 and at most 1")
    if vertices < 2:
        raise ValueError("vertices must be 2 or more")
    u, t = col(x).cast("double"), col(y).cast("double")
    rows = complete(df, {"x": u, "y": t}).groupBy((u + F.lit(0.0)).alias("x"), (t + F.lit(0.0)).alias("y")).agg(F.count("*").alias("n")).persist()
    counts = rows.groupBy("x").agg(F.sum("n").alias("n")).persist()
    try:
        few = sorted(r[0] for r in counts.select("x").limit(vertices + 1).collect())
        if not few:
            return np.zeros(0), np.zeros(0)
        if len(few) <= vertices:
            at = np.array(few)
        else:
            at = np.unique([r["value"] for r in order_statistics(counts, "x", [i / (vertices - 1) for i in range(vertices)]).collect()])
        n = rows.agg(F.sum("n")).first()[0]
        radius = _radii(counts, at, min(n, max(2, int(frac * n + 1e-10))))
        fit = _local(rows, at, radius, None, 0.0)
        for _ in range(rounds):
            sizes = _sizes(rows, at, fit)
            fit = _local(rows, at, radius, fit, sizes)
        return at, fit
    finally:
        rows.unpersist()
        counts.unpersist()


def _sizes(rows: DataFrame, at: np.ndarray, fit: np.ndarray) -> float:
    """The median size of the residuals, found by its rank among counts of distinct sizes."""
    sizes = _interpolated(rows, "x", at, fit, "f").groupBy(F.abs(F.col("y") - F.col("f")).alias("e")).agg(F.sum("n").alias("n"))
    total = rows.agg(F.sum("n")).first()[0]
    from tallyfold.operators.ordered import running

    upto = running(sizes, ["e"], "n", "sum")
    goals = [(total + 1) // 2, total // 2 + 1]
    got = [upto.where(F.col("__run") >= g).agg(F.min("e")).first()[0] for g in dict.fromkeys(goals)]
    return sum(got) / len(got)


def _interpolated(df: DataFrame, x: str, at: np.ndarray, fit: np.ndarray, new: str) -> DataFrame:
    """df with the fit at x on straight lines between the points; beyond them and where x is null, null."""
    xs, ys = [float(v) for v in at], [float(v) for v in fit]
    u = col(x).cast("double")

    def line(i: int) -> Column:
        return F.lit(ys[i]) + (u - F.lit(xs[i])) * F.lit((ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]))

    def pick(low: int, high: int) -> Column:
        if low == high:
            return line(low)
        middle = (low + high) // 2
        return F.when(u > F.lit(xs[middle + 1]), pick(middle + 1, high)).otherwise(pick(low, middle))

    if not xs:
        return df.withColumn(new, F.lit(None).cast("double"))
    value = pick(0, len(xs) - 2) if len(xs) > 1 else F.lit(ys[0])
    return df.withColumn(new, F.when((u >= F.lit(xs[0])) & (u <= F.lit(xs[-1])), value))


def loess(df: DataFrame, y: str, x: str, frac: float = 0.3, rounds: int = 3, vertices: int = VERTICES) -> DataFrame:
    """x and smooth: the curve at its points (see `loess_vertices`)."""
    at, fit = loess_vertices(df, y, x, frac, rounds, vertices)
    return frame(df.sparkSession, [{"x": a, "smooth": b} for a, b in zip(at, fit, strict=True)], "x double, smooth double")


def loess_values(df: DataFrame, y: str, x: str, frac: float = 0.3, rounds: int = 3, vertices: int = VERTICES, new: str = "smooth") -> DataFrame:
    """All rows with the curve's value; null where x is null or outside the rows that were fitted."""
    return _interpolated(df, x, *loess_vertices(df, y, x, frac, rounds, vertices), new)


def loess_summary(df: DataFrame, y: str, x: str, frac: float = 0.3, rounds: int = 3, vertices: int = VERTICES) -> DataFrame:
    """measure and value: n, r2 and the residuals."""
    found = _accuracy(loess_values(complete(df, {"x": col(x), "y": col(y)}), y, x, frac, rounds, vertices, "__fit"), y, "__fit")
    return frame(df.sparkSession, [{"measure": k, "value": v} for k, v in found.items()], "measure string, value double")
