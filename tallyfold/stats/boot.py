"""Bootstrap of regression models: all resamples come from one distributed pass a step.

Equal rows are counted first. The rows behind a count have a Poisson number in each
resample, drawn from a hash of their values, the resample and the seed, so the draw does
not hang on the partitions. A task adds up one small matrix of products for each resample;
the driver sees resamples x k(k+1)/2 sums and no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dsl import Formula
from tallyfold.functions.exprs import col
from tallyfold.stats.frames import CONST, complete, frame
from tallyfold.stats.regression import Fit, Y, _inverse, glm, ols, parse, regressors
from tallyfold.stats.tests import _counts_drawn, _uniform

#: Rows that a task weighs at a time; resamples at most (the driver holds their sums).
CHUNK, MOST = 2_000, 10_000


def _erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(x)


def _mean(family: str) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Mean, its derivative and the variance at a linear predictor."""

    def logit(e):
        m = 1 / (1 + np.exp(-np.clip(e, -700, 700)))
        return m, m * (1 - m), m * (1 - m)

    def probit(e):
        m = 0.5 * (1 + _erf(e / math.sqrt(2)))
        return m, np.exp(-e * e / 2) / math.sqrt(2 * math.pi), m * (1 - m)

    def poisson(e):
        m = np.exp(np.clip(e, -700, 700))
        return m, m, m

    return {"ols": lambda e: (e, np.ones_like(e), np.ones_like(e)), "logit": logit, "probit": probit, "poisson": poisson}[family]


def resampled(df: DataFrame, spec: str | Formula, family: str = "ols", n: int = 500, seed: int = 42, steps: int = 25) -> tuple[Fit, np.ndarray]:
    """The fit of all rows, and the coefficients of each resample (a row of NaN where it has no fit).

    ols needs one pass. A GLM takes a Fisher step of all resamples a pass, from the fit of
    all rows on, until none of them moves.
    """
    if not 1 < n <= MOST:
        raise ValueError(f"resamples must be 2 to {MOST}")
    f = parse(spec)
    fit = ols(df, f) if family == "ols" else glm(df, f, family)
    x = regressors(f)
    k = len(x) + 1
    wide = {**x, Y: col(f.y)}
    names = [f"c{i}" for i in range(k)]
    rows = complete(df, wide).select(*((c.cast("double") + F.lit(0.0)).alias(a) for a, c in zip(names, wide.values(), strict=True)))  # -0.0 as 0.0
    rows = rows.groupBy(*names).agg(F.count("*").alias("k")).withColumn("h", F.xxhash64(*names)).persist()
    centre = np.array(rows.agg(*(F.sum(F.col(c) * F.col("k")) / F.sum("k") for c in names)).first(), dtype=float)
    shift = centre[:-1].copy()
    upper = np.triu_indices(k)
    width = len(upper[0])
    mean = _mean(family)
    off = centre[-1] if family == "ols" else 0.0

    def centred(b: np.ndarray) -> np.ndarray:
        """Coefficients as they are to those of centred columns, and `back` the other way."""
        out = b.copy()
        out[..., 0] = out[..., 0] + out[..., 1:] @ shift
        return out

    def back(b: np.ndarray) -> np.ndarray:
        out = b.copy()
        out[..., 0] = out[..., 0] + off - out[..., 1:] @ shift
        return out

    def step(beta: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Information (upper triangle) and score of the live resamples at their coefficients."""

        def add(it: Iterator) -> Iterator:
            import pandas as pd

            total = np.zeros((len(live), width + k))
            for pdf in it:
                for at in range(0, len(pdf), CHUNK):
                    part = pdf.iloc[at : at + CHUNK]
                    ks, bits = part["k"].to_numpy(), np.ascontiguousarray(part["h"].to_numpy()).view(np.float64)
                    z = np.column_stack((np.ones(len(part)), part[names[:-1]].to_numpy() - shift))
                    y = part[names[-1]].to_numpy() - off
                    w = np.column_stack([_counts_drawn(ks, _uniform(bits, int(b), seed)) for b in live])
                    m, d, v = mean(z @ beta.T)
                    v = np.maximum(v, 1e-12)
                    total[:, :width] += (w * d * d / v).T @ (z[:, upper[0]] * z[:, upper[1]])
                    total[:, width:] += (w * d * (y[:, None] - m) / v).T @ z
            yield pd.DataFrame({"b": live.astype(np.int32), **{f"s{i}": total[:, i] for i in range(width + k)}})

        schema = "b int, " + ", ".join(f"s{i} double" for i in range(width + k))
        got = rows.mapInPandas(add, schema).groupBy("b").agg(*(F.sum(f"s{i}") for i in range(width + k))).orderBy("b").collect()
        return np.array([r[1:] for r in got], dtype=float)

    full = centred(fit.params[None, :].astype(float))
    full[:, 0] -= off
    beta, live, failed = np.repeat(full, n, axis=0), np.arange(n), np.zeros(n, bool)
    for _ in range(1 if family == "ols" else steps):
        sums, moved = step(beta[live], live), np.zeros(len(live), bool)
        for i, b in enumerate(live):
            h = np.zeros((k, k))
            h[upper] = sums[i, :width]
            h = h + np.triu(h, 1).T
            scale = np.sqrt(np.maximum(np.diag(h), 1e-300))
            if not np.isfinite(sums[i]).all() or np.linalg.matrix_rank(h / np.outer(scale, scale), tol=1e-10, hermitian=True) < k:
                failed[b] = True
                continue
            change = _inverse(h) @ sums[i, width:]
            beta[b] += change
            moved[i] = np.abs(change * scale).max() > 1e-6
        live = live[moved]
        if not len(live):
            break
    if family != "ols":
        failed[live] = True  # still moving after the last step
    rows.unpersist()
    out = back(beta)
    out[failed] = np.nan
    return fit, out


def model_bootstrap(df: DataFrame, spec: str | Formula, family: str = "ols", n: int = 500, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """term, coef, se, bias, low and high (percentiles), resamples and failed.

    Resamples whose regressors are collinear or that do not converge are left out and
    counted as failed. Null and NaN rows are left out, as in the fit.
    """
    fit, draws = resampled(df, spec, family, n, seed)
    good = draws[~np.isnan(draws).any(axis=1)]
    if len(good) < 2:
        raise ValueError("fewer than two resamples have a fit")
    low, high = np.quantile(good, [(1 - ci) / 2, (1 + ci) / 2], axis=0)
    rows = [
        {"term": t, "coef": b, "se": float(good[:, i].std(ddof=1)), "bias": float(good[:, i].mean() - b), "low": low[i], "high": high[i], "resamples": len(good), "failed": n - len(good)}
        for i, (t, b) in enumerate(zip([CONST, *fit.names[1:]], fit.params, strict=True))
    ]
    return frame(df.sparkSession, rows, "term string, coef double, se double, bias double, low double, high double, resamples long, failed long")
