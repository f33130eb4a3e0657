"""Linear and generalised linear models from sums of products that Spark aggregates.

The driver only sees k x k matrices. Predictions, residuals and influence measures are
Column expressions over the same columns.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dsl import Formula, formula, term_column
from tallyfold.functions.exprs import col
from tallyfold.stats import dist
from tallyfold.stats.frames import CONST, Moments, complete, cross_products, design, frame, moments

Y = "__y"


@dataclass
class Fit:
    """A fitted model: coefficients with their covariance, and what later steps need."""

    kind: str
    names: list[str]
    params: np.ndarray
    cov: np.ndarray
    n: int
    df_resid: float
    stats: dict[str, float] = field(default_factory=dict)
    formula: Formula | None = None
    normal: bool = False

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    def rows(self) -> list[dict[str, object]]:
        d = math.inf if self.normal else self.df_resid
        q = dist.norm_ppf(0.975) if math.isinf(d) else dist.t_ppf(0.975, d)
        out = []
        for name, b, s in zip(self.names, self.params, self.se, strict=True):
            t = b / s if s else math.nan
            out.append({"term": name, "coef": b, "se": s, "statistic": t, "p": dist.t_two(t, d) if s else math.nan, "ci_low": b - q * s, "ci_high": b + q * s})
        return out

    def tidy(self, df: DataFrame) -> DataFrame:
        return frame(df.sparkSession, self.rows(), "term string, coef double, se double, statistic double, p double, ci_low double, ci_high double")

    def glance(self, df: DataFrame) -> DataFrame:
        return frame(df.sparkSession, [{"n": self.n, **{k: float(v) for k, v in self.stats.items()}}])

    def linear(self) -> Column:
        """The linear predictor."""
        terms = {":".join(t): term_column(t) for t in self.formula.terms}
        return sum((F.lit(float(b)) * terms[n] for n, b in zip(self.names, self.params, strict=True) if n in terms), F.lit(float(self.params[self.names.index(CONST)]) if CONST in self.names else 0.0))


def parse(spec: str | Formula) -> Formula:
    return spec if isinstance(spec, Formula) else formula(spec)


def regressors(f: Formula) -> dict[str, Column]:
    return {n: term_column(t) for n, t in zip(f.names, f.terms, strict=True)}


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a scaled symmetric matrix; collinear columns get the least-norm solution."""
    d = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.pinv(a / np.outer(d, d), rcond=1e-12, hermitian=True) / np.outer(d, d)


def _solve_centred(m: Moments, names: Sequence[str], y: str) -> tuple[np.ndarray, np.ndarray, float] | None:
    """As `_solve`, with the constant taken out of the products around the means; None where columns are collinear.

    Products around zero would cost the digits in which nearly collinear columns differ.
    """
    at = [m.names.index(x) for x in names if x != CONST]
    every, c = [*at, m.names.index(y)], m.centred
    zero = m.names.index(CONST)
    if not at or c[zero, zero] <= 0:
        return None
    off = c[every, zero] / c[zero, zero]
    s = c[np.ix_(every, every)] - np.outer(off, off) * c[zero, zero]
    d = np.sqrt(np.maximum(np.diag(s)[:-1], 1e-300))
    scaled = s[:-1, :-1] / np.outer(d, d)
    if not np.isfinite(scaled).all():
        return None
    values, vectors = np.linalg.eigh(scaled)
    if values[0] <= 1e-12 * values[-1] or (d * d <= 1e-12 * np.diag(m.xx)[at]).any():
        return None
    v = (vectors / values) @ vectors.T / np.outer(d, d)
    b = v @ s[:-1, -1]
    mean = np.array(m.shift)[every] + off
    inv = np.empty((len(names), len(names)))
    inv[0, 0] = 1 / c[zero, zero] + mean[:-1] @ v @ mean[:-1]
    inv[0, 1:] = inv[1:, 0] = -(v @ mean[:-1])
    inv[1:, 1:] = v
    return np.array([mean[-1] - b @ mean[:-1], *b]), inv, max(float(s[-1, -1] - b @ s[:-1, -1]), 0.0)


def _solve(m: Moments, names: Sequence[str], y: str = Y) -> tuple[np.ndarray, np.ndarray, float]:
    if m.centred is not None and names[0] == CONST and (found := _solve_centred(m, names, y)):
        return found
    inv = _inverse(m.block(names, names))
    b = inv @ m.block(names, [y])[:, 0]
    rss = float(m.block([y], [y])[0, 0] - b @ m.block(names, [y])[:, 0])
    return b, inv, max(rss, 0.0)


def _meat(df: DataFrame, cols: Mapping[str, Column], score: Column, cluster: str | None) -> tuple[np.ndarray, int]:
    """Sum over rows (or clusters) of score x x' score, and the clusters."""
    x = design(cols)
    if not cluster:
        row = df.agg(F.count("*"), *cross_products(x, score * score)).first()
        k = len(x)
        out = np.zeros((k, k))
        out[np.triu_indices(k)] = row[1:]
        return out + np.triu(out, 1).T, int(row[0])
    sums = df.groupBy(col(cluster).alias("__g")).agg(*(F.sum(score * c).alias(f"s{i}") for i, c in enumerate(x.values())))
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = sums.agg(F.count("*"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in pairs)).first()
    out = np.zeros((len(x), len(x)))
    out[np.triu_indices(len(x))] = row[1:]
    return out + np.triu(out, 1).T, int(row[0])


def _robust(df: DataFrame, cols: Mapping[str, Column], score: Column, bread: np.ndarray, n: int, cluster: str | None) -> np.ndarray:
    """HC1, or clustered with G / (G - 1) * (n - 1) / (n - k)."""
    meat, g = _meat(df, cols, score, cluster)
    k = len(bread)
    return bread @ meat @ bread * (g / (g - 1) * (n - 1) / (n - k) if cluster else n / (n - k))


def ols(df: DataFrame, spec: str | Formula, robust: bool = False, cluster: str | None = None, weight: str | None = None) -> Fit:
    """Least squares with a constant over complete rows."""
    f = parse(spec)
    x = regressors(f)
    cols = {**x, Y: col(f.y)}
    m = moments(df, cols, col(weight) if weight else None)
    names = [CONST, *x]
    b, inv, rss = _solve(m, names)
    n, k = m.n, len(names)
    cov = inv * rss / (n - k)
    fit = Fit("ols", names, b, cov, n, n - k, formula=f, normal=bool(robust or cluster))
    if robust or cluster:
        rows = complete(df, cols)
        if cluster:
            rows = rows.where(col(cluster).isNotNull())
        w = col(weight).cast("double") if weight else F.lit(1.0)
        fit.cov = _robust(rows, x, w * (col(f.y).cast("double") - fit.linear()), inv, n, cluster)
    total = m.block([Y], [Y])[0, 0] - m.block([CONST], [Y])[0, 0] ** 2 / m.block([CONST], [CONST])[0, 0]
    r2 = 1 - rss / total if total > 0 else math.nan
    ll = -n / 2 * (math.log(2 * math.pi * max(rss, 1e-300) / n) + 1)
    fstat = (r2 / (k - 1)) / ((1 - r2) / (n - k)) if k > 1 and r2 < 1 else math.inf
    fit.stats = {"r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k), "f": fstat, "f_p": dist.f_sf(fstat, k - 1, n - k) if k > 1 and math.isfinite(fstat) else 0.0, "rmse": math.sqrt(rss / (n - k)), "rss": rss, "ll": ll, "aic": 2 * k - 2 * ll, "bic": k * math.log(n) - 2 * ll}
    return fit


_LINKS = {
    # mean, derivative of the mean, variance and log likelihood of a row, as Columns of the linear predictor e and y
    "logit": (lambda e: 1 / (1 + F.exp(-e)), lambda e, m: m * (1 - m), lambda m: m * (1 - m), lambda y, m: y * F.log(F.greatest(m, F.lit(1e-300))) + (1 - y) * F.log(F.greatest(1 - m, F.lit(1e-300)))),
    "probit": (lambda e: _phi(e), lambda e, m: F.exp(-e * e / 2) / math.sqrt(2 * math.pi), lambda m: m * (1 - m), lambda y, m: y * F.log(F.greatest(m, F.lit(1e-300))) + (1 - y) * F.log(F.greatest(1 - m, F.lit(1e-300)))),
    "poisson": (lambda e: F.exp(e), lambda e, m: m, lambda m: m, lambda y, m: y * F.log(m) - m - _log_factorial(y)),
}


def _log_factorial(y: Column) -> Column:
    """Stirling's series behind a shift of 8: accurate to 1e-12 for y >= 0."""
    z = y + 8
    shift = sum((F.log(y + i) for i in range(1, 9)), F.lit(0.0))
    series = 1 / (12 * (z + 1)) - 1 / (360 * (z + 1) ** 3) + 1 / (1260 * (z + 1) ** 5)
    return (z + 0.5) * F.log(z + 1) - (z + 1) + 0.5 * math.log(2 * math.pi) + series - shift


def _phi(x: Column) -> Column:
    """The normal distribution function by the rational form of Zelen and Severo's successor, West (2005); error below 1e-14."""
    a = F.abs(x)
    low = 0.0
    for c in (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376):
        low = low * a + c if not isinstance(low, float) else F.lit(c)
    high = None
    for c in (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752):
        high = F.lit(c) if high is None else high * a + c
    tail = F.exp(-a * a / 2) * low / high
    far = F.exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a < 7.07106781186547, tail).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def glm(df: DataFrame, spec: str | Formula, family: str, robust: bool = False, cluster: str | None = None, exposure: str | None = None, weight: str | None = None, steps: int = 30) -> Fit:
    """Maximum likelihood by Fisher scoring; every step is one aggregation of weighted products."""
    f = parse(spec)
    x = regressors(f)
    y = col(f.y).cast("double")
    offset = F.log(col(exposure).cast("double")) if exposure else F.lit(0.0)
    mean, slope, variance, row_ll = _LINKS[family]
    rows = complete(df, {**x, Y: y, **({"e": offset} if exposure else {})}).select(*(c.alias(f"x{i}") for i, c in enumerate(x.values())), y.alias("y"), offset.alias("o"), (col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), *([col(cluster).alias("__g")] if cluster else []))
    rows = rows.persist()
    names = [CONST, *x]
    cols = {n: F.col(f"x{i}") for i, n in enumerate(x)}
    n, ybar = rows.agg(F.count("*"), F.avg("y")).first()
    b = np.zeros(len(names))
    b[0] = {"logit": lambda p: math.log(p / (1 - p)), "probit": dist.norm_ppf, "poisson": math.log}[family](min(max(ybar, 1e-6), 1 - 1e-6) if family != "poisson" else max(ybar, 1e-6))
    w, ll = F.col("w"), -math.inf
    for _ in range(steps):
        eta = F.col("o") + sum((F.lit(float(v)) * c for v, c in zip(b[1:], cols.values(), strict=True)), F.lit(float(b[0])))
        m = mean(eta)
        d = slope(eta, m)
        info = w * d * d / F.greatest(variance(m), F.lit(1e-12))
        score = w * d * (F.col("y") - m) / F.greatest(variance(m), F.lit(1e-12))
        k = len(names)
        got = rows.agg(F.sum(w * row_ll(F.col("y"), m)), *(F.sum(score * c) for c in design(cols).values()), *cross_products(design(cols), info)).first()
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = got[1 + k :]
        inv = _inverse(h + np.triu(h, 1).T)
        step = inv @ np.array(got[1 : 1 + k])
        b, before, ll = b + step, ll, got[0]
        if np.abs(step).max() < 1e-9 or abs(ll - before) < 1e-11 * (1 + abs(ll)):
            break
    fit = Fit(family, names, b, inv, int(n), n - len(names), formula=f, normal=True)
    if robust or cluster:
        meat, g = _meat(rows, cols, score, "__g" if cluster else None)
        fit.cov = inv @ meat @ inv * (g / (g - 1) if cluster else n / (n - 1))
    null = {"logit": lambda p: n * (p * math.log(p) + (1 - p) * math.log(1 - p)), "probit": lambda p: n * (p * math.log(p) + (1 - p) * math.log(1 - p))}.get(family)
    if null and 0 < ybar < 1:
        fit.stats["pseudo_r2"] = 1 - ll / null(ybar)
    fit.stats |= {"ll": ll, "aic": 2 * len(b) - 2 * ll, "bic": len(b) * math.log(n) - 2 * ll}
    rows.unpersist()
    return fit


def predict(df: DataFrame, fit: Fit, new: str = "yhat") -> DataFrame:
    """The fitted mean; null where a regressor is null."""
    mean = _LINKS[fit.kind][0] if fit.kind in _LINKS else (lambda e: e)
    return df.withColumn(new, mean(fit.linear()))


def residuals(df: DataFrame, fit: Fit, new: str = "resid") -> DataFrame:
    return predict(df, fit, "__yhat").withColumn(new, col(fit.formula.y).cast("double") - F.col("__yhat")).drop("__yhat")


def influence(df: DataFrame, spec: str | Formula) -> DataFrame:
    """df with leverage, resid, studentized (internally) and cooksd; nothing of size n x n is formed."""
    f = parse(spec)
    fit = ols(df, f)
    x = design(regressors(f))
    s2 = fit.stats["rss"] / fit.df_resid
    inv = fit.cov / s2
    names = list(x)
    h = sum((F.lit(float(inv[i, j] * (1 if i == j else 2))) * x[a] * x[b] for i, a in enumerate(names) for j, b in enumerate(names) if i <= j), F.lit(0.0))
    out = residuals(df, fit, "resid").withColumn("leverage", h)
    t = F.col("resid") / F.sqrt(F.lit(s2) * (1 - F.col("leverage")))
    return out.withColumn("studentized", t).withColumn("cooksd", t * t * F.col("leverage") / (1 - F.col("leverage")) / len(names))


def outliers(df: DataFrame, spec: str | Formula, threshold: float = 3.0) -> DataFrame:
    return influence(df, spec).where(F.abs("studentized") > threshold)


def dfbeta(df: DataFrame, spec: str | Formula) -> DataFrame:
    """term and the largest |change| of its coefficient, in standard errors, when one row is left out."""
    f = parse(spec)
    fit = ols(df, f)
    x = design(regressors(f))
    s2 = fit.stats["rss"] / fit.df_resid
    inv = fit.cov / s2
    rows = influence(df, f)
    out = [F.max(F.abs(sum((F.lit(float(inv[i, j])) * c for j, c in enumerate(x.values())), F.lit(0.0)) * F.col("resid") / (1 - F.col("leverage")) / float(fit.se[i]))).alias(f"d{i}") for i in range(len(x))]
    return rows.agg(*out).select(F.inline(F.array(*(F.struct(F.lit(n).alias("term"), F.col(f"d{i}").alias("max_dfbeta")) for i, n in enumerate(x)))))


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    m = moments(df, {c: col(c) for c in columns})
    xx, s = m.block(columns, columns), m.block([CONST], columns)[0]
    c = xx - np.outer(s, s) / m.n
    d = np.sqrt(np.diag(c))
    return frame(df.sparkSession, [{"variable": v, "vif": x} for v, x in zip(columns, np.diag(np.linalg.inv(c / np.outer(d, d))), strict=True)], "variable string, vif double")


def stepwise(df: DataFrame, spec: str | Formula, backward: bool = False, enter: float = 0.05, remove: float = 0.10) -> Fit:
    """Forward or backward selection by p values, over rows where all candidates are complete: one pass, then algebra."""
    f = parse(spec)
    x = regressors(f)
    m = moments(df, {**x, Y: col(f.y)})

    def p_values(names: Sequence[str]) -> dict[str, float]:
        b, inv, rss = _solve(m, [CONST, *names])
        d = m.n - len(names) - 1
        return {n: dist.t_two(b[i + 1] / math.sqrt(inv[i + 1, i + 1] * rss / d), d) for i, n in enumerate(names)}

    chosen = list(x) if backward else []
    while True:
        if backward:
            p = p_values(chosen) if chosen else {}
            worst = max(p, key=p.get, default=None)
            if worst is None or p[worst] <= remove:
                break
            chosen.remove(worst)
        else:
            p = {c: p_values([*chosen, c])[c] for c in x if c not in chosen}
            best = min(p, key=p.get, default=None)
            if best is None or p[best] >= enter:
                break
            chosen.append(best)
    keep = tuple(t for t in f.terms if ":".join(t) in chosen)
    return ols(df, Formula(f.y, tuple(sorted(keep, key=lambda t: chosen.index(":".join(t))))))


def automodel(df: DataFrame, y: str, columns: Sequence[str], criterion: str = "aic", most: int | None = None, top: int = 10) -> DataFrame:
    """The best subsets by AIC or BIC: all of up to 8 predictors, else forward. One pass over the data."""
    m = moments(df, {**{c: col(c) for c in columns}, Y: col(y)})

    def value(names: Sequence[str]) -> tuple[float, float]:
        _, _, rss = _solve(m, [CONST, *names])
        ll, k = -m.n / 2 * (math.log(2 * math.pi * rss / m.n) + 1), len(names) + 1
        return (2 * k if criterion == "aic" else k * math.log(m.n)) - 2 * ll, rss

    limit = most or len(columns)
    if len(columns) <= 8:
        subsets = [s for r in range(1, limit + 1) for s in itertools.combinations(columns, r)]
    else:
        subsets, now = [], ()
        while len(now) < limit:
            now = min(((*now, c) for c in columns if c not in now), key=lambda s: value(s)[0])
            subsets.append(now)
    ranked = sorted(((value(s)[0], " + ".join(s)) for s in subsets))[:top]
    return frame(df.sparkSession, [{"rank": i + 1, "model": s, criterion: v} for i, (v, s) in enumerate(ranked)], f"rank long, model string, {criterion} double")


def sureg(df: DataFrame, specs: Sequence[str]) -> tuple[list[Fit], np.ndarray]:
    """Least squares of each equation, and the correlations of their residuals."""
    fits = [ols(df, s) for s in specs]
    rows = df
    for i, f in enumerate(fits):
        rows = residuals(rows, f, f"__e{i}")
    pairs = list(itertools.combinations(range(len(fits)), 2))
    got = rows.agg(*(F.corr(f"__e{i}", f"__e{j}") for i, j in pairs)).first()
    out = np.eye(len(fits))
    for (i, j), r in zip(pairs, got, strict=True):
        out[i, j] = out[j, i] = r
    return fits, out


def bayes(df: DataFrame, spec: str | Formula, prior_scale: float = 10.0, draws: int = 4000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Conjugate normal-inverse-gamma regression: posterior means, deviations and credible limits from driver draws."""
    f = parse(spec)
    m = moments(df, {**regressors(f), Y: col(f.y)})
    names = [CONST, *f.names]
    xx, xy, yy = m.block(names, names), m.block(names, [Y])[:, 0], m.block([Y], [Y])[0, 0]
    v = np.linalg.inv(xx + np.eye(len(names)) / prior_scale**2)
    b = v @ xy
    a, s = 0.001 + m.n / 2, 0.001 + 0.5 * (yy - b @ np.linalg.inv(v) @ b)
    rng = np.random.default_rng(seed)
    sigma2 = s / rng.gamma(a, size=draws)
    got = b + np.sqrt(sigma2)[:, None] * (rng.standard_normal((draws, len(b))) @ np.linalg.cholesky(v).T)
    low, high = np.quantile(got, [(1 - ci) / 2, (1 + ci) / 2], axis=0)
    return frame(df.sparkSession, [{"term": n, "mean": b[i], "sd": float(got[:, i].std(ddof=1)), "low": low[i], "high": high[i]} for i, n in enumerate(names)])


def quantreg(df: DataFrame, spec: str | Formula, tau: float = 0.5, steps: int = 60) -> Fit:
    """Quantile regression by reweighted least squares, each step one aggregation."""
    f = parse(spec)
    x = regressors(f)
    y = col(f.y).cast("double")
    cols, rows = design(x), complete(df, {**x, Y: y}).persist()
    fit = ols(df, f)
    scale = max(fit.stats["rmse"], 1e-12)
    for i in range(steps):
        e = y - fit.linear()
        w = F.when(e >= 0, F.lit(tau)).otherwise(F.lit(1 - tau)) / F.greatest(F.abs(e), F.lit(scale * max(1e-6, 10.0 ** -(1 + i / 4))))
        k = len(cols)
        got = rows.agg(*(F.sum(w * c * y) for c in cols.values()), *cross_products(cols, w)).first()
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = got[k:]
        b = _inverse(h + np.triu(h, 1).T) @ np.array(got[:k])
        done = np.abs(b - fit.params).max() < 1e-8 * (1 + np.abs(b).max())
        fit.params = b
        if done:
            break
    rows.unpersist()
    fit.kind, fit.normal = "quantreg", False
    return fit


def margins(df: DataFrame, fit: Fit, at: str = "means") -> DataFrame:
    """Marginal effects of a logit or probit: at the means, or averaged (`average`), with delta-method errors."""
    f = fit.formula
    cols = regressors(f)
    rows = complete(df, cols)
    if at == "means":
        means = rows.agg(*(F.avg(c) for c in cols.values())).first()
        eta = float(fit.params[0] + fit.params[1:] @ np.array(means))
        p = 1 / (1 + math.exp(-eta)) if fit.kind == "logit" else dist.norm_cdf(eta)
        d = p * (1 - p) if fit.kind == "logit" else dist.norm_pdf(eta)
        dd = d * (1 - 2 * p) if fit.kind == "logit" else -eta * d
        mean_d, mean_dx = d, dd * np.array([1.0, *means])
    else:
        eta = fit.linear()
        p = _LINKS[fit.kind][0](eta)
        d = _LINKS[fit.kind][1](eta, p)
        dd = d * (1 - 2 * p) if fit.kind == "logit" else -eta * d
        got = rows.agg(F.avg(d), *(F.avg(dd * c) for c in design(cols).values())).first()
        mean_d, mean_dx = got[0], np.array(got[1:])
    out = []
    for j, n in enumerate(fit.names[1:], 1):
        grad = fit.params[j] * mean_dx
        grad[j] += mean_d
        effect, se = fit.params[j] * mean_d, math.sqrt(grad @ fit.cov @ grad)
        out.append({"term": n, "effect": effect, "se": se, "statistic": effect / se, "p": dist.norm_two(effect / se)})
    return frame(df.sparkSession, out)


def estat(df: DataFrame, fit: Fit, test: str) -> DataFrame:
    """hettest (Breusch-Pagan), ovtest (RESET, powers 2 and 3), linktest, or ic."""
    spark, f = df.sparkSession, fit.formula
    if test == "ic":
        return frame(spark, [{"n": fit.n, "ll": fit.stats["ll"], "aic": fit.stats["aic"], "bic": fit.stats["bic"]}])
    rows = predict(residuals(complete(df, {**regressors(f), Y: col(f.y)}), fit, "__e"), fit, "__f")
    if test == "hettest":
        aux = ols(rows.withColumn("__e2", F.col("__e") ** 2), Formula("__e2", f.terms))
        lm = fit.n * aux.stats["r2"]
        return frame(spark, [{"test": test, "statistic": lm, "df": len(f.terms), "p": dist.chi2_sf(lm, len(f.terms))}])
    mean, sd = rows.agg(F.avg("__f"), F.stddev_samp("__f")).first()
    rows = rows.withColumn("__z", (F.col("__f") - mean) / (sd or 1.0))
    if test == "linktest":
        # the square's test is the same for fitted values in standard units, which keep it apart from the values themselves
        link = ols(rows.withColumn("hat", F.col("__z")).withColumn("hatsq", F.col("__z") ** 2), f"{f.y} ~ hat + hatsq")
        r = link.rows()[2]
        return frame(spark, [{"test": test, "statistic": r["statistic"], "df": link.df_resid, "p": r["p"]}])
    wide = ols(rows.withColumn("__z2", F.col("__z") ** 2).withColumn("__z3", F.col("__z") ** 3), Formula(f.y, (*f.terms, ("__z2",), ("__z3",))))
    stat = (fit.stats["rss"] - wide.stats["rss"]) / 2 / (wide.stats["rss"] / wide.df_resid)
    return frame(spark, [{"test": test, "statistic": stat, "df": 2, "p": dist.f_sf(stat, 2, wide.df_resid)}])


# instrumental variables, panels, surveys


def ivregress(df: DataFrame, y: str, exog: Sequence[str], endog: Sequence[str], instruments: Sequence[str], robust: bool = False) -> Fit:
    """Two-stage least squares from one pass over [y, exogenous, endogenous, instruments]."""
    every = [*exog, *endog, *instruments]
    m = moments(df, {**{c: col(c) for c in every}, Y: col(y)})
    x, z = [CONST, *exog, *endog], [CONST, *exog, *instruments]
    xz, zz = m.block(x, z), _inverse(m.block(z, z))
    a = _inverse(xz @ zz @ xz.T)
    b = a @ xz @ zz @ m.block(z, [Y])[:, 0]
    rss = float(m.block([Y], [Y])[0, 0] - 2 * b @ m.block(x, [Y])[:, 0] + b @ m.block(x, x) @ b)
    fit = Fit("iv", x, b, a * rss / m.n, m.n, m.n - len(x), {"rss": rss}, Formula(y, tuple((c,) for c in x[1:])), normal=True)
    rows = complete(df, {**{c: col(c) for c in every}, Y: col(y)})
    if robust:
        zc = {c: col(c) for c in z[1:]}
        meat, _ = _meat(rows, zc, col(y).cast("double") - fit.linear(), None)
        proj = a @ xz @ zz
        fit.cov = proj @ meat @ proj.T
    total = m.block([Y], [Y])[0, 0] - m.block([CONST], [Y])[0, 0] ** 2 / m.n
    fit.stats["r2"] = 1 - rss / total
    for e in endog:
        _, _, full = _solve(m, z, e)
        _, _, small = _solve(m, [CONST, *exog], e)
        q = len(instruments)
        fit.stats[f"first_stage_f_{e}"] = (small - full) / q / (full / (m.n - len(z)))
    u = m.block(z, [Y])[:, 0] - m.block(z, x) @ b
    fit.stats["sargan"] = float(u @ zz @ u / (rss / m.n)) if len(instruments) > len(endog) else 0.0
    fit.stats["sargan_p"] = dist.chi2_sf(fit.stats["sargan"], len(instruments) - len(endog)) if len(instruments) > len(endog) else 1.0
    return fit


def endogtest(df: DataFrame, y: str, exog: Sequence[str], endog: Sequence[str], instruments: Sequence[str]) -> DataFrame:
    """Wu-Hausman: the first-stage residuals in the structural equation."""
    rows = complete(df, {c: col(c) for c in (y, *exog, *endog, *instruments)})
    for i, e in enumerate(endog):
        first = ols(rows, Formula(e, tuple((c,) for c in (*exog, *instruments))))
        # beside e, fitted values test what residuals do; the one that is less like e keeps more digits
        rows = (residuals if first.stats["r2"] > 0.5 else predict)(rows, first, f"__v{i}")
    wide = ols(rows, Formula(y, tuple((c,) for c in (*exog, *endog, *(f"__v{i}" for i in range(len(endog)))))))
    q = len(endog)
    # the same number as the difference of both models' squared residuals, which is lost in their rounding over many rows
    b = wide.params[-q:]
    f = float(b @ _inverse(wide.cov[-q:, -q:]) @ b) / q
    return frame(df.sparkSession, [{"statistic": f, "df1": q, "df2": float(wide.df_resid), "p": dist.f_sf(f, q, wide.df_resid)}])


def xtreg(df: DataFrame, spec: str | Formula, entity: str, how: str = "fe", robust: bool = False, cluster: bool = False) -> Fit:
    """Panel regression: within (fe), between (be), or Swamy-Arora random effects (re)."""
    f = parse(spec)
    x = regressors(f)
    cols = {**x, Y: col(f.y)}
    rows = complete(df, cols).where(col(entity).isNotNull()).select(col(entity).alias("__g"), *(c.cast("double").alias(f"v{i}") for i, c in enumerate(cols.values())))
    k = len(x)
    means = rows.groupBy("__g").agg(F.count("*").alias("t"), *(F.avg(f"v{i}").alias(f"m{i}") for i in range(k + 1)))
    groups = means.count()
    between = means.select(*(F.col(f"m{i}").alias(f"v{i}") for i in range(k + 1)), "t")
    spec_of = Formula(f"v{k}", tuple((f"v{i}",) for i in range(k)))
    if how == "be":
        fit = ols(between, spec_of)
        return Fit("be", [CONST, *x], fit.params, fit.cov, fit.n, fit.df_resid, fit.stats, f)
    joined = rows.join(means, "__g")
    grand = rows.agg(*(F.avg(f"v{i}") for i in range(k + 1))).first()
    within = joined.select("__g", "t", *((F.col(f"v{i}") - F.col(f"m{i}") + F.lit(grand[i])).alias(f"v{i}") for i in range(k + 1)))
    fe = ols(within, spec_of, robust=robust, cluster="__g" if cluster else None)
    n = fe.n
    if how == "fe":
        d = n - groups - k
        cov = fe.cov * (fe.df_resid / d if not (robust or cluster) else 1.0)
        return Fit("fe", [CONST, *x], fe.params, cov, n, d, {**fe.stats, "groups": groups}, f)
    s2e = fe.stats["rss"] / (n - groups - k)
    be = ols(between, spec_of)
    tbar = groups / means.agg(F.sum(1 / F.col("t"))).first()[0]
    s2u = max(0.0, be.stats["rss"] / (groups - k - 1) - s2e / tbar)
    theta = 1 - F.sqrt(F.lit(s2e) / (F.col("t") * s2u + s2e))
    quasi = joined.select((1 - theta).alias("k0"), *((F.col(f"v{i}") - theta * F.col(f"m{i}")).alias(f"v{i}") for i in range(k + 1)))
    m = moments(quasi, {"k0": F.col("k0"), **{f"v{i}": F.col(f"v{i}") for i in range(k + 1)}})
    b, inv, rss = _solve(m, ["k0", *(f"v{i}" for i in range(k))], f"v{k}")
    return Fit("re", [CONST, *x], b, inv * rss / (n - k - 1), n, n - k - 1, {"sigma2_u": s2u, "sigma2_e": s2e, "rss": rss, "groups": groups}, f)


def hausman(df: DataFrame, fe: Fit, re: Fit) -> DataFrame:
    d = fe.params[1:] - re.params[1:]
    v = fe.cov[1:, 1:] - re.cov[1:, 1:]
    stat = float(d @ np.linalg.pinv(v) @ d)
    return frame(df.sparkSession, [{"statistic": abs(stat), "df": len(d), "p": dist.chi2_sf(abs(stat), len(d))}])


def did(df: DataFrame, y: str, treated: str, post: str, robust: bool = False, cluster: str | None = None) -> Fit:
    """Difference in differences: the interaction's coefficient."""
    return ols(df, Formula(y, ((treated,), (post,), (treated, post))), robust, cluster)


def svy_summary(df: DataFrame, columns: Sequence[str], weight: str) -> DataFrame:
    """n, weighted mean and its linearised error."""
    parts = []
    for c in columns:
        x, w = col(c).cast("double"), col(weight).cast("double")
        rows = df.where(x.isNotNull() & w.isNotNull())
        n, sw, mean = rows.agg(F.count("*"), F.sum(w), F.sum(w * x) / F.sum(w)).first()
        ss = rows.agg(F.sum((w * (x - mean)) ** 2)).first()[0]
        parts.append({"variable": c, "n": n, "mean": mean, "se": math.sqrt(ss * n / (n - 1)) / sw})
    return frame(df.sparkSession, parts)


def survey_meat(rows: DataFrame, score: Column, cols: Mapping[str, Column], strata: str | None, psu: str | None) -> np.ndarray:
    """Sum over strata of the spread of the primary units' score sums, each with n / (n - 1)."""
    keys = [(col(strata) if strata else F.lit(0)).alias("__s"), (col(psu) if psu else F.monotonically_increasing_id()).alias("__p")]
    x = list(cols.values())
    sums = rows.groupBy(*keys).agg(*(F.sum(score * c).alias(f"s{i}") for i, c in enumerate(x)))
    k = len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    per = sums.groupBy("__s").agg(F.count("*").alias("n"), *(F.covar_samp(f"s{i}", f"s{j}").alias(f"c{i}_{j}") for i, j in pairs))
    got = per.agg(*(F.sum(F.when(F.col("n") > 1, F.col("n") * F.col(f"c{i}_{j}"))) for i, j in pairs)).first()
    meat = np.zeros((k, k))
    meat[np.triu_indices(k)] = [v or 0.0 for v in got]
    return meat + np.triu(meat, 1).T


def svy_ols(df: DataFrame, spec: str | Formula, weight: str, strata: str | None = None, psu: str | None = None) -> Fit:
    """Weighted least squares; errors from score sums of the primary units within strata."""
    f = parse(spec)
    x = regressors(f)
    fit = ols(df, f, weight=weight)
    m = moments(df, {**x, Y: col(f.y)}, col(weight))
    bread = _inverse(m.block([CONST, *x], [CONST, *x]))
    rows = complete(df, {**x, Y: col(f.y), "w": col(weight)})
    e = col(weight).cast("double") * (col(f.y).cast("double") - fit.linear())
    fit.cov = bread @ survey_meat(rows, e, design(x), strata, psu) @ bread
    fit.kind = "svy_ols"
    return fit


def design_effect(df: DataFrame, weight: str) -> DataFrame:
    """Kish's n * sum(w^2) / sum(w)^2."""
    w = col(weight).cast("double")
    return df.agg((F.count(w) * F.sum(w * w) / (F.sum(w) * F.sum(w))).alias("deff"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"))


# penalised and latent regressions


def _standard(df: DataFrame, y: str, columns: Sequence[str]) -> tuple[Moments, np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    m = moments(df, {**{c: col(c) for c in columns}, Y: col(y)})
    mean = m.block([CONST], [*columns, Y])[0] / m.n
    c = m.block([*columns, Y], [*columns, Y]) / m.n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(c)[:-1])
    return m, c[:-1, :-1] / np.outer(sd, sd), c[:-1, -1] / sd, sd, mean[-1], mean[:-1]


def _penalised(df: DataFrame, y: str, columns: Sequence[str], b: np.ndarray, mean_y: float) -> DataFrame:
    rows = [{"term": CONST, "coef": mean_y}, *({"term": c, "coef": v} for c, v in zip(columns, b, strict=True))]
    return frame(df.sparkSession, rows, "term string, coef double")


def ridge(df: DataFrame, y: str, columns: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """Coefficients of the z-scored columns; alpha is not divided by n."""
    m, r, c, _, my, _ = _standard(df, y, columns)
    return _penalised(df, y, columns, np.linalg.solve(r * m.n + alpha * np.eye(len(columns)), c * m.n), my)


def coordinate_descent(r: np.ndarray, c: np.ndarray, alpha: float, l1: float, steps: int = 2000) -> np.ndarray:
    """Minimises b'rb / 2 - c'b + alpha * (l1 |b|_1 + (1 - l1) / 2 |b|^2)."""
    b = np.zeros(len(c))
    for _ in range(steps):
        before = b.copy()
        for j in range(len(c)):
            z = c[j] - r[j] @ b + r[j, j] * b[j]
            b[j] = math.copysign(max(abs(z) - alpha * l1, 0), z) / (r[j, j] + alpha * (1 - l1))
        if np.abs(b - before).max() < 1e-12:
            break
    return b


def elasticnet(df: DataFrame, y: str, columns: Sequence[str], alpha: float = 1.0, l1_ratio: float = 0.5) -> DataFrame:
    _, r, c, _, my, _ = _standard(df, y, columns)
    return _penalised(df, y, columns, coordinate_descent(r, c, alpha, l1_ratio), my)


def lasso(df: DataFrame, y: str, columns: Sequence[str], alpha: float = 0.1) -> DataFrame:
    return elasticnet(df, y, columns, alpha, 1.0)


def pcr(df: DataFrame, y: str, columns: Sequence[str], components: int = 2) -> DataFrame:
    """Regression on the first principal components of the z-scored columns: component, share of variance, coefficient."""
    _, r, c, _, _, _ = _standard(df, y, columns)
    values, vectors = np.linalg.eigh(r)
    order = values.argsort()[::-1][:components]
    vectors = vectors[:, order] * np.where(vectors[np.abs(vectors[:, order]).argmax(0), order] < 0, -1, 1)
    return frame(df.sparkSession, [{"component": i + 1, "variance": values[k] / len(columns), "coef": float(vectors[:, i] @ c / values[k])} for i, k in enumerate(order)])


def pls(df: DataFrame, y: str, columns: Sequence[str], components: int = 2) -> DataFrame:
    """Partial least squares from the correlations (SIMPLS): coefficients of the z-scored columns."""
    _, r, c, _, my, _ = _standard(df, y, columns)
    basis, b, s = [], np.zeros(len(columns)), c.copy()
    for _ in range(min(components, len(columns))):
        w = s / max(math.sqrt(s @ r @ s), 1e-300)
        load = r @ w
        b = b + w * (w @ c)
        for v in basis:
            load = load - v * (v @ load)
        load /= np.linalg.norm(load)
        basis.append(load)
        s = s - load * (load @ s)
    return _penalised(df, y, columns, b, my)


def mediation(df: DataFrame, y: str, m: str, x: str) -> DataFrame:
    """Baron and Kenny's paths a, b, c, c', the indirect effect and Sobel's test."""
    total, first = ols(df, f"{y} ~ {x}"), ols(df, f"{m} ~ {x}")
    both = ols(df, f"{y} ~ {x} + {m}")
    a, sa, b, sb = first.params[1], first.se[1], both.params[2], both.se[2]
    z = a * b / math.sqrt(a * a * sb * sb + b * b * sa * sa)
    return frame(df.sparkSession, [{"a": a, "b": b, "c": total.params[1], "c_prime": both.params[1], "indirect": a * b, "z": z, "p": dist.norm_two(z)}])


def mod_mediation(df: DataFrame, y: str, m: str, x: str, w: str) -> DataFrame:
    """Moderation of the first path: conditional indirect effects at the mean of w and a deviation around it; the index is a3 * b."""
    first, second = ols(df, f"{m} ~ {x} * {w}"), ols(df, f"{y} ~ {x} + {m}")
    mean, sd = df.agg(F.avg(col(w)), F.stddev_samp(col(w))).first()
    a, b = dict(zip(first.names, first.params, strict=True)), second.params[2]
    rows = [{"at": n, "w": v, "indirect": (a[x] + a[f"{x}:{w}"] * v) * b} for n, v in (("low", mean - sd), ("mean", mean), ("high", mean + sd))]
    return frame(df.sparkSession, [*rows, {"at": "index", "w": math.nan, "indirect": a[f"{x}:{w}"] * b}], "at string, w double, indirect double")
