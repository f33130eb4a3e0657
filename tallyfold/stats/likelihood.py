"""Maximum likelihood for models without a one-pass solution.

Executors evaluate the log likelihood of their rows at a stencil of parameter vectors in
numpy; a Newton step needs one job, in which every partition returns one vector of sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col
from tallyfold.stats.frames import complete, cross_products, few
from tallyfold.stats.regression import Fit, glm, ols, parse, regressors

LogLik = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _sums(rows: DataFrame, ll: LogLik, points: np.ndarray) -> np.ndarray:
    """The total log likelihood at each point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(points))
        for b in batches:
            a = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            if len(a):
                y, x = a[:, 0], np.column_stack((np.ones(len(a)), a[:, 1:]))
                with np.errstate(all="ignore"):
                    total += [np.nan_to_num(ll(p, x, y), nan=-1e10, neginf=-1e10).sum() for p in points]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(points))), pa.array(total)], names=["i", "s"])

    got = rows.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(len(points))
    for r in got:
        out[r["i"]] = r["s"]
    return out


def _stencil(b: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    k = len(b)
    e = np.diag(h)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    points = [b, *(b + e[i] for i in range(k)), *(b - e[i] for i in range(k))]
    for i, j in pairs:
        points += [b + e[i] + e[j], b - e[i] - e[j]]
    return np.array(points), pairs


def maximise(rows: DataFrame, ll: LogLik, start: Sequence[float], steps: int = 40) -> tuple[np.ndarray, np.ndarray, float]:
    """Parameters, their covariance (inverse negative Hessian) and the log likelihood."""
    b, damp = np.array(start, float), 1e-3
    for _ in range(steps):
        h = 1e-4 * np.maximum(1, np.abs(b))
        points, pairs = _stencil(b, h)
        v = _sums(rows, ll, points)
        k = len(b)
        up, down = v[1 : 1 + k], v[1 + k : 1 + 2 * k]
        grad, hess = (up - down) / (2 * h), np.diag((up + down - 2 * v[0]) / h**2)
        for n, (i, j) in enumerate(pairs):
            both = v[1 + 2 * k + 2 * n] + v[2 + 2 * k + 2 * n]
            hess[i, j] = hess[j, i] = (both - up[i] - down[i] - up[j] - down[j] + 2 * v[0]) / (2 * h[i] * h[j])
        values, vectors = np.linalg.eigh(-hess)
        values = np.maximum(np.abs(values), 1e-8 * np.abs(values).max())
        step = vectors @ ((vectors.T @ grad) / values)
        if np.abs(step / np.maximum(1, np.abs(b))).max() < 1e-6:
            b = b + step
            break
        scales = np.array([1.0, 0.5, 0.25, 0.1, 0.02, 0.004])
        tried = _sums(rows, ll, np.array([b + s * step for s in scales]))
        best = int(tried.argmax())
        if tried[best] <= v[0] + 1e-10 * abs(v[0]):
            break
        b = b + scales[best] * step
    del damp
    return b, vectors @ np.diag(1 / values) @ vectors.T, float(v[0])


#: The cluster of a row, beside y and the regressors.
GROUP = "__cluster"


def _rows(df: DataFrame, y: str, x: Mapping[str, Column], cluster: str | None = None) -> DataFrame:
    t = col(y).cast("double")
    rows = complete(df, {**x, "y": t})
    if cluster:
        rows = rows.where(col(cluster).isNotNull())
    return rows.select(t.alias("y"), *(c.cast("double").alias(f"x{i}") for i, c in enumerate(x.values())), *([F.xxhash64(col(cluster)).alias(GROUP)] if cluster else [])).persist()


def _meat(rows: DataFrame, ll: LogLik, b: np.ndarray, cluster: bool) -> tuple[np.ndarray, int]:
    """The sum over rows, or over clusters' sums, of the scores' products, and the rows or clusters.

    Scores are central differences of a row's log likelihood. A task adds up its rows of a
    cluster before they are shuffled.
    """
    k, step = len(b), 1e-5 * np.maximum(1, np.abs(b))
    own = [f"s{i}" for i in range(k)]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        for batch in batches:
            group = batch.column(GROUP).to_pandas() if cluster else None
            a = np.column_stack([c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != GROUP])
            y, x = a[:, 0], np.column_stack((np.ones(len(a)), a[:, 1:]))
            with np.errstate(all="ignore"):
                s = np.column_stack([(ll(b + e, x, y) - ll(b - e, x, y)) / (2 * e[i]) for i, e in enumerate(np.diag(step))])
            out = pd.DataFrame(s, columns=own)
            if cluster:
                out = out.groupby(group.to_numpy()).sum().rename_axis(GROUP).reset_index()
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    made = rows.mapInArrow(scores, (f"{GROUP} long, " if cluster else "") + ", ".join(f"{c} double" for c in own))
    if cluster:
        made = made.groupBy(GROUP).agg(*(F.sum(c).alias(c) for c in own))
    row = made.agg(F.count("*"), *cross_products({c: F.col(c) for c in own}, None)).first()
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = row[1:]
    return out + np.triu(out, 1).T, int(row[0])


def _fit(df: DataFrame, spec: str, kind: str, ll: LogLik, start: Callable[[DataFrame, int], Sequence[float]], names: Callable[[list[str]], list[str]], robust: bool = False, cluster: str | None = None) -> Fit:
    """The fit of all complete rows; `robust` and `cluster` give sandwich errors, with n / (n - 1) or G / (G - 1)."""
    f = parse(spec)
    x = regressors(f)
    rows = _rows(df, f.y, x, cluster)
    plain = rows.drop(GROUP)
    b, cov, value = maximise(plain, ll, start(plain, len(x)))
    n = plain.count()
    if robust or cluster:
        meat, g = _meat(rows, ll, b, bool(cluster))
        cov = cov @ meat @ cov * g / (g - 1)
    rows.unpersist()
    own = names(list(x))
    return Fit(kind, own, b, cov, n, n - len(b), {"ll": value, "aic": 2 * len(b) - 2 * value, "bic": len(b) * math.log(n) - 2 * value}, f, normal=True)


_lgamma = np.vectorize(math.lgamma, otypes=[float])
_Phi = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), otypes=[float])


def _nb_ll(mu: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    r = 1 / alpha
    uniq, at = np.unique(y, return_inverse=True)
    const = (_lgamma(uniq + r) - _lgamma(uniq + 1))[at] - math.lgamma(r)
    return const + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))


def _poisson_ll(mu: np.ndarray, y: np.ndarray) -> np.ndarray:
    uniq, at = np.unique(y, return_inverse=True)
    return y * np.log(mu) - mu - _lgamma(uniq + 1)[at]


def _log_mean(rows: DataFrame) -> float:
    return math.log(max(rows.agg(F.avg("y")).first()[0], 1e-6))


def negbin(df: DataFrame, spec: str, robust: bool = False, cluster: str | None = None) -> Fit:
    """Negative binomial with variance m + alpha * m^2; the last parameter is ln alpha."""
    return _fit(df, spec, "negbin", lambda p, x, y: _nb_ll(np.exp(x @ p[:-1]), y, math.exp(min(p[-1], 20))), lambda r, k: [_log_mean(r), *[0.0] * k, -1.0], lambda x: ["const", *x, "ln_alpha"], robust, cluster)


def _inflated(p: np.ndarray, base: np.ndarray, base0: np.ndarray, y: np.ndarray) -> np.ndarray:
    q = 1 / (1 + math.exp(-p))
    return np.where(y == 0, np.log(q + (1 - q) * np.exp(base0)), math.log(max(1 - q, 1e-300)) + base)


def zip_model(df: DataFrame, spec: str, robust: bool = False, cluster: str | None = None) -> Fit:
    """Poisson with a constant share of extra zeros; the last parameter is that share's logit."""

    def ll(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        mu = np.exp(x @ p[:-1])
        return _inflated(p[-1], _poisson_ll(mu, y), -mu, y)

    return _fit(df, spec, "zip", ll, lambda r, k: [_log_mean(r), *[0.0] * k, -1.0], lambda x: ["const", *x, "inflate"], robust, cluster)


def zinb(df: DataFrame, spec: str, robust: bool = False, cluster: str | None = None) -> Fit:
    def ll(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        mu, a = np.exp(x @ p[:-2]), math.exp(min(p[-2], 20))
        return _inflated(p[-1], _nb_ll(mu, y, a), -np.log1p(a * mu) / a, y)

    return _fit(df, spec, "zinb", ll, lambda r, k: [_log_mean(r), *[0.0] * k, -1.0, -1.0], lambda x: ["const", *x, "ln_alpha", "inflate"], robust, cluster)


def hurdle(df: DataFrame, spec: str) -> tuple[Fit, Fit]:
    """A logit of y > 0, and a Poisson model of the positive rows (not truncated)."""
    f = parse(spec)
    first = glm(df.withColumn("__pos", (col(f.y) > 0).cast("double")), type(f)("__pos", f.terms), "logit")
    return first, glm(df.where(col(f.y) > 0), f, "poisson")


def betareg(df: DataFrame, spec: str, robust: bool = False, cluster: str | None = None) -> Fit:
    """Fractional logit: the binomial likelihood of a share."""
    return glm(df, spec, "logit", robust, cluster)


def tobit(df: DataFrame, spec: str, lower: float | None = 0.0, upper: float | None = None, robust: bool = False, cluster: str | None = None) -> Fit:
    """Normal regression censored at lower and upper; the last parameter is ln sigma."""

    def ll(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = math.exp(p[-1])
        z = (y - x @ p[:-1]) / s
        out = -0.5 * z * z - p[-1] - 0.5 * math.log(2 * math.pi)
        if lower is not None:
            at = y <= lower
            out[at] = np.log(np.maximum(_Phi((lower - x[at] @ p[:-1]) / s), 1e-300)) if at.any() else out[at]
        if upper is not None:
            at = y >= upper
            out[at] = np.log(np.maximum(_Phi((x[at] @ p[:-1] - upper) / s), 1e-300)) if at.any() else out[at]
        return out

    base = ols(df, spec)
    return _fit(df, spec, "tobit", ll, lambda r, k: [*base.params, math.log(base.stats["rmse"])], lambda x: ["const", *x, "ln_sigma"], robust, cluster)


#: Levels of an ordered or multinomial outcome.
MOST_LEVELS = 200


def ordered(df: DataFrame, spec: str, link: str = "logit", robust: bool = False, cluster: str | None = None) -> Fit:
    """Ordered logit or probit; the cut points are reported as they are, cut1 < cut2 < ..."""
    f = parse(spec)
    shares = {r["y"]: r["count"] for r in few(df.where(col(f.y).isNotNull()).groupBy(col(f.y).cast("double").alias("y")).count().orderBy("y"), f"levels of {f.y}", MOST_LEVELS)}
    levels = list(shares)
    k, n = len(levels), sum(shares.values())
    dist = (lambda z: 1 / (1 + np.exp(-z))) if link == "logit" else _Phi
    codes = np.array(levels)

    def cuts(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate((p[:1], np.exp(np.minimum(p[1:], 20)))))

    def ll(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        c = np.concatenate(([-np.inf], cuts(p[: k - 1]), [np.inf]))
        at, eta = np.searchsorted(codes, y), x[:, 1:] @ p[k - 1 :]
        high, low = np.where(at == k - 1, 1.0, dist(np.minimum(c[at + 1], 1e6) - eta)), np.where(at == 0, 0.0, dist(np.maximum(c[at], -1e6) - eta))
        return np.log(np.maximum(high - low, 1e-300))

    upto = np.cumsum([shares[v] for v in levels])[:-1] / n
    first = [math.log(u / (1 - u)) for u in np.clip(upto, 1e-4, 1 - 1e-4)]
    start = [first[0], *(math.log(max(b - a, 1e-3)) for a, b in zip(first, first[1:], strict=False))]
    fit = _fit(df, spec, f"o{link}", ll, lambda r, m: [*start, *[0.0] * m], lambda x: [*(f"cut{i + 1}" for i in range(k - 1)), *x], robust, cluster)
    jac = np.eye(len(fit.params))
    jac[: k - 1, : k - 1] = np.tril(np.ones((k - 1, k - 1))) * np.concatenate(([1.0], np.exp(fit.params[1 : k - 1])))
    fit.params = np.concatenate((cuts(fit.params[: k - 1]), fit.params[k - 1 :]))
    fit.cov = jac @ fit.cov @ jac.T
    return fit


def mlogit(df: DataFrame, spec: str, robust: bool = False, cluster: str | None = None) -> Fit:
    """Multinomial logit against the smallest category; names are `x (y=k)`."""
    f = parse(spec)
    levels = np.array([r[0] for r in few(df.where(col(f.y).isNotNull()).select(col(f.y).cast("double").alias("y")).distinct().orderBy("y"), f"levels of {f.y}", MOST_LEVELS)])
    k = len(levels) - 1

    def ll(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        eta = np.column_stack((np.zeros(len(x)), x @ p.reshape(k, -1).T))
        top = eta.max(axis=1)
        return eta[np.arange(len(x)), np.searchsorted(levels, y)] - top - np.log(np.exp(eta - top[:, None]).sum(axis=1))

    label = lambda v: f"{v:g}"
    return _fit(df, spec, "mlogit", ll, lambda r, m: [0.0] * (k * (m + 1)), lambda x: [f"{n} (y={label(v)})" for v in levels[1:] for n in ("const", *x)], robust, cluster)


def nls(df: DataFrame, y: str, x: str, form: str = "power", start: Sequence[float] = ()) -> Fit:
    """a * x^b (power), a * e^(b x) (exp) or a + b * ln x (log), by Gauss-Newton on aggregated products."""
    u, t = col(x).cast("double"), col(y).cast("double")
    rows = complete(df, {"x": u, "y": t}).select(u.alias("x"), t.alias("y"))
    if form in ("power", "log"):
        rows = rows.where("x > 0")
    if form == "log":
        fit = ols(rows.withColumn("lx", F.log("x")), "y ~ lx")
        fit.names = ["a", "b"]
        return fit
    seed = ols(rows.where("y > 0").withColumn("ly", F.log("y")).withColumn("lx", F.log("x") if form == "power" else F.col("x")), "ly ~ lx")
    a, b = start or (math.exp(seed.params[0]), seed.params[1])
    xc, yc = F.col("x"), F.col("y")
    for _ in range(50):
        g = F.pow(xc, F.lit(b)) if form == "power" else F.exp(F.lit(b) * xc)
        d = F.lit(a) * g * (F.log(xc) if form == "power" else xc)
        e = yc - F.lit(a) * g
        gg, gd, dd, ge, de, ee, n = rows.agg(F.sum(g * g), F.sum(g * d), F.sum(d * d), F.sum(g * e), F.sum(d * e), F.sum(e * e), F.count("*")).first()
        h = np.array([[gg, gd], [gd, dd]])
        step = np.linalg.solve(h, [ge, de])
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-10 * (1 + abs(a) + abs(b)):
            break
    return Fit("nls", ["a", "b"], np.array([a, b]), np.linalg.inv(h) * ee / (n - 2), n, n - 2, {"rss": ee})
