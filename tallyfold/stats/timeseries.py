"""Time series. Lagged columns come from ordered frames, regressions from aggregated products.

Models that walk along a series (ARIMA, GARCH, STL, change points) take one series to
one task; with `by` every series is a group of its own and groups run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dsl import Formula
from tallyfold.functions.exprs import col
from tallyfold.operators.ordered import framed
from tallyfold.stats import dist
from tallyfold.stats.frames import frame
from tallyfold.stats.regression import Fit, ols

#: Values of one series that a single task may hold.
MOST_VALUES = 2_000_000


def lagged(df: DataFrame, columns: Sequence[str], lags: int, order: Sequence[str], diff: bool = False) -> DataFrame:
    """df with `<c>_l1` ... and, with diff, `<c>_d` (first difference) and its lags `<c>_d1` ..."""

    def make(w) -> dict:
        out = {}
        for c in columns:
            for k in range(1, lags + 1):
                out[f"{c}_l{k}"] = F.lag(col(c), k).over(w)
            if diff:
                out[f"{c}_d"] = col(c) - F.lag(col(c), 1).over(w)
                for k in range(1, lags + 1):
                    out[f"{c}_d{k}"] = F.lag(col(c), k).over(w) - F.lag(col(c), k + 1).over(w)
        return out

    return framed(df, order, lags + 1, 0, make)


#: MacKinnon's (1994) polynomials for the p value of the unit-root t statistic with a constant.
_ADF_SMALL, _ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
_ADF_STAR, _ADF_MIN, _ADF_MAX = -1.61, -18.83, 2.74


def adf_p(t: float) -> float:
    if t > _ADF_MAX or t < _ADF_MIN:
        return float(t > _ADF_MAX)
    poly = _ADF_SMALL if t <= _ADF_STAR else _ADF_LARGE
    return dist.norm_cdf(sum(c * t**i for i, c in enumerate(poly)))


def dickey_fuller(df: DataFrame, column: str, order: Sequence[str], most: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller with a constant; the lags that give the least AIC over one common sample."""
    rows = df.where(col(column).isNotNull()).select(*(col(o) for o in order), col(column).cast("double").alias("y"))
    n = rows.count()
    top = most if most is not None else int(math.ceil(12 * (n / 100) ** 0.25))
    top = min(top, n // 2 - 2, 20)
    lags = lagged(rows, ["y"], max(top, 1), order, diff=True).where(F.col(f"y_d{max(top, 1)}").isNotNull()).persist()
    terms = lambda p: Formula("y_d", (("y_l1",), *((f"y_d{k}",) for k in range(1, p + 1))))
    best = min(range(top + 1), key=lambda p: ols(lags, terms(p)).stats["aic"])
    lags.unpersist()
    rows = lagged(rows, ["y"], max(best, 1), order, diff=True).where(F.col("y_d").isNotNull() & (F.col(f"y_d{best}").isNotNull() if best else F.lit(True)))
    fit = ols(rows, terms(best))
    t = fit.params[1] / fit.se[1]
    return frame(df.sparkSession, [{"statistic": t, "p": adf_p(t), "lags": best, "n": fit.n}])


def granger(df: DataFrame, y: str, cause: str, order: Sequence[str], most: int = 4) -> DataFrame:
    """The F test that lags 1..k of `cause` add nothing to those of y, for k up to `most`."""
    out = []
    for k in range(1, most + 1):
        rows = lagged(df, [y, cause], k, order).where(col(f"{y}_l{k}").isNotNull() & col(f"{cause}_l{k}").isNotNull())
        own, other = tuple((f"{y}_l{i}",) for i in range(1, k + 1)), tuple((f"{cause}_l{i}",) for i in range(1, k + 1))
        small, full = ols(rows, Formula(y, own)), ols(rows, Formula(y, own + other))
        f = (small.stats["rss"] - full.stats["rss"]) / k / (full.stats["rss"] / full.df_resid)
        out.append({"lag": k, "f": f, "df1": k, "df2": int(full.df_resid), "p": dist.f_sf(f, k, full.df_resid)})
    return frame(df.sparkSession, out)


def var_model(df: DataFrame, columns: Sequence[str], lags: int, order: Sequence[str]) -> list[Fit]:
    """A vector autoregression, equation by equation."""
    rows = lagged(df, columns, lags, order)
    for c in columns:
        rows = rows.where(col(f"{c}_l{lags}").isNotNull())
    terms = tuple((f"{c}_l{k}",) for k in range(1, lags + 1) for c in columns)
    return [ols(rows, Formula(c, terms)) for c in columns]


def var_matrices(fits: Sequence[Fit], lags: int) -> tuple[np.ndarray, list[np.ndarray]]:
    k = len(fits)
    return np.array([f.params[0] for f in fits]), [np.array([f.params[1 + i * k : 1 + (i + 1) * k] for f in fits]) for i in range(lags)]


def impulse_responses(df: DataFrame, fits: Sequence[Fit], lags: int, steps: int = 10) -> DataFrame:
    """step, impulse, response and value of the moving-average matrices."""
    names = [f.formula.y for f in fits]
    _, a = var_matrices(fits, lags)
    psi = [np.eye(len(names))]
    for h in range(1, steps + 1):
        psi.append(sum(psi[h - i - 1] @ a[i] for i in range(min(lags, h))))
    return frame(df.sparkSession, [{"step": h, "impulse": names[j], "response": names[i], "value": m[i, j]} for h, m in enumerate(psi) for j in range(len(names)) for i in range(len(names))])


def var_forecast(df: DataFrame, fits: Sequence[Fit], lags: int, order: Sequence[str], steps: int) -> DataFrame:
    names = [f.formula.y for f in fits]
    c, a = var_matrices(fits, lags)
    last = df.orderBy(*(col(o).desc() for o in order)).select(*map(col, names)).limit(lags).collect()
    hist = [np.array(r, float) for r in last]
    out = []
    for h in range(1, steps + 1):
        y = c + sum(a[i] @ hist[i] for i in range(lags))
        hist.insert(0, y)
        out.append({"step": h, **dict(zip(names, y, strict=True))})
    return frame(df.sparkSession, out)


def johansen(df: DataFrame, columns: Sequence[str], order: Sequence[str], lags: int = 1) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Trace and maximum-eigenvalue statistics with a constant; also the eigenvectors and the loadings."""
    from tallyfold.stats.frames import moments

    rows = lagged(df, columns, lags + 1, order, diff=True)
    for c in columns:
        rows = rows.where(col(f"{c}_d{lags}").isNotNull()) if lags else rows.where(col(f"{c}_d").isNotNull())
    d, level, past = [f"{c}_d" for c in columns], [f"{c}_l1" for c in columns], [f"{c}_d{k}" for k in range(1, lags + 1) for c in columns]
    m = moments(rows, {c: col(c) for c in [*d, *level, *past]})
    z = ["const", *past]
    zi = np.linalg.pinv(m.block(z, z))
    part = lambda a, b: (m.block(a, b) - m.block(a, z) @ zi @ m.block(z, b)) / m.n
    s00, s01, s11 = part(d, d), part(d, level), part(level, level)
    w, v = np.linalg.eig(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01)))
    order_ = np.argsort(-w.real)
    w, v = np.clip(w.real[order_], 0, 1 - 1e-12), v.real[:, order_]
    v = v / np.sqrt(np.diag(v.T @ s11 @ v))
    logs = -m.n * np.log(1 - w)
    out = frame(df.sparkSession, [{"rank": r, "eigenvalue": w[r], "trace": float(logs[r:].sum()), "max_eigen": float(logs[r])} for r in range(len(w))])
    return out, v, s01 @ v


def vecm(df: DataFrame, columns: Sequence[str], order: Sequence[str], lags: int = 1, rank: int = 1) -> DataFrame:
    """Cointegrating vectors (beta, the first coefficient 1) and loadings (alpha)."""
    _, v, loads = johansen(df, columns, order, lags)
    beta, alpha = v[:, :rank], loads[:, :rank]
    scale = beta[0]
    return frame(df.sparkSession, [{"vector": r + 1, "variable": c, "beta": beta[i, r] / scale[r], "alpha": alpha[i, r] * scale[r]} for r in range(rank) for i, c in enumerate(columns)])


def _per_series(df: DataFrame, columns: Sequence[str], order: Sequence[str], by: Sequence[str], fit, schema: str) -> DataFrame:
    """fit(values in order: array of len(columns) columns) for each series, in one task each."""
    rows = df.select(*(col(b).cast("string").alias(f"g{i}") for i, b in enumerate(by)), *(col(o).alias(f"o{i}") for i, o in enumerate(order)), *(col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)))
    keys = [f"g{i}" for i in range(len(by))]
    names = ", ".join(f"g{i} string" for i in range(len(by)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_VALUES:
            raise ValueError(f"a series of {len(pdf)} values; one task takes {MOST_VALUES}")
        pdf = pdf.sort_values([f"o{i}" for i in range(len(order))])
        x = pdf[[f"v{i}" for i in range(len(columns))]].to_numpy()
        out = pd.DataFrame(fit(x[~np.isnan(x).any(axis=1)]))
        for i, k in enumerate(key[: len(by)]):
            out.insert(i, f"g{i}", k)
        return out

    whole = f"{names}, {schema}" if names else schema
    grouped = rows.groupBy(*keys) if keys else rows.groupBy(F.lit(1).alias("__one"))
    out = grouped.applyInPandas(lambda key, pdf: run(key, pdf), whole)
    for i, b in enumerate(by):
        out = out.withColumnRenamed(f"g{i}", b)
    return out


def _simplex(f, start: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Nelder and Mead's search for a minimum."""
    n = len(start)
    pts = [np.array(start, float), *(np.array(start, float) + np.eye(n)[i] * max(0.1, abs(start[i]) * 0.2) for i in range(n))]
    vals = [f(p) for p in pts]
    for _ in range(steps):
        o = np.argsort(vals)
        pts, vals = [pts[i] for i in o], [vals[i] for i in o]
        if abs(vals[-1] - vals[0]) < 1e-10 * (1 + abs(vals[0])):
            break
        mid = np.mean(pts[:-1], axis=0)
        r = mid + (mid - pts[-1])
        fr = f(r)
        if fr < vals[0]:
            e = mid + 2 * (mid - pts[-1])
            fe = f(e)
            pts[-1], vals[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = r, fr
        else:
            c = mid + 0.5 * (pts[-1] - mid)
            fc = f(c)
            if fc < vals[-1]:
                pts[-1], vals[-1] = c, fc
            else:
                pts = [pts[0], *(pts[0] + 0.5 * (p - pts[0]) for p in pts[1:])]
                vals = [vals[0], *(f(p) for p in pts[1:])]
    return pts[int(np.argmin(vals))]


def _arma_errors(x: np.ndarray, c: float, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    e = np.zeros(len(x))
    for t in range(len(x)):
        v = x[t] - c
        for i, a in enumerate(ar):
            v -= a * ((x[t - 1 - i] - c) if t > i else 0.0)
        for j, m in enumerate(ma):
            v -= m * (e[t - 1 - j] if t > j else 0.0)
        e[t] = v
    return e


def arima(df: DataFrame, column: str, order: Sequence[str], pdq: tuple[int, int, int] = (1, 0, 0), by: Sequence[str] = (), steps: int = 0) -> DataFrame:
    """term and value: conditional-sum-of-squares estimates, sigma2 and aic, and `steps` forecasts (forecast_1, ...)."""
    p, d, q = pdq

    def fit(v: np.ndarray) -> dict:
        x = np.diff(v[:, 0], d) if d else v[:, 0]
        lag = np.column_stack([x[p - i - 1 : len(x) - i - 1] for i in range(p)]) if p else np.zeros((len(x), 0))
        a0 = np.linalg.lstsq(lag - x.mean(), x[p:] - x.mean(), rcond=None)[0] if p else np.zeros(0)
        start = np.concatenate(([x.mean()], a0, np.zeros(q)))
        best = _simplex(lambda b: float((_arma_errors(x, b[0], b[1 : 1 + p], b[1 + p :])[p:] ** 2).sum()), start)
        c, ar, ma = best[0], best[1 : 1 + p], best[1 + p :]
        e = _arma_errors(x, c, ar, ma)
        s2 = float((e[p:] ** 2).mean())
        ll = -0.5 * (len(x) - p) * (math.log(2 * math.pi * s2) + 1)
        xs, es, out = list(x), list(e), []
        for _ in range(steps):
            out.append(c + sum(a * (xs[-1 - i] - c) for i, a in enumerate(ar)) + sum(m * es[-1 - j] for j, m in enumerate(ma)))
            xs.append(out[-1])
            es.append(0.0)
        for k in range(d):
            last = np.diff(v[:, 0], d - 1 - k)[-1] if d - 1 - k else v[-1, 0]
            out = list(last + np.cumsum(out))
        terms = ["const", *(f"ar{i + 1}" for i in range(p)), *(f"ma{i + 1}" for i in range(q)), "sigma2", "aic", *(f"forecast_{i + 1}" for i in range(steps))]
        return {"term": terms, "value": [*best, s2, 2 * (p + q + 2) - 2 * ll, *out]}

    return _per_series(df, [column], order, by, fit, "term string, value double")


def garch(df: DataFrame, column: str, order: Sequence[str], p: int = 1, q: int = 1, model: str = "GARCH", by: Sequence[str] = ()) -> DataFrame:
    """term and value of ARCH (q = 0), GARCH, GJR-GARCH or EGARCH on 100 times the series, normal errors."""

    def fit(v: np.ndarray) -> dict:
        x = 100 * v[:, 0]
        mu0, var0 = x.mean(), x.var()
        leverage = model in ("GJR-GARCH", "EGARCH")

        def negll(b: np.ndarray) -> float:
            e = x - b[0]
            w, a, be, g = b[1], b[2 : 2 + p], b[2 + p : 2 + p + q], b[2 + p + q] if leverage else 0.0
            h = np.full(len(x), var0)
            if model == "EGARCH":
                lh = np.full(len(x), math.log(var0))
                for t in range(max(p, q), len(x)):
                    z = e[t - 1] / math.exp(lh[t - 1] / 2)
                    lh[t] = min(max(w + sum(a[i] * (abs(z) - math.sqrt(2 / math.pi)) for i in range(p)) + g * z + sum(be[j] * lh[t - 1 - j] for j in range(q)), -30), 30)
                h = np.exp(lh)
            else:
                if w <= 0 or (a < 0).any() or (be < 0).any() or a.sum() + be.sum() + g / 2 >= 1:
                    return 1e12
                for t in range(max(p, q), len(x)):
                    h[t] = w + sum((a[i] + g * (e[t - 1 - i] < 0)) * e[t - 1 - i] ** 2 for i in range(p)) + sum(be[j] * h[t - 1 - j] for j in range(q))
            return 0.5 * float((np.log(2 * math.pi * h) + e * e / h).sum())

        start = np.concatenate(([mu0, 0.1 * (math.log(var0) if model == "EGARCH" else var0)], np.full(p, 0.1 / p), np.full(q, 0.8 / max(q, 1)), [0.0] * leverage))
        best = _simplex(negll, start, 600)
        terms = ["mu", "omega", *(f"alpha{i + 1}" for i in range(p)), *(f"beta{i + 1}" for i in range(q)), *(["gamma"] * leverage), "ll"]
        return {"term": terms, "value": [*best, -negll(best)]}

    return _per_series(df, [column], order, by, fit, "term string, value double")


def stl(df: DataFrame, column: str, order: Sequence[str], period: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """t, observed, trend, seasonal and resid: loess trend and loess-smoothed cycle subseries, two inner passes."""

    def loess(y: np.ndarray, span: int) -> np.ndarray:
        n, out = len(y), np.empty(len(y))
        span = min(span, n)
        x = np.arange(n)
        for i in range(n):
            low = min(max(0, i - span // 2), n - span)
            at = x[low : low + span]
            h = max(i - low, low + span - 1 - i) + 1e-12
            w = np.clip(1 - (np.abs(at - i) / (h * 1.001)) ** 3, 0, None) ** 3
            m = (w * at).sum() / w.sum()
            s = (w * (at - m) ** 2).sum()
            ym = (w * y[low : low + span]).sum() / w.sum()
            out[i] = ym + ((w * (at - m) * y[low : low + span]).sum() / s * (i - m) if s > 0 else 0.0)
        return out

    def fit(v: np.ndarray) -> dict:
        y, trend = v[:, 0], np.zeros(len(v))
        seasonal = np.zeros(len(v))
        span = int(1.5 * period / (1 - 1.5 / 7)) | 1
        for _ in range(2):
            d = y - trend
            c = np.empty(len(y))
            for k in range(period):
                c[k::period] = loess(d[k::period], 7)
            smooth = np.convolve(np.pad(c, period // 2, mode="edge"), np.ones(period) / period, "same")[period // 2 : period // 2 + len(y)]
            seasonal = c - loess(smooth, period | 1)
            trend = loess(y - seasonal, span)
        return {"t": np.arange(len(y)), "observed": y, "trend": trend, "seasonal": seasonal, "resid": y - trend - seasonal}

    return _per_series(df, [column], order, by, fit, "t long, observed double, trend double, seasonal double, resid double")


def changepoints(df: DataFrame, column: str, order: Sequence[str], n: int = 5, penalty: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """segment, first, last, mean and std from binary segmentation by squared error (`n` breaks), or PELT with a penalty."""

    def fit(v: np.ndarray) -> dict:
        y = v[:, 0]
        s, ss = np.concatenate(([0], np.cumsum(y))), np.concatenate(([0], np.cumsum(y * y)))
        cost = lambda a, b: ss[b] - ss[a] - (s[b] - s[a]) ** 2 / (b - a)
        if penalty is None:
            cuts = [0, len(y)]
            for _ in range(n):
                best = (0.0, None)
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b - a < 4:
                        continue
                    k = np.arange(a + 2, b - 1)
                    gain = cost(a, b) - (ss[k] - ss[a] - (s[k] - s[a]) ** 2 / (k - a)) - (ss[b] - ss[k] - (s[b] - s[k]) ** 2 / (b - k))
                    best = max(best, (float(gain.max()), int(k[gain.argmax()])), key=lambda p: p[0])
                if best[1] is None:
                    break
                cuts = sorted([*cuts, best[1]])
        else:
            value, back, live = np.full(len(y) + 1, np.inf), np.zeros(len(y) + 1, int), np.array([0])
            value[0] = -penalty
            for t in range(2, len(y) + 1):
                live = live[live <= t - 2] if len(live[live <= t - 2]) else np.array([0])
                c = value[live] + (ss[t] - ss[live] - (s[t] - s[live]) ** 2 / (t - live))
                value[t], back[t] = c.min() + penalty, live[c.argmin()]
                live = np.append(live[c <= value[t]], t - 1)
                live = live[np.isfinite(value[live])]
            cuts, t = [len(y)], len(y)
            while t > 0:
                t = back[t]
                cuts.insert(0, int(t))
        segs = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        return {"segment": list(range(len(segs))), "first": [a for a, _ in segs], "last": [b - 1 for _, b in segs], "mean": [y[a:b].mean() for a, b in segs], "std": [y[a:b].std(ddof=1) if b - a > 1 else 0.0 for a, b in segs]}

    return _per_series(df, [column], order, by, fit, "segment long, first long, last long, mean double, std double")


def joinpoint(df: DataFrame, y: str, x: str, most: int = 3) -> DataFrame:
    """Piecewise linear trend: segments with slope; joints by BIC over a grid of the distinct x, after averaging y at each x."""
    pts = df.where(col(y).isNotNull() & col(x).isNotNull()).groupBy(col(x).cast("double").alias("x")).agg(F.avg(col(y)).alias("y"), F.count("*").alias("n")).limit(MOST_VALUES + 1).toPandas().sort_values("x")
    if len(pts) > MOST_VALUES:
        raise ValueError(f"joinpoint takes {MOST_VALUES} different values of {x} at most")
    xs, ys, w = pts.x.to_numpy(), pts.y.to_numpy(), np.sqrt(pts.n.to_numpy())
    inner = xs[2:-2] if len(xs) > 6 else xs[1:-1]
    grid = inner[np.unique(np.linspace(0, len(inner) - 1, min(30, len(inner))).astype(int))] if len(inner) else inner

    def fit(joints: tuple) -> tuple[float, np.ndarray]:
        a = np.column_stack([np.ones(len(xs)), xs, *(np.maximum(xs - j, 0) for j in joints)])
        b = np.linalg.lstsq(a * w[:, None], ys * w, rcond=None)[0]
        rss = float((w * (ys - a @ b)) @ (w * (ys - a @ b)))
        return len(xs) * math.log(max(rss, 1e-12) / len(xs)) + (2 + 2 * len(joints)) * math.log(len(xs)), b

    best, joints = fit(()), ()
    for _ in range(most):  # the next joint beside those found
        got = min(((fit(tuple(sorted((*joints, g)))), tuple(sorted((*joints, g)))) for g in grid if g not in joints), key=lambda t: t[0][0], default=None)
        if got is None or got[0][0] >= best[0]:
            break
        best, joints = got
    slopes = np.cumsum(best[1][1:])
    edges = [xs[0], *joints, xs[-1]]
    return frame(df.sparkSession, [{"segment": i, "from_x": float(edges[i]), "to_x": float(edges[i + 1]), "slope": float(s), "bic": best[0]} for i, s in enumerate(slopes)])
