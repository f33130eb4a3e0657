"""Causal estimators: propensity scores, matching, weighting and meta-learners."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.dsl import Formula
from tallyfold.functions.exprs import clip, col
from tallyfold.stats.frames import complete, frame
from tallyfold.stats.regression import glm, ols, predict


def propensity(df: DataFrame, treatment: str, covariates: Sequence[str], new: str = "pscore") -> DataFrame:
    rows = complete(df, {c: col(c) for c in (treatment, *covariates)})
    return predict(rows, glm(rows, Formula(treatment, tuple((c,) for c in covariates)), "logit"), new)


def iptw(df: DataFrame, outcome: str, treatment: str, covariates: Sequence[str], att: bool = False, trim: float = 0.01) -> DataFrame:
    """estimate and error of the weighted difference, and the effective sample sizes."""
    rows = propensity(df, treatment, covariates).where(col(outcome).isNotNull())
    p, t, y = clip(F.col("pscore"), F.lit(trim), F.lit(1 - trim)), col(treatment).cast("double"), col(outcome).cast("double")
    w = F.when(t == 1, F.lit(1.0) if att else 1 / p).otherwise(p / (1 - p) if att else 1 / (1 - p))
    g = rows.select(t.alias("t"), y.alias("y"), w.alias("w")).groupBy("t").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m"), F.sum("w").alias("sw"), F.sum(F.col("w") ** 2).alias("sww"), F.sum(F.col("w") ** 2 * F.col("y")).alias("wwy"), F.sum((F.col("w") * F.col("y")) ** 2).alias("wy2")).orderBy("t").collect()
    var = sum((r["wy2"] - 2 * r["m"] * r["wwy"] + r["m"] ** 2 * r["sww"]) / r["sw"] ** 2 for r in g)
    return frame(df.sparkSession, [{"estimate": g[1]["m"] - g[0]["m"], "se": math.sqrt(max(var, 0)), "ess_control": g[0]["sw"] ** 2 / g[0]["sww"], "ess_treated": g[1]["sw"] ** 2 / g[1]["sww"]}])


def balance(df: DataFrame, treatment: str, covariates: Sequence[str]) -> DataFrame:
    """variable and standardised mean difference (population deviations)."""
    t = col(treatment) == 1
    out = []
    got = df.agg(*(f(F.when(t if k else ~t, col(c).cast("double"))) for c in covariates for k in (1, 0) for f in (F.avg, F.var_pop))).first()
    for i, c in enumerate(covariates):
        m1, v1, m0, v0 = got[4 * i : 4 * i + 4]
        out.append({"variable": c, "smd": (m1 - m0) / math.sqrt(max((v1 + v0) / 2, 1e-300))})
    return frame(df.sparkSession, out)


def matched(df: DataFrame, outcome: str, treatment: str, covariates: Sequence[str], nn: int = 1, caliper: float | None = None) -> DataFrame:
    """pscore, rows, outcome sums (y, y2) and the matched controls' mean of each treated score.

    A treated row is held against the `nn` controls with the nearest scores, with
    replacement, as far as they are within `caliper` (a distance of scores, 0.2 standard
    deviations of the score if not given). Controls with one score stand in by their mean,
    as many as they are: they share the places that are left. Of equal distances the lower
    score is nearer. Treated rows without a control in reach are left out.
    """
    from tallyfold.operators.nearest import nearest

    rows = propensity(df, treatment, covariates).where(col(outcome).isNotNull()).select("pscore", col(treatment).cast("int").alias("t"), col(outcome).cast("double").alias("y"))
    if caliper is None:
        caliper = 0.2 * (rows.agg(F.stddev_pop("pscore")).first()[0] or 0.0)
    controls = rows.where("t = 0").groupBy("pscore").agg(F.count("*").alias("n"), F.avg("y").alias("mean"))
    treated = rows.where("t = 1").groupBy("pscore").agg(F.count("*").alias("rows"), F.sum("y").alias("y"), F.sum(F.col("y") ** 2).alias("y2"))
    pairs = nearest(treated, controls, "pscore", nn).where(F.col("distance") <= caliper)
    earlier = Window.partitionBy("pscore").orderBy("near").rowsBetween(Window.unboundedPreceding, -1)
    left = nn - F.coalesce(F.sum("donor.n").over(earlier), F.lit(0))
    pairs = pairs.withColumn("w", F.greatest(F.least(F.col("donor.n"), left), F.lit(0)))
    return pairs.groupBy("pscore", "rows", "y", "y2").agg((F.sum(F.col("w") * F.col("donor.mean")) / F.sum("w")).alias("control"))


def psmatch(df: DataFrame, outcome: str, treatment: str, covariates: Sequence[str], caliper: float | None = None, nn: int = 1) -> DataFrame:
    """Effect on the treated by `matched` scores: att, its error and the treated rows with a match."""
    pairs = matched(df, outcome, treatment, covariates, nn, caliper)
    diff = F.col("y") - F.col("rows") * F.col("control")
    square = F.col("y2") - 2 * F.col("control") * F.col("y") + F.col("rows") * F.col("control") ** 2
    n, total, ss = pairs.agg(F.sum("rows"), F.sum(diff), F.sum(square)).first()
    att = total / n if n else math.nan
    return frame(df.sparkSession, [{"att": att, "se": math.sqrt(max((ss - n * att**2) / (n - 1) / n, 0.0)) if n and n > 1 else math.nan, "matched": n or 0}], "att double, se double, matched long")


def cate(df: DataFrame, outcome: str, treatment: str, covariates: Sequence[str], method: str = "tlearner") -> DataFrame:
    """ate, att and atc by two regressions (tlearner), crossed imputations (xlearner) or doubly robust scores (drlearner)."""
    rows = propensity(df, treatment, covariates).where(col(outcome).isNotNull())
    terms = tuple((c,) for c in covariates)
    t, y = col(treatment) == 1, col(outcome).cast("double")
    for k, on in ((1, t), (0, ~t)):
        rows = predict(rows, ols(rows.where(on), Formula(outcome, terms)), f"__m{k}")
    effect = F.col("__m1") - F.col("__m0")
    if method == "xlearner":
        rows = rows.withColumn("__d1", y - F.col("__m0")).withColumn("__d0", F.col("__m1") - y)
        rows = predict(predict(rows, ols(rows.where(t), Formula("__d1", terms)), "__t1"), ols(rows.where(~t), Formula("__d0", terms)), "__t0")
        effect = F.col("pscore") * F.col("__t0") + (1 - F.col("pscore")) * F.col("__t1")
    elif method == "drlearner":
        p = clip(F.col("pscore"), F.lit(0.01), F.lit(0.99))
        effect = effect + F.when(t, (y - F.col("__m1")) / p).otherwise(-(y - F.col("__m0")) / (1 - p))
    return rows.withColumn("__e", effect).agg(F.avg("__e").alias("ate"), F.avg(F.when(t, F.col("__e"))).alias("att"), F.avg(F.when(~t, F.col("__e"))).alias("atc"), (F.stddev_samp("__e") / F.sqrt(F.count("__e"))).alias("se"))


def rubin(df: DataFrame, spec: str) -> DataFrame:
    """Pooled coefficients over `_mi` with Rubin's errors."""
    copies = [r[0] for r in df.select("_mi").distinct().orderBy("_mi").collect()]
    fits = [ols(df.where(F.col("_mi") == k), spec) for k in copies]
    m, out = len(fits), []
    for i, n in enumerate(fits[0].names):
        b = [f.params[i] for f in fits]
        mean, within = sum(b) / m, sum(f.se[i] ** 2 for f in fits) / m
        between = sum((x - mean) ** 2 for x in b) / max(m - 1, 1)
        out.append({"term": n, "coef": mean, "se": math.sqrt(within + (1 + 1 / m) * between)})
    return frame(df.sparkSession, out)


def mixed(df: DataFrame, spec: str, group: str, steps: int = 60) -> DataFrame:
    """Random-intercept model by REML: the groups' sums enter the likelihood through their sizes and means only."""
    import numpy as np

    from tallyfold.functions.dsl import formula
    from tallyfold.stats.frames import moments
    from tallyfold.stats.regression import Y, _inverse, regressors

    f = formula(spec)
    x = regressors(f)
    rows = complete(df, {**x, Y: col(f.y)}).where(col(group).isNotNull()).select(col(group).alias("g"), *(c.cast("double").alias(f"v{i}") for i, c in enumerate([*x.values(), col(f.y)])))
    k = len(x) + 1
    names = [f"v{i}" for i in range(k)]
    sums = rows.groupBy("g").agg(F.count("*").alias("t"), *(F.avg(n).alias(n) for n in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    got = sums.groupBy("t").agg(F.count("*"), *(F.sum(n) for n in names), *(F.sum(F.col(a) * F.col(b)) for a, b in pairs)).collect()
    m = moments(rows, {n: F.col(n) for n in names})
    groups = []
    for r in got:
        a = np.zeros((k + 1, k + 1))
        a[0, 0] = r[1]
        a[0, 1:] = a[1:, 0] = r[2 : 2 + k]
        q = np.zeros((k, k))
        q[np.triu_indices(k)] = r[2 + k :]
        a[1:, 1:] = q + np.triu(q, 1).T
        groups.append((r[0], r[1], a))

    def at(ratio: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        xx, logs = m.xx.copy(), 0.0
        for t, n, a in groups:  # X'V^-1X with V = I + ratio * 11'
            xx = xx - a * (t * t * ratio / (1 + t * ratio))
            logs += n * math.log(1 + t * ratio)
        inv = _inverse(xx[:k, :k])
        b = inv @ xx[:k, k]
        rss = xx[k, k] - b @ xx[:k, k]
        d = m.n - k
        return -0.5 * (d * math.log(rss / d) + logs + np.linalg.slogdet(xx[:k, :k])[1]), b, inv, rss / d

    low, high, gold = -12.0, 8.0, (math.sqrt(5) - 1) / 2
    for _ in range(steps):
        a, b = high - gold * (high - low), low + gold * (high - low)
        low, high = (low, b) if at(math.exp(a))[0] > at(math.exp(b))[0] else (a, high)
    ratio = math.exp((low + high) / 2)
    ll, b, inv, s2 = at(ratio)
    out = [{"term": n, "coef": b[i], "se": math.sqrt(inv[i, i] * s2)} for i, n in enumerate(["const", *x])]
    out += [{"term": "var_group", "coef": ratio * s2, "se": None}, {"term": "var_residual", "coef": s2, "se": None}, {"term": "icc", "coef": ratio / (1 + ratio), "se": None}]
    return frame(df.sparkSession, out, "term string, coef double, se double")


def mixed_slopes(df: DataFrame, spec: str, group: str, slopes: Sequence[str], steps: int = 120) -> DataFrame:
    """Random intercepts and slopes by REML, with an unrestricted covariance.

    A group enters the likelihood through the products of its random columns with all
    columns. They are aggregated once; each step sums a small matrix over all groups.
    """
    import numpy as np

    from tallyfold.functions.dsl import formula
    from tallyfold.stats.frames import moments
    from tallyfold.stats.regression import Y, _inverse, regressors
    from tallyfold.stats.timeseries import _simplex

    f = formula(spec)
    x = regressors(f)
    wide = {**x, Y: col(f.y)}
    random = [F.lit(1.0), *(col(c).cast("double") for c in slopes)]
    rows = complete(df, {**wide, **{f"z{c}": col(c) for c in slopes}}).where(col(group).isNotNull())
    every = [F.lit(1.0), *(c.cast("double") for c in wide.values())]
    q, k = len(random), len(every) - 1
    sums = [F.sum(a * b) for a in random for b in (*random, *every)]
    held = rows.groupBy(col(group).alias("__g")).agg(*(c.alias(f"s{i}") for i, c in enumerate(sums))).select(F.array(*(f"s{i}" for i in range(len(sums)))).alias("s")).persist()
    m = moments(rows, wide)
    size = k + 1

    def total(d: np.ndarray) -> tuple[np.ndarray, float]:
        def add(it):
            import pandas as pd

            for pdf in it:
                a = np.stack(pdf["s"].to_numpy()).reshape(len(pdf), q, q + size)
                zz, zx = a[:, :, :q], a[:, :, q:]
                inner = np.eye(q) + d @ zz  # V^-1 = I - Z (I + D Z'Z)^-1 D Z'
                gone = np.einsum("gqa,gqb->ab", zx, np.linalg.solve(inner, d @ zx))
                yield pd.DataFrame({"p": [gone.reshape(-1).tolist()], "l": [float(np.linalg.slogdet(inner)[1].sum())]})

        parts = held.mapInPandas(add, "p array<double>, l double").collect()
        return sum((np.array(r["p"]).reshape(size, size) for r in parts), np.zeros((size, size))), sum(r["l"] for r in parts)

    lower = np.tril_indices(q)

    def at(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float, np.ndarray]:
        root = np.zeros((q, q))
        root[lower] = v
        d = root @ root.T
        gone, logs = total(d)
        xx = m.xx - gone
        inv = _inverse(xx[:k, :k])
        b = inv @ xx[:k, k]
        rss, n = float(xx[k, k] - b @ xx[:k, k]), m.n - k
        return -0.5 * (n * math.log(max(rss, 1e-300) / n) + logs + np.linalg.slogdet(xx[:k, :k])[1]), b, inv, rss / n, d

    start = np.zeros(len(lower[0]))
    start[[i for i, (a, b) in enumerate(zip(*lower, strict=True)) if a == b]] = 0.5
    _, b, inv, s2, d = at(_simplex(lambda v: -at(v)[0], start, steps))
    held.unpersist()
    names = ["const", *slopes]
    out = [{"term": n, "coef": b[i], "se": math.sqrt(inv[i, i] * s2)} for i, n in enumerate(["const", *x])]
    out += [{"term": f"var_{n}", "coef": d[i, i] * s2, "se": None} for i, n in enumerate(names)]
    out += [{"term": f"cov_{names[j]}_{names[i]}", "coef": d[i, j] * s2, "se": None} for i in range(q) for j in range(i)]
    out += [{"term": "var_residual", "coef": s2, "se": None}, {"term": "icc", "coef": d[0, 0] / (1 + d[0, 0]), "se": None}]
    return frame(df.sparkSession, out, "term string, coef double, se double")
