"""Hypothesis tests and epidemiological measures: one aggregation each, then closed forms on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col, count_if
from tallyfold.operators.aggregate import average_rank
from tallyfold.operators.transform import need
from tallyfold.stats import dist
from tallyfold.stats.frames import few, frame


#: Groups whose means come to the driver.
MOST_GROUPS = 100_000


def _groups(df: DataFrame, value: str, by: str, two: bool = False) -> list:
    """group, n, mean and variance of each group, in the groups' order."""
    need(df, value, by)
    rows = df.where(col(value).isNotNull() & col(by).isNotNull())
    found = few(rows.groupBy(col(by).alias("g")).agg(F.count("*").alias("n"), F.avg(col(value)).alias("mean"), F.var_samp(col(value)).alias("var")).orderBy("g"), f"groups of {by}", MOST_GROUPS)
    if two and len(found) != 2:
        raise ValueError(f"{by} has {len(found)} groups; two are needed")
    return found


def ttest(df: DataFrame, value: str, by: str | None = None, mu: float = 0.0, paired: str | None = None) -> DataFrame:
    """One-sample, paired, or Welch's test of two groups: statistic, df (two places), p, difference and its 95% limits."""
    if by:
        a, b = _groups(df, value, by, two=True)
        va, vb = a["var"] / a["n"], b["var"] / b["n"]
        diff, se = a["mean"] - b["mean"], math.sqrt(va + vb)
        d = (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    else:
        x = col(value) - col(paired) if paired else col(value)
        n, mean, sd = df.where(x.isNotNull()).agg(F.count("*"), F.avg(x), F.stddev_samp(x)).first()
        diff, se, d = mean - (0.0 if paired else mu), sd / math.sqrt(n), n - 1
    t = diff / se if se else math.nan
    half = dist.t_ppf(0.975, d) * se
    return frame(df.sparkSession, [{"statistic": t, "df": round(d, 2), "p": dist.t_two(t, d), "estimate": diff, "se": se, "ci_low": diff - half, "ci_high": diff + half}], "statistic double, df double, p double, estimate double, se double, ci_low double, ci_high double")


def chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's test of independence, with Yates' correction for 2 x 2, and Cramér's V; any number of cells stays in Spark."""
    need(df, a, b)
    cells = df.where(col(a).isNotNull() & col(b).isNotNull()).groupBy(col(a).alias("a"), col(b).alias("b")).agg(F.count("*").alias("o")).persist()
    rows, cols = (cells.groupBy(k).agg(F.sum("o").alias(f"n{k}")) for k in "ab")
    n, r, c = cells.agg(F.sum("o"), F.count_distinct("a"), F.count_distinct("b")).first()
    if not n:
        cells.unpersist()
        raise ValueError(f"no rows with {a} and {b}")
    both = cells.join(rows, "a").join(cols, "b").withColumn("e", F.col("na") * F.col("nb") / F.lit(float(n)))
    if r == c == 2:
        o = np.zeros((2, 2))
        found = both.select("a", "b", "o").collect()  # four cells at most
        keys = [sorted({x[i] for x in found}) for i in range(2)]
        for x in found:
            o[keys[0].index(x["a"]), keys[1].index(x["b"])] = x["o"]
        e = np.outer(o.sum(1), o.sum(0)) / n
        gap = np.abs(o - e)
        x = float(((gap - np.minimum(0.5, gap)) ** 2 / e).sum())
    else:
        seen, expected = both.agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")), F.sum("e")).first()
        x = float(seen) + max(n - float(expected), 0.0)  # a cell without rows adds what it expects
    cells.unpersist()
    d = (r - 1) * (c - 1)
    v = math.sqrt(x / (n * max(1, min(r, c) - 1)))
    return frame(df.sparkSession, [{"statistic": x, "df": d, "p": dist.chi2_sf(x, d) if d else 1.0, "cramers_v": v, "n": int(n)}])


def anova(df: DataFrame, value: str, by: str) -> DataFrame:
    g = _groups(df, value, by)
    n, k = sum(r["n"] for r in g), len(g)
    mean = sum(r["n"] * r["mean"] for r in g) / n
    between = sum(r["n"] * (r["mean"] - mean) ** 2 for r in g)
    within = sum((r["n"] - 1) * (r["var"] or 0.0) for r in g)
    f = (between / (k - 1)) / (within / (n - k)) if within else math.inf
    return frame(df.sparkSession, [{"statistic": f, "df1": k - 1, "df2": n - k, "p": dist.f_sf(f, k - 1, n - k), "ss_between": between, "ss_within": within}])


def _rank_sums(df: DataFrame, value: str, by: str) -> tuple[list, float]:
    """group, n and rank sum of each group, and the sum of t^3 - t over ties."""
    rows = df.where(col(value).isNotNull() & col(by).isNotNull()).select(col(value).cast("double").alias("x"), col(by).alias("g"))
    ranked = average_rank(rows, "x", "r")
    sums = ranked.groupBy("g").agg(F.count("*").alias("n"), F.sum("r").alias("rank_sum")).orderBy("g").collect()
    ties = rows.groupBy("x").count().agg(F.sum(F.col("count").cast("double") ** 3 - F.col("count"))).first()[0]
    return sums, float(ties or 0.0)


def ranksum(df: DataFrame, value: str, by: str, alternative: str = "two-sided") -> DataFrame:
    """Mann-Whitney U of the first of two sorted groups; normal approximation with ties and continuity."""
    sums, ties = _rank_sums(df, value, by)
    if len(sums) != 2:
        raise ValueError(f"{by} has {len(sums)} groups; two are needed")
    a, b = sums
    u, n = a["rank_sum"] - a["n"] * (a["n"] + 1) / 2, a["n"] + b["n"]
    mean, sd = a["n"] * b["n"] / 2, math.sqrt(a["n"] * b["n"] / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (u - mean) / sd
    shift = {"two-sided": 0.5 * np.sign(u - mean), "less": -0.5, "greater": 0.5}[alternative]
    zc = (u - mean - shift) / sd
    p = {"two-sided": dist.norm_two(zc), "less": dist.norm_cdf(zc), "greater": 1 - dist.norm_cdf(zc)}[alternative]
    return frame(df.sparkSession, [{"u": float(u), "z": float(z), "p": min(1.0, float(p)), "n1": a["n"], "n2": b["n"]}], "u double, z double, p double, n1 long, n2 long")


def signrank(df: DataFrame, a: str, b: str | None = None, mu: float = 0.0) -> DataFrame:
    """Wilcoxon's signed-rank test of differences from mu, or of pairs; zero differences are left out."""
    d = (col(a) - col(b) if b else col(a) - F.lit(mu)).cast("double")
    rows = df.select(d.alias("d")).where("d is not null and d <> 0").withColumn("x", F.abs("d"))
    ranked = average_rank(rows, "x", "r")
    n, plus, minus = ranked.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0))).first()
    ties = rows.groupBy("x").count().agg(F.sum(F.col("count").cast("double") ** 3 - F.col("count"))).first()[0] or 0.0
    w, sd = min(plus, minus), math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) if n else math.nan
    z = (w - n * (n + 1) / 4) / sd if n and sd else math.nan
    return frame(df.sparkSession, [{"w": w, "z": z, "p": dist.norm_two(z) if n else math.nan, "n": n}], "w double, z double, p double, n long")


def kruskal(df: DataFrame, value: str, by: str) -> DataFrame:
    sums, ties = _rank_sums(df, value, by)
    n = sum(r["n"] for r in sums)
    h = 12 / (n * (n + 1)) * sum(r["rank_sum"] ** 2 / r["n"] for r in sums) - 3 * (n + 1)
    h /= 1 - ties / (n**3 - n)
    return frame(df.sparkSession, [{"h": h, "df": len(sums) - 1, "p": dist.chi2_sf(h, len(sums) - 1), "n": n}])


def spearman_p(rho: float, n: int) -> float:
    return dist.t_two(rho * math.sqrt((n - 2) / max(1e-300, 1 - rho * rho)), n - 2)


def posthoc(df: DataFrame, value: str, by: str, method: str = "tukey") -> DataFrame:
    """All pairs of groups: difference, statistic and adjusted p by tukey, bonferroni or scheffe (pooled variance)."""
    g = _groups(df, value, by)
    n, k = sum(r["n"] for r in g), len(g)
    mse = sum((r["n"] - 1) * (r["var"] or 0.0) for r in g) / (n - k)
    out = []
    for i, a in enumerate(g):
        for b in g[i + 1 :]:
            diff, se = b["mean"] - a["mean"], math.sqrt(mse * (1 / a["n"] + 1 / b["n"]))
            t = diff / se
            p = {
                "tukey": lambda: 1 - dist.studentized_range_cdf(abs(t) * math.sqrt(2), k, n - k),  # noqa: B023
                "bonferroni": lambda: min(1.0, dist.t_two(t, n - k) * k * (k - 1) / 2),  # noqa: B023
                "scheffe": lambda: dist.f_sf(t * t / (k - 1), k - 1, n - k),  # noqa: B023
            }[method]()
            out.append({"group1": str(a["g"]), "group2": str(b["g"]), "diff": diff, "statistic": t, "p": p})
    return frame(df.sparkSession, out)


def _two_by_two(df: DataFrame, outcome: str, exposure: str) -> tuple[int, int, int, int]:
    need(df, outcome, exposure)
    y, x = col(outcome).cast("double"), col(exposure).cast("double")
    return tuple(df.where(y.isNotNull() & x.isNotNull()).agg(*(count_if((x == i) & (y == j)) for i, j in ((1, 1), (1, 0), (0, 1), (0, 0)))).first())


def _chi2_2x2(a: int, b: int, c: int, d: int) -> float:
    n = a + b + c + d
    return n * (a * d - b * c) ** 2 / max(1, (a + b) * (c + d) * (a + c) * (b + d))


def cohort(df: DataFrame, outcome: str, exposure: str) -> DataFrame:
    """Risk ratio with log limits, risk difference, number needed to treat, chi-square and Fisher."""
    a, b, c, d = _two_by_two(df, outcome, exposure)
    r1, r0 = a / max(1, a + b), c / max(1, c + d)
    rr = r1 / r0 if r0 else math.inf
    se = math.sqrt(max(0.0, 1 / max(a, 1) - 1 / max(1, a + b) + 1 / max(c, 1) - 1 / max(1, c + d)))
    half, x = dist.norm_ppf(0.975) * se, _chi2_2x2(a, b, c, d)
    return frame(df.sparkSession, [{"a": a, "b": b, "c": c, "d": d, "risk_exposed": r1, "risk_unexposed": r0, "rr": rr, "rr_low": rr * math.exp(-half), "rr_high": rr * math.exp(half), "arr": r1 - r0, "nnt": 1 / abs(r1 - r0) if r1 != r0 else math.inf, "chi2": float(x), "p": dist.chi2_sf(x, 1), "p_fisher": dist.hypergeom_two_sided(a, b, c, d)}])


def case_control(df: DataFrame, outcome: str, exposure: str) -> DataFrame:
    """Odds ratio with Woolf's limits (cells are at least 1 in its error), chi-square and Fisher."""
    a, b, c, d = _two_by_two(df, outcome, exposure)
    odds = a * d / (b * c) if b * c else math.inf
    half, x = dist.norm_ppf(0.975) * math.sqrt(sum(1 / max(1, v) for v in (a, b, c, d))), _chi2_2x2(a, b, c, d)
    return frame(df.sparkSession, [{"a": a, "b": b, "c": c, "d": d, "odds_ratio": float(odds), "or_low": odds * math.exp(-half), "or_high": odds * math.exp(half), "chi2": float(x), "p": dist.chi2_sf(x, 1), "p_fisher": dist.hypergeom_two_sided(a, b, c, d)}])


def incidence(df: DataFrame, outcome: str, person_time: str) -> DataFrame:
    """Cases, person-time, rate and its exact Poisson limits."""
    cases, time = df.agg(F.coalesce(F.sum(col(outcome).cast("long")), F.lit(0)), F.sum(col(person_time).cast("double"))).first()
    low = dist.chi2_ppf(0.025, 2 * cases) / 2 if cases else 0.0
    high = dist.chi2_ppf(0.975, 2 * (cases + 1)) / 2
    return frame(df.sparkSession, [{"cases": cases, "person_time": time, "rate": cases / time, "low": low / time, "high": high / time}])


def tost(df: DataFrame, value: str, by: str | None = None, mu: float = 0.0, delta: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """Two one-sided tests of equivalence within delta; Welch's df is cut to a whole number."""
    if by:
        a, b = _groups(df, value, by, two=True)
        va, vb = a["var"] / a["n"], b["var"] / b["n"]
        diff, se = a["mean"] - b["mean"], math.sqrt(va + vb)
        d = int((va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1)))
    else:
        n, mean, sd = df.where(col(value).isNotNull()).agg(F.count("*"), F.avg(col(value)), F.stddev_samp(col(value))).first()
        diff, se, d = mean - mu, sd / math.sqrt(n), n - 1
    t_low, t_high = (diff + delta) / se, (diff - delta) / se
    p = max(1 - dist.t_cdf(t_low, d), dist.t_cdf(t_high, d))
    return frame(df.sparkSession, [{"diff": diff, "se": se, "df": d, "t_low": t_low, "t_high": t_high, "p": p, "equivalent": p < alpha}])


def meta(df: DataFrame, effect: str, se: str, random: bool = True) -> DataFrame:
    """Inverse-variance pooling, fixed or by DerSimonian and Laird; Q, I2 and tau2."""
    w, x = 1 / (col(se).cast("double") * col(se)), col(effect).cast("double")
    rows = df.where(x.isNotNull() & (col(se) > 0))
    k, sw, sww, swx, swxx = rows.agg(F.count("*"), F.sum(w), F.sum(w * w), F.sum(w * x), F.sum(w * x * x)).first()
    fixed, q = swx / sw, swxx - swx**2 / sw
    tau2 = max(0.0, (q - (k - 1)) / (sw - sww / sw)) if k > 1 else 0.0
    if random:
        v = 1 / (1 / w + F.lit(tau2))
        sw, swx = rows.agg(F.sum(v), F.sum(v * x)).first()
    est, err = (swx / sw if random else fixed), math.sqrt(1 / sw)
    z = dist.norm_ppf(0.975)
    return frame(df.sparkSession, [{"k": k, "estimate": est, "se": err, "low": est - z * err, "high": est + z * err, "p": dist.norm_two(est / err), "q": q, "i2": max(0.0, 100 * (q - (k - 1)) / q) if q > 0 else 0.0, "tau2": tau2}])


def jackknife(df: DataFrame, value: str, stat: str = "mean") -> DataFrame:
    """Leave-one-out estimate, bias and standard error of mean, var, std, median, min or max.

    The leave-one-out values follow from n, sums and order statistics; no row is refitted.
    """
    x = col(value).cast("double")
    rows = df.where(x.isNotNull()).select(x.alias("x"))
    n, mean, var = rows.agg(F.count("*"), F.avg("x"), F.var_samp("x")).first()
    if stat in ("mean", "var", "std"):
        d = F.col("x") - F.lit(mean)
        loo = F.lit(mean) - d / (n - 1)
        v = (F.lit(var * (n - 1)) - d * d * n / (n - 1)) / (n - 2)
        theta, each = {"mean": (mean, loo), "var": (var, v), "std": (math.sqrt(var), F.sqrt(v))}[stat]
        m, ss = rows.agg(F.avg(each), F.var_pop(each)).first()
    else:
        from tallyfold.operators.ordered import numbered

        at = {"min": [0, 1], "max": [n - 2, n - 1], "median": sorted({max(0, (n - 1) // 2 - 1), (n - 1) // 2, n // 2, min(n - 1, n // 2 + 1)})}[stat]
        got = {r["__rn"]: r["x"] for r in numbered(rows, ["x"]).where(F.col("__rn").isin(at)).collect()}

        def without(i: int) -> float:
            order = [k for k in range(n) if k != i] if n < 8 else None
            pick = (lambda k: got[order[k]]) if order else (lambda k: got[k if k < i else k + 1])
            return {"min": lambda: pick(0), "max": lambda: pick(n - 2), "median": lambda: (pick((n - 2) // 2) + pick((n - 1) // 2)) / 2}[stat]()

        lows = {"min": 1, "max": n - 1, "median": n // 2}[stat]  # places before this have one value, the others another
        a, b = without(0), without(n - 1)
        values = [(a, lows), (b, n - lows)] if stat != "median" or n % 2 == 0 else [(a, n // 2), (without(n // 2), 1), (b, n // 2)]
        m = sum(v * k for v, k in values) / n
        ss = sum(k * (v - m) ** 2 for v, k in values) / n
        theta = got[0] if stat == "min" else got[n - 1] if stat == "max" else (got[(n - 1) // 2] + got[n // 2]) / 2
    return frame(df.sparkSession, [{"estimate": theta, "bias": (n - 1) * (m - theta), "se": math.sqrt((n - 1) * ss), "n": n}], "estimate double, bias double, se double, n long")


def _uniform(x: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """A number in (0, 1) for each value, from a hash of its bits, the draw and the seed: the same wherever a task runs."""
    u = np.uint64
    with np.errstate(over="ignore"):
        h = x.astype(np.float64).view(u) ^ u((draw * 0x9E3779B97F4A7C15 + seed * 0xD6E8FEB86659FD93) & (2**64 - 1))
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values: SplitMix64
            h = (h ^ (h >> u(shift))) * u(odd)
        h = h ^ (h >> u(31))
    return ((h >> u(11)).astype(np.float64) + 0.5) / 2.0**53


#: Rows of one value from which on a draw of their number is rounded from the normal distribution.
MANY = 50


def _counts_drawn(k: np.ndarray, u: np.ndarray, p: float | None = None) -> np.ndarray:
    """Poisson(k) numbers, or with p binomial ones of k trials, at the probabilities u."""
    mean, var = (k.astype(float), k.astype(float)) if p is None else (k * p, k * p * (1 - p))
    out = np.zeros(len(k))
    few = k < MANY
    if few.any():
        kk, uu, n = k[few].astype(float), u[few], np.zeros(few.sum())
        mass = np.exp(-kk) if p is None else (1 - p) ** kk
        total, i, live = mass.copy(), 0, np.ones(len(kk), bool)
        while (live := live & (total < uu)).any() and i < 8 * MANY:
            mass = mass * (kk / (i + 1) if p is None else np.maximum(kk - i, 0) / (i + 1) * p / (1 - p))
            i += 1
            n[live] = i
            total = total + mass
        out[few] = n
    if (~few).any():
        z = np.array([dist.norm_ppf(v) for v in u[~few]])
        out[~few] = np.clip(np.round(mean[~few] + z * np.sqrt(var[~few])), 0, None if p is None else k[~few])
    return out


def bootstrap(df: DataFrame, value: str, stat: str = "mean", n: int = 2000, ci: float = 0.95, seed: int = 42, by: str | None = None) -> DataFrame:
    """Percentile limits, error and bias from n resamples.

    The rows of each distinct value have a Poisson number in each resample, drawn from a
    hash of the value and the resample, so that one distributed pass makes all of them.
    The median of a resample takes a second pass: the ranges' weights tell in which range
    of the values it lies. With `by`, the difference of its two groups (the smaller key
    first), each resampled on its own, and p: the share of differences, taken around their
    mean, as far from zero as the one found.
    """
    p = None
    if by is None:
        theta, values = _resampled(df, value, stat, n, seed)
    else:
        a, b = [r["k"] for r in _two_keys(df, value, by)]
        (theta, values), (theta_b, values_b) = (_resampled(df.where(col(by).eqNullSafe(F.lit(k))), value, stat, n, seed + i) for i, k in enumerate((a, b)))
        theta, values = theta - theta_b, values - values_b
        p = float(np.nanmean(np.abs(values - np.nanmean(values)) >= abs(theta)))
    low, high = np.nanquantile(values, [(1 - ci) / 2, (1 + ci) / 2])
    row = {"estimate": theta, "se": float(np.nanstd(values, ddof=1)), "bias": float(np.nanmean(values) - theta), "low": low, "high": high, "resamples": n}
    return frame(df.sparkSession, [row | ({"p": p} if by else {})])


def _two_keys(df: DataFrame, value: str, by: str) -> list:
    """The two groups of rows with a value; another number of groups raises before more than three are read."""
    found = df.where(col(value).isNotNull() & col(by).isNotNull()).select(col(by).alias("k")).distinct().limit(3).collect()
    if len(found) != 2:
        raise ValueError(f"{by} must have two groups")
    return sorted(found, key=lambda r: r["k"])


def _resampled(df: DataFrame, value: str, stat: str, n: int, seed: int) -> tuple[float, np.ndarray]:
    """The statistic of all rows and of each resample."""
    from tallyfold.operators.ordered import BUCKET, bucketed

    x = col(value).cast("double")
    counts = df.where(x.isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("k"))
    if stat == "median":
        values = _medians(bucketed(counts, ["x"]).withColumnRenamed(BUCKET, "bucket"), n, seed)
        return df.agg(F.median(x)).first()[0], values

    def draw(it):
        import pandas as pd

        for pdf in it:
            xs, ks = pdf["x"].to_numpy(), pdf["k"].to_numpy()
            out = []
            for b in range(n):
                w = _counts_drawn(ks, _uniform(xs, b, seed))
                hit = xs[w > 0]
                out.append((b, float(w.sum()), float(w @ xs), float(w @ (xs * xs)), float(hit.min()) if len(hit) else None, float(hit.max()) if len(hit) else None))
            yield pd.DataFrame(out, columns=["b", "w", "wx", "wxx", "low", "high"])

    parts = counts.mapInPandas(draw, "b int, w double, wx double, wxx double, low double, high double")
    sums = parts.groupBy("b").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"), F.sum("wxx").alias("wxx"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("b").toPandas()
    mean = sums.wx / sums.w
    var = (sums.wxx - sums.w * mean**2) / (sums.w - 1)
    values = {"mean": mean, "var": var, "std": var.pow(0.5), "min": sums.low, "max": sums.high}[stat].to_numpy()
    return df.agg({"mean": F.avg, "min": F.min, "max": F.max, "var": F.var_samp, "std": F.stddev_samp}[stat](x)).first()[0], values


def _medians(counts: DataFrame, n: int, seed: int) -> np.ndarray:
    """The (lower) median of each resample; counts: x, k and the bucket, which does not fall in x."""

    def weigh(it):
        import pandas as pd

        for pdf in it:
            xs, ks = pdf["x"].to_numpy(), pdf["k"].to_numpy()
            buckets, of = np.unique(pdf["bucket"].to_numpy(), return_inverse=True)
            rows = [(int(g), b, float(w)) for b in range(n) for g, w in zip(buckets, np.bincount(of, _counts_drawn(ks, _uniform(xs, b, seed)), len(buckets)), strict=True)]
            yield pd.DataFrame(rows, columns=["bucket", "b", "w"])

    sums = counts.mapInPandas(weigh, "bucket int, b int, w double").groupBy("b", "bucket").agg(F.sum("w").alias("w"))
    upto = Window.partitionBy("b").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = sums.select("b", "bucket", "w", F.sum("w").over(upto).alias("upto"), F.sum("w").over(Window.partitionBy("b")).alias("total"))
    goal = F.floor((F.col("total") + 1) / 2)
    wanted = placed.where((F.col("upto") >= goal) & (F.col("upto") - F.col("w") < goal)).select("bucket", "b", (goal - (F.col("upto") - F.col("w"))).alias("rank"))

    def find(own, asked):
        import pandas as pd

        own = own.sort_values("x")
        xs, ks = own["x"].to_numpy(), own["k"].to_numpy()
        rows = [(int(b), float(xs[np.searchsorted(np.cumsum(_counts_drawn(ks, _uniform(xs, int(b), seed))), rank)])) for b, rank in zip(asked["b"], asked["rank"], strict=True)]
        return pd.DataFrame(rows, columns=["b", "median"])

    found = counts.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInPandas(find, "b int, median double")
    return found.orderBy("b").toPandas()["median"].to_numpy()


def permutation(df: DataFrame, value: str, by: str, n: int = 2000, seed: int = 42, alternative: str = "two-sided") -> DataFrame:
    """Difference of two groups' means against n random labellings.

    Each row keeps the first group's share as its chance. The rows of a distinct value are
    drawn as one number from a hash of the value and the labelling; sums of all labellings
    come from one pass.
    """
    a, b = _groups(df, value, by, two=True)
    counts = df.where(col(value).isNotNull() & col(by).isNotNull()).groupBy(col(value).cast("double").alias("x")).agg(F.count("*").alias("k"))
    share = a["n"] / (a["n"] + b["n"])

    def draw(it):
        import pandas as pd

        for pdf in it:
            xs, ks = pdf["x"].to_numpy(), pdf["k"].to_numpy()
            out = [(k, float(w.sum()), float(w @ xs)) for k in range(n) for w in (_counts_drawn(ks, _uniform(xs, k, seed), share),)]
            yield pd.DataFrame(out, columns=["k", "n", "s"])

    total = a["n"] * a["mean"] + b["n"] * b["mean"]
    sums = counts.mapInPandas(draw, "k int, n double, s double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()
    sums = sums[(sums.n > 0) & (sums.n < a["n"] + b["n"])]
    diffs = sums.s / sums.n - (total - sums.s) / (a["n"] + b["n"] - sums.n)
    diff = a["mean"] - b["mean"]
    hits = {"two-sided": (diffs.abs() >= abs(diff)).sum(), "greater": (diffs >= diff).sum(), "less": (diffs <= diff).sum()}[alternative]
    return frame(df.sparkSession, [{"diff": diff, "p": (int(hits) + 1) / (n + 1), "permutations": n}])


def power(kind: str, alpha: float = 0.05, **k: float) -> dict[str, float]:
    """n or power of onemean, twomeans, oneprop, twoprop (normal approximation) or ols (noncentral F).

    Give all but one of n, power and the effect: delta and sd, p0 and p1, or f2 and predictors.
    """
    z = dist.norm_ppf(1 - alpha / 2)

    def achieved(n: float) -> float:
        if kind == "ols":
            u, v = k["predictors"], n - k["predictors"] - 1
            return 1 - dist.noncentral_f_cdf(dist.f_ppf(1 - alpha, u, v), u, v, k["f2"] * n) if v > 0 else 0.0
        if kind in ("onemean", "twomeans"):
            shift = k["delta"] / k.get("sd", 1.0) * math.sqrt(n / (2 if kind == "twomeans" else 1))
            return dist.norm_cdf(abs(shift) - z)
        p0, p1 = k["p0"], k["p1"]
        if kind == "oneprop":
            return dist.norm_cdf((abs(p1 - p0) * math.sqrt(n) - z * math.sqrt(p0 * (1 - p0))) / math.sqrt(p1 * (1 - p1)))
        mean = (p0 + p1) / 2
        return dist.norm_cdf((abs(p1 - p0) * math.sqrt(n) - z * math.sqrt(2 * mean * (1 - mean))) / math.sqrt(p0 * (1 - p0) + p1 * (1 - p1)))

    if "n" in k:
        return {"n": k["n"], "power": achieved(k["n"])}
    low, high = 2, 4
    while achieved(high) < k["power"] and high < 1e9:
        high *= 2
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if achieved(middle) >= k["power"] else (middle + 1, high)
    return {"n": low, "power": achieved(low)}


def sampsi(mu1: float, mu2: float, sd: float = 1.0, alpha: float = 0.05, power_: float = 0.8) -> dict[str, float]:
    """Rows of each group for two means."""
    return power("twomeans", alpha, delta=mu1 - mu2, sd=sd, power=power_)


def group_outer(df: DataFrame, columns: Sequence[str], by: str) -> tuple[list, list[int], np.ndarray, np.ndarray]:
    """Groups, their sizes and means, and the pooled within-group sums of products."""
    x = {c: col(c).cast("double") for c in columns}
    rows = df.where(col(by).isNotNull())
    for c in x.values():
        rows = rows.where(c.isNotNull())
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    got = few(rows.groupBy(col(by).alias("g")).agg(F.count("*").alias("n"), *(F.avg(x[c]) for c in columns), *(F.covar_samp(x[a], x[b]) for a, b in pairs)).orderBy("g"), f"groups of {by}", MOST_GROUPS // 100)
    k = len(columns)
    means, within = np.array([r[2 : 2 + k] for r in got], float), np.zeros((k, k))
    for r in got:
        s = np.zeros((k, k))
        s[np.triu_indices(k)] = [v or 0.0 for v in r[2 + k :]]
        within += (r["n"] - 1) * (s + np.triu(s, 1).T)
    return [r["g"] for r in got], [r["n"] for r in got], means, within


def manova(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Wilks, Pillai, Hotelling-Lawley and Roy with their F approximations."""
    groups, ns, means, e = group_outer(df, columns, by)
    n, g, p = sum(ns), len(groups), len(columns)
    gaps = means - np.average(means, axis=0, weights=ns)
    h = (gaps * np.array(ns)[:, None]).T @ gaps
    roots = np.maximum(np.real(np.linalg.eigvals(np.linalg.solve(e, h))), 0)
    q, v = g - 1, n - g
    s, m, k = min(p, q), (abs(p - q) - 1) / 2, (v - p - 1) / 2
    wilks, pillai, lawley, roy = float(np.prod(1 / (1 + roots))), float((roots / (1 + roots)).sum()), float(roots.sum()), float(roots.max())
    t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    w = v - (p - q + 1) / 2
    d1, d2 = p * q, w * t - (p * q - 2) / 2
    wt = wilks ** (1 / t)
    out = [("wilks", wilks, (1 - wt) / wt * d2 / d1, d1, d2)]
    d1, d2 = s * (2 * m + s + 1), s * (2 * k + s + 1)
    out.append(("pillai", pillai, (2 * k + s + 1) / (2 * m + s + 1) * pillai / (s - pillai), d1, d2))
    out.append(("hotelling", lawley, 2 * (s * k + 1) / (s * s * (2 * m + s + 1)) * lawley, d1, 2 * (s * k + 1)))
    r = max(p, q)
    out.append(("roy", roy, roy * (v - r + q) / r, r, v - r + q))
    return frame(df.sparkSession, [{"test": a, "value": b, "f": c, "df1": float(d), "df2": float(x), "p": dist.f_sf(c, d, x)} for a, b, c, d, x in out])
