"""Survival analysis: risk sets come from counts of the distinct times and running sums."""

from __future__ import annotations

import math

import numpy as np
from collections.abc import Sequence
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col
from tallyfold.operators.ordered import BUCKET, bucketed
from tallyfold.stats import dist
from tallyfold.stats.frames import complete, few, frame
from tallyfold.stats.regression import Fit


def _risk(df: DataFrame, time: str, event: str, by: str | None) -> DataFrame:
    """group, time, events d, censored c and the number at risk before the time.

    Windows run over distinct times, after aggregation.
    """
    t, e = col(time).cast("double"), col(event).cast("int")
    rows = df.where(t.isNotNull() & e.isNotNull())
    counts = rows.groupBy((col(by) if by else F.lit("all")).alias("grp"), t.alias("time")).agg(F.sum(e).alias("d"), F.sum(1 - e).alias("c"))
    later = Window.partitionBy("grp").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("at_risk", F.sum(F.col("d") + F.col("c")).over(later))


def kaplan_meier(df: DataFrame, time: str, event: str, by: str | None = None) -> DataFrame:
    """grp, time, at_risk, d, c, survival and Greenwood's standard error at each distinct time."""
    w = Window.partitionBy("grp").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    rows = _risk(df, time, event, by)
    s = F.product(1 - F.col("d") / F.col("at_risk")).over(w)
    green = F.sum(F.when(F.col("at_risk") > F.col("d"), F.col("d") / (F.col("at_risk") * (F.col("at_risk") - F.col("d"))))).over(w)
    return rows.select("grp", "time", "at_risk", "d", "c", s.alias("survival"), (s * F.sqrt(F.coalesce(green, F.lit(0.0)))).alias("se"))


def median_survival(df: DataFrame, time: str, event: str, by: str | None = None) -> DataFrame:
    km = kaplan_meier(df, time, event, by)
    return km.groupBy("grp").agg(F.sum("d").alias("events"), F.sum("c").alias("censored"), F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"))


#: Groups that the log-rank test compares.
MOST_GROUPS = 200


def logrank(df: DataFrame, time: str, event: str, by: str) -> DataFrame:
    """Chi-square over all groups from observed and expected events."""
    rows = df.where(col(by).isNotNull())
    every = _risk(rows, time, event, None).where("d > 0").select("time", F.col("d").alias("dt"), F.col("at_risk").alias("nt"))
    own = _risk(rows, time, event, by)
    groups = [r[0] for r in few(own.select("grp").distinct().orderBy("grp"), f"groups of {by}", MOST_GROUPS)]
    grid = every.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(g,) for g in groups], own.select("grp").schema)))
    both = grid.join(own, ["grp", "time"], "full")
    after = Window.partitionBy("grp").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("nj", F.sum(F.coalesce(F.col("d"), F.lit(0)) + F.coalesce(F.col("c"), F.lit(0))).over(after)).where("dt is not null")
    k = len(groups)
    wide = filled.groupBy("time", "dt", "nt").agg(*(F.coalesce(F.sum(F.when(F.col("grp") == F.lit(g), F.col("nj"))), F.lit(0)).alias(f"n{i}") for i, g in enumerate(groups)), *(F.coalesce(F.sum(F.when(F.col("grp") == F.lit(g), F.col("d"))), F.lit(0)).alias(f"d{i}") for i, g in enumerate(groups)))
    v = F.col("dt") * (F.col("nt") - F.col("dt")) / F.when(F.col("nt") > 1, F.col("nt") - 1).otherwise(F.lit(1))
    share = [F.col(f"n{i}") / F.col("nt") for i in range(k)]
    got = wide.agg(*(F.sum(f"d{i}") for i in range(k)), *(F.sum(F.col("dt") * share[i]) for i in range(k)), *(F.sum(v * share[i] * ((1.0 if i == j else 0.0) - share[j])) for i in range(k) for j in range(k))).first()
    o, e, cov = np.array(got[:k], float), np.array(got[k : 2 * k], float), np.array(got[2 * k :], float).reshape(k, k)
    gap = (o - e)[:-1]
    stat = float(gap @ np.linalg.pinv(cov[:-1, :-1]) @ gap)
    return frame(df.sparkSession, [{"statistic": stat, "df": k - 1, "p": dist.chi2_sf(stat, k - 1)}])


def cox(df: DataFrame, time: str, event: str, columns: Sequence[str], steps: int = 20) -> Fit:
    """Proportional hazards with Efron's ties. Each Newton step aggregates the risk-set sums of the distinct times."""
    k = len(columns)
    x = {c: col(c).cast("double") for c in columns}
    t, e = col(time).cast("double"), col(event).cast("int")
    rows = complete(df, {**x, "t": t, "e": e}).select(t.alias("t"), e.alias("e"), *(c.alias(f"x{i}") for i, c in enumerate(x.values())))
    means = rows.agg(*(F.avg(f"x{i}") for i in range(k))).first()
    rows = rows.select("t", "e", *((F.col(f"x{i}") - F.lit(means[i])).alias(f"x{i}") for i in range(k))).persist()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    b, last = np.zeros(k), -math.inf
    w = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(steps):
        r = F.exp(sum((F.lit(float(v)) * F.col(f"x{i}") for i, v in enumerate(b)), F.lit(0.0)))
        terms = {"s0": r, **{f"s1_{i}": r * F.col(f"x{i}") for i in range(k)}, **{f"s2_{i}_{j}": r * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}}
        d = F.col("e") == 1
        per = rows.groupBy("t").agg(F.sum("e").alias("d"), *(F.sum(v).alias(n) for n, v in terms.items()), *(F.sum(F.when(d, v)).alias(f"d{n}") for n, v in terms.items()), *(F.sum(F.when(d, F.col(f"x{i}"))).alias(f"ex{i}") for i in range(k)), F.sum(F.when(d, F.log(r))).alias("eta"))
        risk = per.select("t", "d", "eta", *(f"ex{i}" for i in range(k)), *(F.sum(n).over(w).alias(n) for n in terms), *(f"d{n}" for n in terms)).where("d > 0")
        # Efron: the events' own share of the risk set shrinks from one tied event to the next
        tied = risk.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda l: l / F.col("d"))).alias("l"))
        part = {n: F.col(n) - F.col("l") * F.col(f"d{n}") for n in terms}
        m = [part[f"s1_{i}"] / part["s0"] for i in range(k)]
        sums = tied.agg(F.sum(-F.log(part["s0"])), *(F.sum(-m[i]) for i in range(k)), *(F.sum(part[f"s2_{i}_{j}"] / part["s0"] - m[i] * m[j]) for i, j in pairs)).first()
        seen = risk.agg(F.sum("eta"), *(F.sum(f"ex{i}") for i in range(k)), F.sum("d")).first()
        ll, grad = seen[0] + sums[0], np.array(seen[1 : 1 + k]) + np.array(sums[1 : 1 + k])
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = sums[1 + k :]
        cov = np.linalg.inv(h + np.triu(h, 1).T)
        b = b + cov @ grad
        if abs(ll - last) < 1e-10 * (1 + abs(ll)):
            break
        last = ll
    n = rows.count()
    rows.unpersist()
    return Fit("cox", list(columns), b, cov, n, n - k, {"ll": ll, "events": float(seen[-1])}, normal=True)


def proportional(df: DataFrame, time: str, event: str, fit: Fit) -> DataFrame:
    """term, rho, chi2 and p: the correlation of the Schoenfeld residuals with the time of the events."""
    x = {c: col(c).cast("double") for c in fit.names}
    t, e = col(time).cast("double"), col(event).cast("int")
    rows = complete(df, {**x, "t": t, "e": e}).select(t.alias("t"), e.alias("e"), *(c.alias(f"x{i}") for i, c in enumerate(x.values())))
    k = len(x)
    risk = F.exp(sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(fit.params)), F.lit(0.0)))
    d = F.col("e") == 1
    per = rows.groupBy("t").agg(F.sum(risk).alias("s0"), *(F.sum(risk * F.col(f"x{i}")).alias(f"s{i + 1}") for i in range(k)), F.sum(d.cast("int")).alias("d"), *(F.sum(F.when(d, F.col(f"x{i}"))).alias(f"e{i}") for i in range(k)))
    w = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    sums = per.select("t", "d", *(f"e{i}" for i in range(k)), *(F.sum(f"s{i}").over(w).alias(f"s{i}") for i in range(k + 1))).where("d > 0")
    # the residuals of tied events are averaged, with their number as weight
    means = sums.select("t", "d", *((F.col(f"e{i}") / F.col("d") - F.col(f"s{i + 1}") / F.col("s0")).alias(f"r{i}") for i in range(k)))
    sd = F.col("d").cast("double")
    got = means.agg(F.sum(sd), F.sum(sd * F.col("t")), F.sum(sd * F.col("t") ** 2), *(F.sum(sd * v) for i in range(k) for v in (F.col(f"r{i}"), F.col(f"r{i}") ** 2, F.col(f"r{i}") * F.col("t")))).first()
    n, st, stt = got[:3]
    out = []
    for i, c in enumerate(fit.names):
        sr, srr, srt = got[3 + 3 * i : 6 + 3 * i]
        spread = (srr - sr * sr / n) * (stt - st * st / n)
        rho = (srt - sr * st / n) / math.sqrt(spread) if spread > 0 else 0.0
        out.append({"term": c, "rho": rho, "chi2": n * rho * rho, "p": dist.chi2_sf(n * rho * rho, 1)})
    return frame(df.sparkSession, out, "term string, rho double, chi2 double, p double")


def competing(df: DataFrame, time: str, event: str, cause: str) -> DataFrame:
    """Aalen-Johansen cumulative incidence: cause, time, cif."""
    t, e = col(time).cast("double"), col(event).cast("int")
    rows = df.where(t.isNotNull() & e.isNotNull())
    all_ = kaplan_meier(df, time, event).select("time", "at_risk", "survival")
    before = all_.withColumn("s0", F.coalesce(F.lag("survival").over(Window.orderBy("time")), F.lit(1.0)))
    own = rows.where(e == 1).groupBy(col(cause).alias("cause"), t.alias("time")).agg(F.count("*").alias("d"))
    w = Window.partitionBy("cause").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return own.join(before, "time").select("cause", "time", F.sum(F.col("s0") * F.col("d") / F.col("at_risk")).over(w).alias("cif"))


def _running(per: DataFrame, before: Sequence[str], upward: Sequence[str]) -> DataFrame:
    """per (a row for each BUCKET and t) with the sums of `before` over strictly earlier times and of `upward` over this and later ones.

    Each range of times has windows of its own; the ranges' totals give the offsets.
    """
    names = [*before, *upward]
    totals = per.groupBy(BUCKET).agg(*(F.sum(n).alias(n) for n in names))
    lower = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    upper = Window.orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(BUCKET, *(F.coalesce(F.sum(n).over(lower if n in before else upper), F.lit(0.0)).alias(f"__{n}") for n in names))  # a row for each range
    early = Window.partitionBy(BUCKET).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    late = Window.partitionBy(BUCKET).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    local = {n: F.coalesce(F.sum(n).over(early if n in before else late), F.lit(0.0)) for n in names}
    sums = per.withColumns({f"__own_{n}": c for n, c in local.items()}).join(F.broadcast(offsets), BUCKET)
    return sums.withColumns({n: F.col(f"__own_{n}") + F.col(f"__{n}") for n in names}).drop(*(f"{p}{n}" for n in names for p in ("__own_", "__")))


def fine_gray(df: DataFrame, time: str, event: str, cause: str, of: object, columns: Sequence[str], steps: int = 25) -> Fit:
    """Proportional subdistribution hazards of the cause `of`, with Efron's ties.

    A row whose event has another cause stays at risk behind its time, with the share of
    rows that are not censored yet: G(t-) / G(T-), where G is the Kaplan-Meier curve of
    the censoring. So the sum over a risk set is one over later times plus G(t-) times one
    over earlier competing events. Both are running sums over ranges of the distinct
    times; each Newton step aggregates the rows once. Standard errors come from the
    information and take G as known. Without competing events this is `cox`.
    """
    k = len(columns)
    x = {c: col(c).cast("double") for c in columns}
    t, e = col(time).cast("double"), col(event).cast("int")
    own = (e == 1) & col(cause).eqNullSafe(F.lit(of))
    rows = complete(df, {**x, "t": t, "e": e}).select(t.alias("t"), own.cast("int").alias("own"), ((e == 1) & ~own).alias("other"), (e != 1).cast("double").alias("c"), *(v.alias(f"x{i}") for i, v in enumerate(x.values())))
    means = rows.agg(*(F.avg(f"x{i}") for i in range(k)), F.sum("own")).first()
    if not means[k]:
        raise ValueError(f"no event of cause {of}")
    rows = bucketed(rows.select("t", "own", "other", "c", *((F.col(f"x{i}") - F.lit(means[i])).alias(f"x{i}") for i in range(k))), ["t"])
    counts = _running(rows.groupBy(BUCKET, "t").agg(F.count("*").cast("double").alias("n"), F.sum("c").alias("c")), [], ["n"])
    loss = counts.withColumn("loss", F.when(F.col("c") < F.col("n"), F.log(1 - F.col("c") / F.col("n"))).otherwise(0.0))
    left = _running(loss, ["loss"], []).select("t", F.exp("loss").alias("g"))
    rows = rows.join(left, "t").persist()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    b, last, ll = np.zeros(k), -math.inf, 0.0
    for _ in range(steps):
        r = F.exp(sum((F.lit(float(v)) * F.col(f"x{i}") for i, v in enumerate(b)), F.lit(0.0)))
        terms = {"s0": r, **{f"s1_{i}": r * F.col(f"x{i}") for i in range(k)}, **{f"s2_{i}_{j}": r * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}}
        d, held = F.col("own") == 1, F.when(F.col("other"), 1 / F.col("g")).otherwise(0.0)
        sums = [F.sum(v).alias(n) for n, v in terms.items()] + [F.sum(held * v).alias(f"q{n}") for n, v in terms.items()] + [F.coalesce(F.sum(F.when(d, v)), F.lit(0.0)).alias(f"d{n}") for n, v in terms.items()]
        per = rows.groupBy(BUCKET, "t").agg(F.first("g").alias("g"), F.sum("own").alias("d"), F.sum(F.when(d, F.log(r))).alias("eta"), *(F.sum(F.when(d, F.col(f"x{i}"))).alias(f"ex{i}") for i in range(k)), *sums)
        risk = _running(per, [f"q{n}" for n in terms], list(terms)).where("d > 0")
        tied = risk.select("*", F.explode(F.transform(F.sequence(F.lit(0), (F.col("d") - 1).cast("int")), lambda l: l / F.col("d"))).alias("l"))
        part = {n: F.col(n) + F.col("g") * F.col(f"q{n}") - F.col("l") * F.col(f"d{n}") for n in terms}
        m = [part[f"s1_{i}"] / part["s0"] for i in range(k)]
        first = F.col("l") == 0
        seen = [F.sum(F.when(first, F.col("eta"))), *(F.sum(F.when(first, F.col(f"ex{i}"))) for i in range(k))]
        got = tied.agg(*seen, F.sum(-F.log(part["s0"])), *(F.sum(-m[i]) for i in range(k)), *(F.sum(part[f"s2_{i}_{j}"] / part["s0"] - m[i] * m[j]) for i, j in pairs)).first()
        ll, grad = got[0] + got[1 + k], np.array(got[1 : 1 + k]) + np.array(got[2 + k : 2 + 2 * k])
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = got[2 + 2 * k :]
        cov = np.linalg.inv(h + np.triu(h, 1).T)
        b = b + cov @ grad
        if abs(ll - last) < 1e-10 * (1 + abs(ll)):
            break
        last = ll
    n = rows.count()
    rows.unpersist()
    return Fit("finegray", list(columns), b, cov, n, n - k, {"ll": float(ll), "events": float(means[k])}, normal=True)


#: Causes whose hazards are fitted in one call, at most.
MOST_CAUSES = 20


def subdistributions(df: DataFrame, time: str, event: str, cause: str, columns: Sequence[str]) -> DataFrame:
    """cause, term, shr (the hazard ratio), coef, se, z and p: `fine_gray` for every cause of an event."""
    seen = df.where((col(event).cast("int") == 1) & col(cause).isNotNull()).select(col(cause).alias("c")).distinct().limit(MOST_CAUSES + 1).collect()
    if len(seen) > MOST_CAUSES:
        raise ValueError(f"there are more than {MOST_CAUSES} causes")
    out = []
    for c in sorted((r["c"] for r in seen), key=str):
        fit = fine_gray(df, time, event, cause, c, columns)
        for i, name in enumerate(fit.names):
            coef, se = float(fit.params[i]), float(fit.se[i])
            out.append({"cause": str(c), "term": name, "shr": math.exp(coef), "coef": coef, "se": se, "z": coef / se, "p": math.erfc(abs(coef / se) / math.sqrt(2))})
    return frame(df.sparkSession, out, "cause string, term string, shr double, coef double, se double, z double, p double")
