"""Two-way analysis of variance and survey designs: group sums from Spark, small systems on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dsl import Formula
from tallyfold.functions.exprs import col
from tallyfold.operators.transform import need
from tallyfold.stats import dist
from tallyfold.stats.frames import complete, design, frame
from tallyfold.stats.regression import Fit, _inverse, glm, parse, regressors, survey_meat, svy_ols

#: Cells of a two-way table that come to the driver, at most.
MOST_CELLS = 10_000


def anova2(df: DataFrame, value: str, a: str, b: str, interaction: bool = True) -> DataFrame:
    """source, ss, df, f and p by type III sums of squares under treatment coding.

    Counts, sums and sums of squares of the cells hold all that the least squares of the
    full and of every reduced model need; one aggregation makes them.
    """
    need(df, value, a, b)
    x = col(value).cast("double")
    rows = df.where(x.isNotNull() & col(a).isNotNull() & col(b).isNotNull())
    cells = rows.groupBy(col(a).alias("a"), col(b).alias("b")).agg(F.count("*").alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count("*")).alias("ss")).limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"{a} and {b} have more than {MOST_CELLS} cells")
    levels = [sorted({r[k] for r in cells}) for k in ("a", "b")]
    if min(map(len, levels)) < 2:
        raise ValueError("each factor needs two levels")
    codes = [np.array([[float(r[k] == v) for v in lv[1:]] for r in cells]) for k, lv in zip(("a", "b"), levels, strict=True)]
    both = (codes[0][:, :, None] * codes[1][:, None, :]).reshape(len(cells), -1)
    parts = {a: codes[0], b: codes[1], **({f"{a}:{b}": both} if interaction else {})}
    n, mean, within = (np.array([r[k] for r in cells], float) for k in ("n", "m", "ss"))

    def fit(names: Sequence[str]) -> tuple[float, int]:
        """Residual sum of squares and rank."""
        z = np.column_stack([np.ones(len(cells)), *(parts[k] for k in names)])
        root = np.sqrt(n)
        beta, _, rank, _ = np.linalg.lstsq(z * root[:, None], mean * root, rcond=None)
        return float((n * (mean - z @ beta) ** 2).sum() + within.sum()), int(rank)

    full, rank = fit(list(parts))
    rest = int(n.sum()) - rank
    out = []
    for k in parts:
        less, r = fit([x for x in parts if x != k])
        d = rank - r
        f = (less - full) / d / (full / rest) if d and rest and full else math.nan
        out.append({"source": k, "ss": less - full, "df": d, "f": f, "p": dist.f_sf(f, d, rest) if math.isfinite(f) else math.nan})
    out.append({"source": "residual", "ss": full, "df": rest, "f": None, "p": None})
    return frame(df.sparkSession, out, "source string, ss double, df long, f double, p double")


def svy_logit(df: DataFrame, spec: str | Formula, weight: str, strata: str | None = None, psu: str | None = None) -> Fit:
    """Weighted logit; errors from score sums of the primary units within strata."""
    f = parse(spec)
    x = regressors(f)
    fit = glm(df, f, "logit", weight=weight)
    rows = complete(df, {**x, "y": col(f.y), "w": col(weight)})
    w, y = col(weight).cast("double"), col(f.y).cast("double")
    p = 1 / (1 + F.exp(-fit.linear()))
    cols = design(x)
    names = list(cols)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = rows.agg(*(F.sum(w * p * (1 - p) * cols[names[i]] * cols[names[j]]) for i, j in pairs)).first()
    info = np.zeros((len(names), len(names)))
    info[np.triu_indices(len(names))] = got
    bread = _inverse(info + np.triu(info, 1).T)
    fit.cov = bread @ survey_meat(rows, w * (y - p), cols, strata, psu) @ bread
    fit.kind = "logit"
    return fit


def svy(df: DataFrame, kind: str, spec: str, weight: str, strata: str | None = None, psu: str | None = None) -> Fit:
    """ols or logit under the declared design."""
    if kind not in ("ols", "logit"):
        raise ValueError(f"no survey model {kind!r}; there are ols and logit")
    return (svy_ols if kind == "ols" else svy_logit)(df, spec, weight, strata, psu)


