"""Queries of splines, local regression and the bootstrap of models and group differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.plans import closed_forms as CF
from tallyfold.plans.catalogue import Tables, register, rounded
from tallyfold.stats import boot
from tallyfold.stats import likelihood as K
from tallyfold.stats import regression as R
from tallyfold.stats import smooth as S
from tallyfold.stats import tests as H

_LI = lambda s, d: Tables(s, d).lineitem
_FIT = "SELECT 'n' AS measure, n AS value FROM m UNION ALL SELECT 'r2', round(1 - rss / tss, 6) FROM m_rss UNION ALL SELECT 'rmse', round(sqrt(rss / n), 6) FROM m, m_rss"


def _summary(df: DataFrame) -> DataFrame:
    return rounded(df.where("measure in ('n', 'r2', 'rmse')"))


# splines: the same space of curves, spanned by truncated powers

_POWERS = ["u", "u * u", "u ** 3", *(f"greatest(u - {k / 50}, 0) ** 3" for k in (10, 25, 40))]
register("spline_bs", lambda s, d: _summary(S.spline_summary(_LI(s, d), "l_extendedprice", ["l_quantity"], [10.0, 25.0, 40.0], "bs")),
    f"WITH b AS (SELECT l_extendedprice AS y, l_quantity / 50 AS u FROM lineitem), {CF.least_squares('m', 'b', 'y', _POWERS)} {_FIT}")


def _natural_sql(table: str, y: str, columns: list[str], knots: int = 4) -> str:
    """Basis columns x0, x1, ... of natural splines at quantiles, scaled by the range."""
    qs = ", ".join(f"{i / (knots + 1)}::DOUBLE" for i in range(knots + 2))
    parts, at = [], knots + 2
    for j, c in enumerate(columns):
        d = lambda i, j=j, c=c: f"(greatest({c} - q{j}[{i}], 0) ** 3 - greatest({c} - q{j}[{at}], 0) ** 3) / ((q{j}[{at}] - q{j}[{i}]) * (q{j}[{at}] - q{j}[1]) ** 2)"
        parts += [f"({c} - q{j}[1]) / (q{j}[{at}] - q{j}[1])", *(f"{d(i)} - {d(at - 1)}" for i in range(1, knots + 1))]
    found = ", ".join(f"quantile_cont({c}, [{qs}]) AS q{j}" for j, c in enumerate(columns))
    basis = ", ".join(f"{p} AS x{i}" for i, p in enumerate(parts))
    return f"WITH q AS (SELECT {found} FROM {table}), b AS (SELECT {y} AS y, {basis} FROM {table}, q), {CF.least_squares('m', 'b', 'y', [f'x{i}' for i in range(len(parts))])} {_FIT}"


register("spline_natural", lambda s, d: _summary(S.spline_summary(Tables(s, d).part, "p_retailprice", ["p_size", "p_partkey"])), _natural_sql("part", "p_retailprice", ["p_size", "p_partkey"]))

# local regression: every window joined and summed

_SUMS = "sum(w) AS a, sum(w * (x - v)) AS d, sum(w * (x - v) ** 2) AS dd, sum(w * y) AS y, sum(w * y * (x - v)) AS dy"
_LINE = "v, y / a - d / a * (dy / a - d / a * y / a) / (dd / a - (d / a) ** 2) AS f"
register("loess", lambda s, d: rounded(S.loess(Tables(s, d).part, "p_retailprice", "p_size", 0.3, 1), 4),
    f"""WITH r AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part), k AS (SELECT greatest(2, floor(0.3 * count(*) + 1e-10)) AS k FROM r), c AS (SELECT x, count(*) AS n FROM r GROUP BY 1), v AS (SELECT x AS v FROM c),
  upto AS (SELECT v, d, sum(n) OVER (PARTITION BY v ORDER BY d) AS upto FROM (SELECT v, abs(x - v) AS d, sum(n) AS n FROM v, c GROUP BY ALL)), h AS (SELECT v, min(d) AS h FROM upto, k WHERE upto >= k GROUP BY v),
  w AS MATERIALIZED (SELECT v, x, CASE WHEN abs(x - v) / h <= 0.001 THEN 1.0 WHEN abs(x - v) / h <= 0.999 THEN (1 - (abs(x - v) / h) ** 3) ** 3 ELSE 0.0 END AS w FROM h, c),
  f AS MATERIALIZED (SELECT {_LINE} FROM (SELECT v, {_SUMS} FROM w JOIN r USING (x) GROUP BY v)), e AS (SELECT x, y, abs(y - f) AS e FROM r JOIN f ON x = v), m AS (SELECT median(e) AS m FROM e),
  b AS (SELECT x, y, (1 - least(e / (6 * m), 1) ** 2) ** 2 AS b FROM e, m) SELECT v AS x, round(f, 4) AS smooth FROM (SELECT {_LINE} FROM (SELECT v, {_SUMS.replace('w *', 'w * b *').replace('sum(w)', 'sum(w * b)')} FROM w JOIN b USING (x) GROUP BY v))""")  # fmt: skip

# resampling: estimates in SQL, errors near the sandwich ones


def _boot(df: DataFrame, spec: str, family: str, n: int, digits: int) -> DataFrame:
    robust = (R.ols(df, spec, robust=True) if family == "ols" else R.glm(df, spec, family, robust=True)).tidy(df).select("term", F.col("se").alias("robust"))
    got = boot.model_bootstrap(df, spec, family, n).join(F.broadcast(robust), "term")  # a row for each coefficient
    return rounded(got.select("term", "coef", (F.abs(F.col("se") / F.col("robust") - 1) < 0.25).alias("near"), "resamples"), digits)


register("bootstrap_ols", lambda s, d: _boot(_LI(s, d), "l_extendedprice ~ l_quantity + l_discount", "ols", 200, 3),
    f"WITH {CF.least_squares('m', 'lineitem', 'l_extendedprice', ['l_quantity', 'l_discount'])} SELECT term, coef, TRUE AS near, 200 AS resamples FROM ({CF.terms('m', ['const', 'l_quantity', 'l_discount'], 3)})")
_ORDERS = "(SELECT CAST(o_orderstatus = 'F' AS INT) AS y, o_totalprice / 100000 AS x FROM orders)"
register("bootstrap_logit", lambda s, d: _boot(Tables(s, d).orders.selectExpr("int(o_orderstatus = 'F') as y", "o_totalprice / 100000 as x"), "y ~ x", "logit", 100, 4),
    f"WITH {CF.newton('m', _ORDERS, 'y', ['x'], 'logit', 'ln(avg(y) / (1 - avg(y)))')} SELECT term, coef, TRUE AS near, 100 AS resamples FROM ({CF.terms('m', ['const', 'x'], 4)})")
register("bootstrap_by", lambda s, d: rounded(H.bootstrap(_LI(s, d), "l_extendedprice", "mean", 200, by="l_linestatus").select("estimate", F.col("se").alias("error"), F.expr("low < estimate and estimate < high").alias("covers"), F.expr("p between 0 and 1").alias("share"), "resamples").join(F.broadcast(_welch(s, d))).selectExpr("estimate", "abs(error / plain - 1) < 0.25 as near", "covers", "share", "resamples"), 4),
    "SELECT round(avg(l_extendedprice) FILTER (l_linestatus = 'F') - avg(l_extendedprice) FILTER (l_linestatus = 'O'), 4) AS estimate, TRUE AS near, TRUE AS covers, TRUE AS share, 200 AS resamples FROM lineitem")


def _welch(s, d) -> DataFrame:
    """The error of a difference of two means."""
    return _LI(s, d).groupBy("l_linestatus").agg((F.var_samp("l_extendedprice") / F.count("*")).alias("v")).agg(F.sqrt(F.sum("v")).alias("plain"))


# an ordered or multinomial model of two levels is the binary one


def _two_levels(fit, binary, df: DataFrame) -> DataFrame:
    """Coefficients, and whether the sandwich errors are those of the binary model."""
    want = {t: float(e) for t, e in zip(binary.names, binary.se, strict=True)}
    near = F.abs(F.col("se") / F.create_map(*(F.lit(x) for t in want.items() for x in t))[F.regexp_replace(F.col("term"), r"^cut1$| \(y=1\)$", "")] - 1) < 0.01
    return rounded(fit.tidy(df).where("term not in ('const (y=1)', 'cut1')").select("term", "coef", near.alias("near")), 3)


_STATUS = lambda s, d: Tables(s, d).orders.selectExpr("int(o_orderstatus = 'F') as y", "o_totalprice / 100000 as x", "o_custkey % 25 as g")
register("ologit_robust", lambda s, d: (lambda df: _two_levels(K.ordered(df, "y ~ x", robust=True), R.glm(df, "y ~ x", "logit", robust=True), df))(_STATUS(s, d)),
    f"WITH {CF.newton('m', _ORDERS, 'y', ['x'], 'logit', 'ln(avg(y) / (1 - avg(y)))')} SELECT 'x' AS term, round(b_1, 3) + 0.0 AS coef, TRUE AS near FROM m")
register("mlogit_cluster", lambda s, d: (lambda df: _two_levels(K.mlogit(df, "y ~ x", cluster="g"), R.glm(df, "y ~ x", "logit", cluster="g"), df))(_STATUS(s, d)),
    f"WITH {CF.newton('m', _ORDERS, 'y', ['x'], 'logit', 'ln(avg(y) / (1 - avg(y)))')} SELECT 'x (y=1)' AS term, round(b_1, 3) + 0.0 AS coef, TRUE AS near FROM m")
