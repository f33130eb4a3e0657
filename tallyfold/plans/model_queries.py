"""Queries of the models."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tallyfold.plans import closed_forms as CF
from tallyfold.plans.catalogue import Tables, register, rounded
from tallyfold.stats import causal as C
from tallyfold.stats import designs as D
from tallyfold.stats import explain as E
from tallyfold.stats import imputation as I
from tallyfold.stats import kernel as KM
from tallyfold.stats import learning as L
from tallyfold.stats import likelihood as K
from tallyfold.stats import multivariate as M
from tallyfold.stats import regression as R
from tallyfold.stats import smooth as SM
from tallyfold.stats import structural as SE
from tallyfold.stats import timeseries as Z

_LI = lambda s, d: Tables(s, d).lineitem
_one = lambda f, df: rounded(f.tidy(df).select("term", "coef"), 3)
register("ols_1x", lambda s, d: rounded(R.ols(_LI(s, d), "l_extendedprice ~ l_quantity").tidy(_LI(s, d)).select("term", "coef", "se"), 3),
    """WITH r AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2)) AS s, regr_sxx(y, x) AS sxx, avg(x) AS mx, count(*) AS n FROM (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem))
  SELECT 'const' AS term, round(a, 3) AS coef, round(s * sqrt(1.0 / n + mx ** 2 / sxx), 3) AS se FROM r UNION ALL SELECT 'l_quantity', round(b, 3), round(s / sqrt(sxx), 3) FROM r""")
register("ols_r2", lambda s, d: rounded(R.ols(_LI(s, d), "l_extendedprice ~ l_quantity").glance(_LI(s, d)).select("n", "r2"), 6), "SELECT count(*) AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
_2X = "(SELECT covar_samp(x1, x1) AS s11, covar_samp(x2, x2) AS s22, covar_samp(x1, x2) AS s12, covar_samp(x1, y) AS c1, covar_samp(x2, y) AS c2, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM (SELECT l_quantity AS x1, l_discount AS x2, l_extendedprice AS y FROM lineitem))"
register("ols_2x", lambda s, d: _one(R.ols(_LI(s, d), "l_extendedprice ~ l_quantity + l_discount"), _LI(s, d)),
    f"""WITH m AS {_2X}, b AS (SELECT (c1 * s22 - c2 * s12) / (s11 * s22 - s12 ** 2) AS b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 ** 2) AS b2, * FROM m)
  SELECT 'const' AS term, round(my - b1 * m1 - b2 * m2, 3) AS coef FROM b UNION ALL SELECT 'l_quantity', round(b1, 3) FROM b UNION ALL SELECT 'l_discount', round(b2, 3) FROM b""")
register("ols_robust", lambda s, d: rounded(R.ols(_LI(s, d), "l_extendedprice ~ l_quantity", robust=True).tidy(_LI(s, d)).where("term = 'l_quantity'").select("se"), 3),
    """WITH x AS (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem), r AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS m, regr_sxx(y, x) AS sxx, count(*) AS n FROM x)
  SELECT round(sqrt(sum(((x.x - m) * (y - a - b * x.x)) ** 2) * any_value(n) / (any_value(n) - 2)) / any_value(sxx), 3) AS se FROM x, r""")
register("ols_cluster", lambda s, d: rounded(R.ols(Tables(s, d).orders, "o_totalprice ~ o_custkey", cluster="o_orderpriority").tidy(_LI(s, d)).where("term = 'o_custkey'").select("se"), 4),
    """WITH x AS (SELECT o_totalprice AS y, o_custkey AS x, o_orderpriority AS g FROM orders), r AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS m, regr_sxx(y, x) AS sxx, count(*) AS n FROM x), s AS (SELECT g, sum((x.x - m) * (y - a - b * x.x)) AS u FROM x, r GROUP BY g)
  SELECT round(sqrt(sum(u ** 2) * count(*) / (count(*) - 1.0) * (any_value(n) - 1.0) / (any_value(n) - 2.0)) / any_value(sxx), 4) AS se FROM s, r""")
register("predict", lambda s, d: rounded(R.predict(_LI(s, d), R.ols(_LI(s, d), "l_extendedprice ~ l_quantity")).groupBy("l_returnflag").agg(F.avg("yhat").alias("yhat")), 3), "WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT l_returnflag, round(avg(a + b * l_quantity), 3) AS yhat FROM lineitem, r GROUP BY 1")
register("residuals", lambda s, d: rounded(R.residuals(_LI(s, d), R.ols(_LI(s, d), "l_extendedprice ~ l_quantity")).agg(F.stddev_pop("resid").alias("sd"), F.max("resid").alias("top")), 3), "WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT round(stddev_pop(l_extendedprice - a - b * l_quantity), 3) AS sd, round(max(l_extendedprice - a - b * l_quantity), 3) AS top FROM lineitem, r")
register("vif", lambda s, d: rounded(R.vif(_LI(s, d), ["l_quantity", "l_extendedprice"]), 5), "WITH r AS (SELECT 1 / (1 - corr(l_quantity, l_extendedprice) ** 2) AS v FROM lineitem) SELECT 'l_quantity' AS variable, round(v, 5) AS vif FROM r UNION ALL SELECT 'l_extendedprice', round(v, 5) FROM r")
register("leverage", lambda s, d: rounded(R.influence(Tables(s, d).part, "p_retailprice ~ p_size").agg(F.sum("leverage").alias("total"), F.max("leverage").alias("top")), 6), "WITH r AS (SELECT avg(p_size) AS m, regr_sxx(p_retailprice, p_size) AS sxx, count(*) AS n FROM part) SELECT round(sum(1.0 / n + (p_size - m) ** 2 / sxx), 6) AS total, round(max(1.0 / n + (p_size - m) ** 2 / sxx), 6) AS top FROM part, r")
register("cooksd", lambda s, d: rounded(R.influence(Tables(s, d).part, "p_retailprice ~ p_size").agg(F.max("cooksd").alias("top")), 6),
    """WITH r AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a, avg(p_size) AS m, regr_sxx(p_retailprice, p_size) AS sxx, (regr_syy(p_retailprice, p_size) - regr_sxy(p_retailprice, p_size) ** 2 / regr_sxx(p_retailprice, p_size)) / (count(*) - 2) AS s2, count(*) AS n FROM part),
  h AS (SELECT p_retailprice - a - b * p_size AS e, 1.0 / n + (p_size - m) ** 2 / sxx AS h, s2 FROM part, r) SELECT round(max(e ** 2 / s2 * h / (1 - h) ** 2 / 2), 6) AS top FROM h""")
register("outlier", lambda s, d: R.outliers(Tables(s, d).part, "p_retailprice ~ p_size", 1.5).select("p_partkey"),
    """WITH r AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a, avg(p_size) AS m, regr_sxx(p_retailprice, p_size) AS sxx, (regr_syy(p_retailprice, p_size) - regr_sxy(p_retailprice, p_size) ** 2 / regr_sxx(p_retailprice, p_size)) / (count(*) - 2) AS s2, count(*) AS n FROM part)
  SELECT p_partkey FROM part, r WHERE abs(p_retailprice - a - b * p_size) / sqrt(s2 * (1 - 1.0 / n - (p_size - m) ** 2 / sxx)) > 1.5""")
register("dfbeta", lambda s, d: rounded(R.dfbeta(Tables(s, d).part, "p_retailprice ~ p_size"), 5),
    f"WITH {CF.least_squares('m', 'part', 'p_retailprice', ['p_size'])}, h AS (SELECT (p_retailprice - b_0 - b_1 * p_size) / (1 - (v_0_0 + 2 * v_0_1 * p_size + v_1_1 * p_size * p_size)) AS e, p_size AS x, v_0_0, v_0_1, v_1_1, sqrt(rss / (n - 2)) AS s FROM part, m, m_rss) SELECT 'const' AS term, round(max(abs(v_0_0 + v_0_1 * x) * abs(e) / s / sqrt(v_0_0)), 5) AS max_dfbeta FROM h UNION ALL SELECT 'p_size', round(max(abs(v_0_1 + v_1_1 * x) * abs(e) / s / sqrt(v_1_1)), 5) FROM h")
register("estat_hettest", lambda s, d: rounded(R.estat(Tables(s, d).part, R.ols(Tables(s, d).part, "p_retailprice ~ p_size"), "hettest").select("statistic", "df"), 5),
    "WITH r AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part) SELECT round(count(*) * corr((p_retailprice - a - b * p_size) ** 2, p_size) ** 2, 5) AS statistic, CAST(1 AS BIGINT) AS df FROM part, r")
_PART1 = CF.least_squares("m", "part", "p_retailprice", ["p_size"])
_FITTED = "f AS (SELECT p_retailprice AS y, p_size::DOUBLE AS x, b_0 + b_1 * p_size AS hat FROM part, m), z AS (SELECT y, x, hat, (hat - avg(hat) OVER ()) / stddev_samp(hat) OVER () AS s FROM f)"
register("estat_ovtest", lambda s, d: rounded(R.estat(Tables(s, d).part, R.ols(Tables(s, d).part, "p_retailprice ~ p_size"), "ovtest").select("test", "statistic", "df"), 4),
    f"WITH {_PART1}, {_FITTED}, {CF.least_squares('w', 'z', 'y', ['x', 's ** 2', 's ** 3'])} SELECT 'ovtest' AS test, round((m_rss.rss - w_rss.rss) / 2 / (w_rss.rss / (w.n - 4)), 4) AS statistic, CAST(2 AS BIGINT) AS df FROM m_rss, w, w_rss")
register("estat_linktest", lambda s, d: rounded(R.estat(Tables(s, d).part, R.ols(Tables(s, d).part, "p_retailprice ~ p_size"), "linktest").selectExpr("test", "statistic", "cast(df as bigint) df"), 3),
    f"WITH {_PART1}, {_FITTED}, c AS (SELECT y, hat - avg(hat) OVER () AS u, (hat - avg(hat) OVER ()) ** 2 AS v FROM f), {CF.least_squares('w', 'c', 'y', ['u', 'v'])} SELECT 'linktest' AS test, round(b_2 / sqrt(v_2_2 * rss / (n - 3)), 3) AS statistic, CAST(n - 3 AS BIGINT) AS df FROM w, w_rss")
register("estat_ic", lambda s, d: rounded(R.estat(Tables(s, d).part, R.ols(Tables(s, d).part, "p_retailprice ~ p_size"), "ic"), 4),
    f"WITH {_PART1}, l AS (SELECT n, -n / 2 * (ln(2 * pi() * rss / n) + 1) AS ll FROM m, m_rss) SELECT CAST(n AS BIGINT) AS n, round(ll, 4) AS ll, round(4 - 2 * ll, 4) AS aic, round(2 * ln(n) - 2 * ll, 4) AS bic FROM l")
register("stepwise", lambda s, d: R.stepwise(_LI(s, d), "l_extendedprice ~ l_quantity + l_discount + l_tax").tidy(_LI(s, d)))
_AUTO = ["l_quantity", "l_discount", "l_tax"]
_SUBSETS = [c for r in (1, 2, 3) for c in itertools.combinations(_AUTO, r)]
register("automodel", lambda s, d: rounded(R.automodel(_LI(s, d), "l_extendedprice", _AUTO), 3),
    "WITH " + ", ".join(CF.least_squares(f"m{i}", "lineitem", "l_extendedprice", c) for i, c in enumerate(_SUBSETS)) + ", a AS (" + " UNION ALL ".join(f"SELECT '{' + '.join(c)}' AS model, 2 * ({len(c)} + 1) + n * (ln(2 * pi() * rss / n) + 1) AS aic FROM m{i}, m{i}_rss" for i, c in enumerate(_SUBSETS)) + ") SELECT row_number() OVER (ORDER BY aic, model) AS rank, model, round(aic, 3) AS aic FROM a")
_B = lambda s, d: Tables(s, d).orders.selectExpr("int(o_orderstatus = 'F') as y", "o_totalprice / 100000 as x", "o_custkey / 1000 as z", "o_orderpriority as g", "int(o_totalprice / 50000) as k")
_BS = "d AS (SELECT CAST(o_orderstatus = 'F' AS INT)::DOUBLE AS y, o_totalprice / 100000 AS x, o_custkey / 1000 AS z, CAST(trunc(o_totalprice / 50000) AS DOUBLE) AS k FROM orders)"
_LOGIT = CF.newton("m", "d", "y", ["x", "z"], "logit", "ln(avg(y) / (1 - avg(y)))")
register("logit", lambda s, d: rounded(R.glm(_B(s, d), "y ~ x + z", "logit").tidy(_B(s, d)).select("term", "coef", "se"), 5),
    f"WITH {_BS}, {_LOGIT} {CF.terms('m', ['const', 'x', 'z'], 5, 'sqrt({v})')}")
register("logit_robust", lambda s, d: rounded(R.glm(_B(s, d), "y ~ x + z", "logit", robust=True).tidy(_B(s, d)).where("term = 'x'").select("term", "coef", "se"), 5),
    f"WITH {_BS}, {_LOGIT}, r AS (SELECT m.*, x, z, (y - 1 / (1 + exp(-(b_0 + b_1 * x + b_2 * z)))) * (v_0_1 + v_1_1 * x + v_1_2 * z) AS g FROM d, m) SELECT 'x' AS term, round(any_value(b_1), 5) AS coef, round(sqrt(sum(g * g) * count(*) / (count(*) - 1)), 5) AS se FROM r")
register("probit", lambda s, d: R.glm(_B(s, d), "y ~ x + z", "probit").tidy(_B(s, d)))
register("poisson", lambda s, d: rounded(R.glm(_B(s, d), "k ~ z", "poisson").tidy(_B(s, d)).select("term", "coef", "se"), 5),
    f"WITH {_BS}, {CF.newton('m', 'd', 'k', ['z'], 'poisson', 'ln(avg(k))')} {CF.terms('m', ['const', 'z'], 5, 'sqrt({v})')}")
register("logit_saturated", lambda s, d: rounded(R.glm(_B(s, d).withColumn("b", (F.col("x") > 2.5).cast("int")), "y ~ b", "logit").tidy(_B(s, d)).select("term", "coef"), 5),
    "WITH c AS (SELECT o_totalprice / 100000 > 2.5 AS b, sum((o_orderstatus = 'F')::INT)::DOUBLE AS a, sum((o_orderstatus <> 'F')::INT)::DOUBLE AS n FROM orders GROUP BY 1), l AS (SELECT max(ln(a / n)) FILTER (NOT b) AS l0, max(ln(a / n)) FILTER (b) AS l1 FROM c) SELECT 'const' AS term, round(l0, 5) AS coef FROM l UNION ALL SELECT 'b', round(l1 - l0, 5) FROM l")
register("margins", lambda s, d: rounded(R.margins(_B(s, d), R.glm(_B(s, d), "y ~ x + z", "logit"), "average").select("term", "effect"), 5),
    f"WITH {_BS}, {_LOGIT}, p AS (SELECT b_1, b_2, 1 / (1 + exp(-(b_0 + b_1 * x + b_2 * z))) AS p FROM d, m) SELECT 'x' AS term, round(any_value(b_1) * avg(p * (1 - p)), 5) AS effect FROM p UNION ALL SELECT 'z', round(any_value(b_2) * avg(p * (1 - p)), 5) FROM p")
register("negbin", lambda s, d: K.negbin(_B(s, d), "k ~ z").tidy(_B(s, d)))
register("zip", lambda s, d: K.zip_model(_B(s, d), "k ~ z").tidy(_B(s, d)))
register("hurdle", lambda s, d: rounded(K.hurdle(_B(s, d), "k ~ z")[1].tidy(_B(s, d)).select("term", "coef", "se"), 5),
    f"WITH {_BS}, e AS (SELECT * FROM d WHERE k > 0), {CF.newton('m', 'e', 'k', ['z'], 'poisson', 'ln(avg(k))')} {CF.terms('m', ['const', 'z'], 5, 'sqrt({v})')}")
register("tobit", lambda s, d: K.tobit(_B(s, d).withColumn("c", F.greatest(F.col("x") - 2, F.lit(0.0))), "c ~ z").tidy(_B(s, d)))
register("ologit", lambda s, d: K.ordered(_B(s, d).withColumn("o", F.least(F.col("k"), F.lit(2))), "o ~ z").tidy(_B(s, d)))
register("oprobit", lambda s, d: K.ordered(_B(s, d).withColumn("o", F.least(F.col("k"), F.lit(2))), "o ~ z", "probit").tidy(_B(s, d)))
register("mlogit", lambda s, d: K.mlogit(_B(s, d).withColumn("o", F.least(F.col("k"), F.lit(2))), "o ~ z").tidy(_B(s, d)))
register("quantreg", lambda s, d: rounded(R.quantreg(Tables(s, d).part, "p_retailprice ~ p_size").tidy(_LI(s, d)).select("term", "coef"), 2))
register("nls", lambda s, d: rounded(K.nls(_LI(s, d), "l_extendedprice", "l_quantity").tidy(_LI(s, d)).select("term", "coef"), 3),
    "WITH " + CF.least_squares("q", "(SELECT ln(l_quantity) AS lx, ln(l_extendedprice) AS ly FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0)", "ly", ["lx"]) + ", g0 AS MATERIALIZED (SELECT exp(b_0) AS a, b_1 AS b FROM q), " + ", ".join(f"r{t} AS (SELECT a, b, l_quantity ** b AS g, a * l_quantity ** b * ln(l_quantity) AS h, l_extendedprice - a * l_quantity ** b AS e FROM lineitem, g{t}), t{t} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(g * g) AS gg, sum(g * h) AS gh, sum(h * h) AS hh, sum(g * e) AS ge, sum(h * e) AS he FROM r{t}), g{t + 1} AS MATERIALIZED (SELECT a + (hh * ge - gh * he) / (gg * hh - gh * gh) AS a, b + (gg * he - gh * ge) / (gg * hh - gh * gh) AS b FROM t{t})" for t in range(8)) + " SELECT 'a' AS term, round(a, 3) AS coef FROM g8 UNION ALL SELECT 'b', round(b, 3) FROM g8")
register("sureg", lambda s, d: rounded(R.sureg(_LI(s, d), ["l_extendedprice ~ l_quantity", "l_tax ~ l_discount"])[0][1].tidy(_LI(s, d)).select("term", "coef", "se"), 6),
    f"WITH {CF.least_squares('m', 'lineitem', 'l_tax', ['l_discount'])} " + CF.terms("m", ["const", "l_discount"], 6, "sqrt({v} * rss / (n - 2))", "m, m_rss"))
register("bayes_ols", lambda s, d: rounded(R.bayes(_LI(s, d), "l_tax ~ l_discount").select("term", "mean"), 5),
    "WITH " + CF.least_squares("m", "lineitem", "l_tax", ["l_discount"], ridge=0.01) + " SELECT 'const' AS term, round(b_0, 5) AS mean FROM m UNION ALL SELECT 'l_discount', round(b_1, 5) + 0.0 FROM m")
register("did", lambda s, d: rounded(R.did(Tables(s, d).orders.selectExpr("o_totalprice as y", "int(o_custkey % 2) as t", "int(year(o_orderdate) >= 1996) as p"), "y", "t", "p").tidy(_LI(s, d)).where("term = 't:p'").select("coef"), 3),
    "WITH c AS (SELECT o_custkey % 2 AS t, year(o_orderdate) >= 1996 AS p, avg(o_totalprice) AS m FROM orders GROUP BY ALL) SELECT round(max(m) FILTER (t = 1 AND p) - max(m) FILTER (t = 1 AND NOT p) - max(m) FILTER (t = 0 AND p) + max(m) FILTER (t = 0 AND NOT p), 3) AS coef FROM c")
register("ivregress", lambda s, d: rounded(R.ivregress(_LI(s, d), "l_extendedprice", [], ["l_quantity"], ["l_tax"]).tidy(_LI(s, d)).where("term = 'l_quantity'").select("coef"), 2), "SELECT round(covar_pop(l_extendedprice, l_tax) / covar_pop(l_quantity, l_tax), 2) AS coef FROM lineitem")
register("iv_endogtest", lambda s, d: rounded(R.endogtest(_LI(s, d), "l_extendedprice", [], ["l_quantity"], ["l_tax", "l_discount"]).selectExpr("statistic", "cast(df1 as bigint) df1", "cast(df2 as bigint) df2"), 4),
    f"WITH {CF.least_squares('f', 'lineitem', 'l_quantity', ['l_tax', 'l_discount'])}, e AS (SELECT l_extendedprice AS y, l_quantity AS q, l_quantity - b_0 - b_1 * l_tax - b_2 * l_discount AS v FROM lineitem, f), {CF.least_squares('o', 'e', 'y', ['q'])}, {CF.least_squares('w', 'e', 'y', ['q', 'v'])} SELECT round((o_rss.rss - w_rss.rss) / (w_rss.rss / (w.n - 3)), 4) AS statistic, CAST(1 AS BIGINT) AS df1, CAST(w.n - 3 AS BIGINT) AS df2 FROM o_rss, w, w_rss")
register("xtreg_fe", lambda s, d: rounded(R.xtreg(_LI(s, d), "l_extendedprice ~ l_quantity", "l_suppkey").tidy(_LI(s, d)).where("term = 'l_quantity'").select("coef"), 3), "SELECT round(regr_slope(y, x), 3) AS coef FROM (SELECT l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x FROM lineitem)")
register("xtreg_be", lambda s, d: rounded(R.xtreg(_LI(s, d), "l_extendedprice ~ l_quantity", "l_suppkey", "be").tidy(_LI(s, d)).where("term = 'l_quantity'").select("coef"), 3), "SELECT round(regr_slope(y, x), 3) AS coef FROM (SELECT avg(l_extendedprice) AS y, avg(l_quantity) AS x FROM lineitem GROUP BY l_suppkey)")
_PANEL = f"""r AS (SELECT l_suppkey AS g, l_extendedprice AS y, l_quantity AS x FROM lineitem), g AS MATERIALIZED (SELECT g, count(*) AS t, avg(y) AS y, avg(x) AS x FROM r GROUP BY 1), c AS (SELECT avg(y) AS y, avg(x) AS x FROM r),
  w AS (SELECT r.y - g.y + c.y AS y, r.x - g.x + c.x AS x FROM r JOIN g USING (g), c), {CF.least_squares('f', 'w', 'y', ['x'])}, {CF.least_squares('e', 'g', 'y', ['x'])},
  k AS MATERIALIZED (SELECT f_rss.rss / (f.n - e.n - 1) AS s2e, greatest(0, e_rss.rss / (e.n - 2) - f_rss.rss / (f.n - e.n - 1) / (e.n / h.h)) AS s2u FROM f, f_rss, e, e_rss, (SELECT sum(1.0 / t) AS h FROM g) h),
  q AS (SELECT 1 - th AS o, r.y - th * g.y AS y, r.x - th * g.x AS x FROM r JOIN (SELECT g.*, 1 - sqrt(s2e / (t * s2u + s2e)) AS th FROM g, k) g USING (g)), n AS MATERIALIZED (SELECT sum(o * o) AS oo, sum(o * x) AS ox, sum(x * x) AS xx, sum(o * y) AS oy, sum(x * y) AS xy, sum(y * y) AS yy, count(*) AS n FROM q),
  re AS MATERIALIZED (SELECT (xx * oy - ox * xy) / (oo * xx - ox * ox) AS b0, (oo * xy - ox * oy) / (oo * xx - ox * ox) AS b1, oo / (oo * xx - ox * ox) AS v1, * FROM n)"""
register("xtreg_re", lambda s, d: rounded(R.xtreg(_LI(s, d), "l_extendedprice ~ l_quantity", "l_suppkey", "re").tidy(_LI(s, d)).select("term", "coef"), 3),
    f"WITH {_PANEL} SELECT 'const' AS term, round(b0, 3) AS coef FROM re UNION ALL SELECT 'l_quantity', round(b1, 3) FROM re")
register("hausman", lambda s, d: rounded(R.hausman(_LI(s, d), R.xtreg(_LI(s, d), "l_extendedprice ~ l_quantity", "l_suppkey"), R.xtreg(_LI(s, d), "l_extendedprice ~ l_quantity", "l_suppkey", "re")).selectExpr("statistic", "cast(df as bigint) df"), 2),
    f"WITH {_PANEL} SELECT round(abs((f.b_1 - re.b1) ** 2 / (f.v_1_1 * f_rss.rss / (f.n - e.n - 1) - re.v1 * (re.yy - re.b0 * re.oy - re.b1 * re.xy) / (re.n - 2))), 2) AS statistic, CAST(1 AS BIGINT) AS df FROM re, f, f_rss, e")
register("mixed", lambda s, d: rounded(C.mixed(_LI(s, d), "l_extendedprice ~ l_quantity", "l_suppkey"), 3))
register("svy_summary", lambda s, d: rounded(R.svy_summary(_LI(s, d), ["l_extendedprice"], "l_quantity"), 3),
    "WITH m AS (SELECT count(*) AS n, sum(l_quantity) AS sw, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS m FROM lineitem) SELECT 'l_extendedprice' AS variable, any_value(n) AS n, round(any_value(m), 3) AS mean, round(sqrt(sum((l_quantity * (l_extendedprice - m)) ** 2) * any_value(n) / (any_value(n) - 1)) / any_value(sw), 3) AS se FROM lineitem, m")
register("svy_ols", lambda s, d: rounded(R.svy_ols(_LI(s, d), "l_extendedprice ~ l_discount", "l_quantity", "l_returnflag", "l_suppkey").tidy(_LI(s, d)).select("term", "coef"), 2),
    "WITH m AS (SELECT sum(l_quantity) AS w, sum(l_quantity * l_discount) AS x, sum(l_quantity * l_extendedprice) AS y, sum(l_quantity * l_discount * l_extendedprice) AS xy, sum(l_quantity * l_discount ** 2) AS xx FROM lineitem), b AS (SELECT (xy - x * y / w) / (xx - x * x / w) AS b, * FROM m) SELECT 'const' AS term, round(y / w - b * x / w, 2) AS coef FROM b UNION ALL SELECT 'l_discount', round(b, 2) FROM b")
register("estat_deff", lambda s, d: rounded(R.design_effect(_LI(s, d), "l_quantity"), 4), "SELECT round(count(*) * sum(l_quantity ** 2) / sum(l_quantity) ** 2, 4) AS deff, round(sum(l_quantity) ** 2 / sum(l_quantity ** 2), 4) AS effective_n FROM lineitem")
register("ridge", lambda s, d: rounded(R.ridge(_LI(s, d), "l_extendedprice", ["l_quantity"], 10.0), 3), "SELECT 'const' AS term, round(avg(l_extendedprice), 3) AS coef FROM lineitem UNION ALL SELECT 'l_quantity', round(covar_pop(l_extendedprice, l_quantity) / stddev_pop(l_quantity) * count(*) / (count(*) + 10.0), 3) FROM lineitem")
register("lasso", lambda s, d: rounded(R.lasso(_LI(s, d), "l_extendedprice", ["l_quantity"], 100.0), 3), "SELECT 'const' AS term, round(avg(l_extendedprice), 3) AS coef FROM lineitem UNION ALL SELECT 'l_quantity', round(sign(covar_pop(l_extendedprice, l_quantity) / stddev_pop(l_quantity)) * greatest(abs(covar_pop(l_extendedprice, l_quantity) / stddev_pop(l_quantity)) - 100, 0), 3) FROM lineitem")
register("elasticnet", lambda s, d: rounded(R.elasticnet(_LI(s, d), "l_extendedprice", ["l_quantity"], 1.0, 0.5), 3), "SELECT 'const' AS term, round(avg(l_extendedprice), 3) AS coef FROM lineitem UNION ALL SELECT 'l_quantity', round(sign(covar_pop(l_extendedprice, l_quantity) / stddev_pop(l_quantity)) * greatest(abs(covar_pop(l_extendedprice, l_quantity) / stddev_pop(l_quantity)) - 0.5, 0) / 1.5, 3) FROM lineitem")
register("pcr", lambda s, d: rounded(R.pcr(_LI(s, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), 4))
register("pls", lambda s, d: rounded(R.pls(_LI(s, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), 4))
register("mediate", lambda s, d: rounded(R.mediation(_LI(s, d), "l_extendedprice", "l_quantity", "l_discount").select("a", "b", "c", "c_prime", "indirect", "z"), 3),
    f"WITH {CF.least_squares('t', 'lineitem', 'l_extendedprice', ['l_discount'])}, {CF.least_squares('f', 'lineitem', 'l_quantity', ['l_discount'])}, {CF.least_squares('w', 'lineitem', 'l_extendedprice', ['l_discount', 'l_quantity'])} SELECT round(f.b_1, 3) AS a, round(w.b_2, 3) AS b, round(t.b_1, 3) AS c, round(w.b_1, 3) AS c_prime, round(f.b_1 * w.b_2, 3) AS indirect, round(f.b_1 * w.b_2 / sqrt(f.b_1 ** 2 * w.v_2_2 * w_rss.rss / (w.n - 3) + w.b_2 ** 2 * f.v_1_1 * f_rss.rss / (f.n - 2)), 3) AS z FROM t, f, f_rss, w, w_rss")
register("modmediate", lambda s, d: rounded(R.mod_mediation(_LI(s, d), "l_extendedprice", "l_quantity", "l_discount", "l_tax").select("at", "indirect"), 2),
    f"WITH {CF.least_squares('f', 'lineitem', 'l_quantity', ['l_discount', 'l_tax', 'l_discount * l_tax'])}, {CF.least_squares('w', 'lineitem', 'l_extendedprice', ['l_discount', 'l_quantity'])}, v AS (SELECT avg(l_tax) AS m, stddev_samp(l_tax) AS s FROM lineitem) SELECT unnest(['low', 'mean', 'high', 'index']) AS at, unnest([round((f.b_1 + f.b_3 * (m - s)) * w.b_2, 2), round((f.b_1 + f.b_3 * m) * w.b_2, 2), round((f.b_1 + f.b_3 * (m + s)) * w.b_2, 2), round(f.b_3 * w.b_2, 2)]) AS indirect FROM f, w, v")
_SCORE = f"{_BS}, {CF.newton('m', 'd', 'y', ['z'], 'logit', 'ln(avg(y) / (1 - avg(y)))')}, p AS MATERIALIZED (SELECT x, y, z, 1 / (1 + exp(-(b_0 + b_1 * z))) AS p FROM d, m)"
register("iptw", lambda s, d: rounded(C.iptw(_B(s, d), "x", "y", ["z"]).select("estimate", "ess_control", "ess_treated"), 3),
    f"WITH {_SCORE}, w AS (SELECT x, y, CASE WHEN y = 1 THEN 1 / least(greatest(p, 0.01), 0.99) ELSE 1 / (1 - least(greatest(p, 0.01), 0.99)) END AS w FROM p) SELECT round(sum(w * x) FILTER (y = 1) / sum(w) FILTER (y = 1) - sum(w * x) FILTER (y = 0) / sum(w) FILTER (y = 0), 3) AS estimate, round(sum(w) FILTER (y = 0) ** 2 / sum(w * w) FILTER (y = 0), 3) AS ess_control, round(sum(w) FILTER (y = 1) ** 2 / sum(w * w) FILTER (y = 1), 3) AS ess_treated FROM w")
register("balance", lambda s, d: rounded(C.balance(_B(s, d), "y", ["z"]), 5), "WITH b AS (SELECT CAST(o_orderstatus = 'F' AS INT) AS y, o_custkey / 1000 AS z FROM orders) SELECT 'z' AS variable, round((avg(z) FILTER (y = 1) - avg(z) FILTER (y = 0)) / sqrt((var_pop(z) FILTER (y = 1) + var_pop(z) FILTER (y = 0)) / 2), 5) + 0.0 AS smd FROM b")
_O = lambda s, d: Tables(s, d).orders.selectExpr("int(o_orderstatus = 'F') as t", "ln(o_totalprice) as x", "cast(o_custkey as double) as y")
_PS = f"o AS (SELECT CAST(o_orderstatus = 'F' AS INT)::DOUBLE AS t, ln(o_totalprice) AS x, o_custkey::DOUBLE AS y FROM orders), {CF.newton('m', 'o', 't', ['x'], 'logit', 'ln(avg(t) / (1 - avg(t)))')}, s AS MATERIALIZED (SELECT t, y, 1 / (1 + exp(-(b_0 + b_1 * x))) AS p FROM o, m)"


def _matched_sql(nn: int, caliper: str) -> str:
    """Controls by rank of their score, the ranks within nn of a treated row's, and of these the nn nearest."""
    return f"""WITH {_PS}, c AS (SELECT *, row_number() OVER (ORDER BY p) AS rk FROM (SELECT p, count(*) AS n, avg(y) AS y FROM s WHERE t = 0 GROUP BY p)),
  q AS (SELECT p, count(*) AS n, sum(y) AS y, sum(y * y) AS y2 FROM s WHERE t = 1 GROUP BY p),
  a AS (SELECT q.*, coalesce(c.rk, 0) AS rk FROM q ASOF LEFT JOIN c ON q.p >= c.p), b AS (SELECT {caliper} AS caliper FROM s),
  w AS (SELECT a.p, a.n, a.y, a.y2, abs(c.p - a.p) AS gap, c.n AS cn, c.y AS cy, row_number() OVER (PARTITION BY a.p ORDER BY abs(c.p - a.p), c.rk) AS near FROM a JOIN c ON c.rk BETWEEN a.rk - {nn} + 1 AND a.rk + {nn}),
  v AS (SELECT w.*, greatest(least(cn, {nn} - coalesce(sum(cn) OVER (PARTITION BY p ORDER BY near ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS k FROM w, b WHERE near <= {nn} AND gap <= caliper),
  e AS (SELECT p, any_value(n) AS n, any_value(y) AS y, any_value(y2) AS y2, sum(k * cy) / sum(k) AS c FROM v GROUP BY p),
  f AS (SELECT sum(n) AS n, sum(y - n * c) / sum(n) AS att, sum(y2 - 2 * c * y + n * c * c) AS ss FROM e)
  SELECT round(att, 4) AS att, round(sqrt((ss - n * att * att) / (n - 1) / n), 4) AS se, CAST(n AS BIGINT) AS matched FROM f"""


register("psmatch", lambda s, d: rounded(C.psmatch(_O(s, d), "y", "t", ["x"]), 4), _matched_sql(1, "0.2 * stddev_pop(p)"))
register("psmatch_3_nearest", lambda s, d: rounded(C.psmatch(_O(s, d), "y", "t", ["x"], nn=3), 4), _matched_sql(3, "0.2 * stddev_pop(p)"))
register("psmatch_caliper", lambda s, d: rounded(C.psmatch(_O(s, d), "y", "t", ["x"], 1e-6, 2), 4), _matched_sql(2, "max(1e-6)"))
_GAP = lambda s, d: Tables(s, d).orders.selectExpr("o_orderkey", "case when o_orderkey % 7 <> 0 then o_custkey end as x", "ln(o_totalprice) as y")
register("mi_pmm_nearest", lambda s, d: I.impute(_GAP(s, d), {"x": "pmm", "y": "regress"}, 1, 1, 1, draw=False).where("o_orderkey % 7 = 0").selectExpr("o_orderkey", "cast(x as bigint) as x"),
    """WITH c AS (SELECT o_custkey AS x, ln(o_totalprice) AS y, row_number() OVER (ORDER BY ln(o_totalprice)) AS rk FROM orders WHERE o_orderkey % 7 <> 0), q AS (SELECT o_orderkey, ln(o_totalprice) AS y FROM orders WHERE o_orderkey % 7 = 0),
  a AS (SELECT q.*, coalesce(c.rk, 0) AS rk FROM q ASOF LEFT JOIN c ON q.y >= c.y) SELECT a.o_orderkey, CAST(arg_min(c.x, abs(c.y - a.y)) AS BIGINT) AS x FROM a JOIN c ON c.rk BETWEEN a.rk AND a.rk + 1 GROUP BY 1""")
register("mi_pmm", lambda s, d: (lambda g: I.impute(g, {"x": "pmm", "y": "regress"}, 3, 2).alias("f").join(g.where("x is not null").select(F.col("x").cast("double").alias("x"), F.lit(1).alias("held")).distinct(), "x", "left").groupBy("_mi").agg(F.count("*").alias("n"), F.count("x").alias("filled"), F.count("held").alias("observed")).withColumn("_mi", F.col("_mi").cast("long")))(_GAP(s, d)),
    "SELECT CAST(m AS BIGINT) AS _mi, count(*) AS n, count(*) AS filled, count(*) AS observed FROM orders, (SELECT unnest([1, 2, 3]) AS m) GROUP BY 1")
_CELLS = """r AS (SELECT l_extendedprice AS y, (l_quantity > 25)::INT AS a, (l_discount > 0.05)::INT AS b FROM lineitem), c AS (SELECT a, b, count(*)::DOUBLE AS n, avg(y) AS m FROM r GROUP BY ALL), g AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m FROM c),
  ma AS (SELECT a, sum(n) AS n, sum(n * m) / sum(n) AS m FROM c GROUP BY 1), mb AS (SELECT b, sum(n) AS n, sum(n * m) / sum(n) AS m FROM c GROUP BY 1),
  first AS (SELECT (SELECT sum(ma.n * (ma.m - g.m) ** 2) FROM ma, g) >= (SELECT sum(mb.n * (mb.m - g.m) ** 2) FROM mb, g) AS a_first),
  xa AS (SELECT c.a, sum(mb.n * c.m) / sum(mb.n) AS m FROM c JOIN mb USING (b) GROUP BY 1), xb AS (SELECT c.b, sum(ma.n * c.m) / sum(ma.n) AS m FROM c JOIN ma USING (a) GROUP BY 1),
  v AS (SELECT c.n, c.m AS both_known, g.m AS none, CASE WHEN a_first THEN ma.m ELSE xa.m END AS va, CASE WHEN a_first THEN xb.m ELSE mb.m END AS vb FROM c JOIN ma USING (a) JOIN mb USING (b) JOIN xa USING (a) JOIN xb USING (b), g, first)"""
_AB = lambda s, d: _LI(s, d).selectExpr("l_extendedprice as y", "int(l_quantity > 25) as a", "int(l_discount > 0.05) as b", "l_quantity as q", "l_tax as t")
register("shap_tree", lambda s, d: rounded(E.shap_trees(_AB(s, d), "y", ["a", "b"], "cart", depth=2, least=1), 4),
    f"""WITH {_CELLS} SELECT 'a' AS variable, round(sum(n * abs((va - none) + (both_known - vb)) / 2) / sum(n), 4) AS shap FROM v UNION ALL SELECT 'b', round(sum(n * abs((vb - none) + (both_known - va)) / 2) / sum(n), 4) FROM v
  UNION ALL SELECT unnest(['base', 'prediction']), round(avg(l_extendedprice), 4) FROM lineitem""")
_additive = lambda s, d, kind: (lambda t: E.attribute(_AB(s, d), ["q", "t", "b"], t).agg(F.count("*").alias("n"), F.max(F.abs(F.aggregate("shap", F.lit(t.base), lambda a, x: a + x) - F.col("prediction"))).alias("gap")).select("n", (F.col("gap") < 1e-6).alias("additive")))(E.fit_trees(_AB(s, d), "y", ["q", "t", "b"], kind, n=20, depth=4))
for _k in ("rf", "gbm"):
    register(f"shap_{_k}_additive", lambda s, d, k=_k: _additive(s, d, k), "SELECT count(*) AS n, true AS additive FROM lineitem")
register("cate", lambda s, d: rounded(C.cate(_B(s, d), "x", "y", ["z"], "drlearner").select("ate", "att", "atc"), 4),
    f"WITH {_SCORE}, r AS (SELECT regr_slope(x, z) FILTER (y = 1) AS b1, regr_intercept(x, z) FILTER (y = 1) AS a1, regr_slope(x, z) FILTER (y = 0) AS b0, regr_intercept(x, z) FILTER (y = 0) AS a0 FROM p), e AS (SELECT y, a1 + b1 * z - a0 - b0 * z + CASE WHEN y = 1 THEN (x - a1 - b1 * z) / least(greatest(p, 0.01), 0.99) ELSE -(x - a0 - b0 * z) / (1 - least(greatest(p, 0.01), 0.99)) END AS e FROM p, r) SELECT round(avg(e), 4) AS ate, round(avg(e) FILTER (y = 1), 4) AS att, round(avg(e) FILTER (y = 0), 4) AS atc FROM e")
register("mi_impute", lambda s, d: I.mice(_LI(s, d).selectExpr("l_extendedprice as y", "case when l_orderkey % 9 = 0 then null else l_quantity end as x"), ["y", "x"], 2, 2).groupBy("_mi").agg(F.count("*").alias("n"), F.count("x").alias("filled")).selectExpr("cast(_mi as bigint) mi", "n", "filled"), "SELECT CAST(m AS BIGINT) AS mi, count(*) AS n, count(*) AS filled FROM lineitem, (VALUES (1), (2)) t(m) GROUP BY 1")
register("mi_estimate", lambda s, d: C.rubin(I.mice(_LI(s, d).selectExpr("l_extendedprice as y", "case when l_orderkey % 9 = 0 then null else l_quantity end as x"), ["y", "x"], 2, 1), "y ~ x"))
register("spline", lambda s, d: rounded(SM.spline(_LI(s, d), "l_extendedprice", "l_quantity"), 4))

# multivariate and learning
_V3 = ["l_quantity", "l_extendedprice", "l_discount"]
register("pca_corr", lambda s, d: rounded(M.pca(_LI(s, d), ["l_quantity", "l_extendedprice"]).select("component", "eigenvalue", "share"), 5), "WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem) SELECT CAST(1 AS BIGINT) AS component, round(1 + r, 5) AS eigenvalue, round((1 + r) / 2, 5) AS share FROM r UNION ALL SELECT 2, round(1 - r, 5), round((1 - r) / 2, 5) FROM r")
register("factor", lambda s, d: rounded(M.factor(_LI(s, d), _V3, 2), 4))
register("kmeans", lambda s, d: rounded(M.kmeans(_LI(s, d), ["l_quantity", "l_discount"], 3), 2))
register("hierarchical", lambda s, d: M.hierarchical(Tables(s, d).supplier, ["s_acctbal"], 3))
register("mds", lambda s, d: rounded(M.mds(Tables(s, d).region.selectExpr("double(r_regionkey) r"), ["r"], 1).select(F.round(F.max("dim1") - F.min("dim1"), 3).alias("span"), F.count("*").alias("n")), 3),
    "SELECT round((max(r_regionkey) - min(r_regionkey)) / stddev_pop(r_regionkey), 3) AS span, count(*) AS n FROM region")
register("tsne", lambda s, d: M.tsne(Tables(s, d).nation, ["n_nationkey", "n_regionkey"], steps=60).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM nation")
def _discriminant(method: str) -> str:
    own = "sxx, sxy, syy" if method == "qda" else "sum((n - 1) * sxx) OVER () / (sum(n) OVER () - count(*) OVER ()) AS sxx, sum((n - 1) * sxy) OVER () / (sum(n) OVER () - count(*) OVER ()) AS sxy, sum((n - 1) * syy) OVER () / (sum(n) OVER () - count(*) OVER ()) AS syy"
    return f"""WITH g AS (SELECT l_returnflag AS g, count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS sxx, covar_samp(l_quantity, l_extendedprice) AS sxy, var_samp(l_extendedprice) AS syy FROM lineitem GROUP BY 1),
  c AS (SELECT g, n, mx, my, {own} FROM g), d AS (SELECT *, sxx * syy - sxy * sxy AS det, sum(n) OVER () AS total FROM c),
  s AS (SELECT l_returnflag AS own, d.g, ln(n / total) - ln(det) / 2 - (syy * (l_quantity - mx) ** 2 - 2 * sxy * (l_quantity - mx) * (l_extendedprice - my) + sxx * (l_extendedprice - my) ** 2) / det / 2 AS s, lineitem.rowid AS i FROM (SELECT *, row_number() OVER () AS rowid FROM lineitem) lineitem, d)
  SELECT own AS "group", p AS predicted, count(*) AS n FROM (SELECT any_value(own) AS own, max_by(g, s) AS p FROM s GROUP BY i) GROUP BY ALL"""


register("discriminant", lambda s, d: M.discriminant(_LI(s, d), "l_returnflag", ["l_quantity", "l_extendedprice"]),
    _discriminant("lda"))
register("discriminant_qda", lambda s, d: M.discriminant(_LI(s, d), "l_returnflag", ["l_quantity", "l_extendedprice"], "qda"),
    _discriminant("qda"))
register("mixture", lambda s, d: M.mixture(Tables(s, d).events, "value", 2))
register("irt", lambda s, d: M.irt(Tables(s, d).orders.selectExpr("int(o_orderstatus = 'F') a", "int(o_totalprice > 200000) b", "int(o_custkey % 3 = 0) c"), ["a", "b", "c"]))
register("cfa", lambda s, d: M.sem(Tables(s, d).lineitem.selectExpr("l_quantity a", "l_extendedprice b", "l_quantity + 20 * l_tax c", "l_extendedprice / 1000 + l_discount * 30 d"), {"f": ["a", "b", "c", "d"]}))
register("cart", lambda s, d: L.train(_LI(s, d), "l_extendedprice", ["l_quantity", "l_discount"], "cart")[1])
register("randomforest", lambda s, d: L.train(_LI(s, d), "l_extendedprice", ["l_quantity", "l_discount"], "rf", n=10, depth=5)[1])
register("gbm", lambda s, d: L.train(_LI(s, d), "l_extendedprice", ["l_quantity", "l_discount"], "gbm", n=5)[1])
register("svm", lambda s, d: L.train(_B(s, d), "y", ["x", "z"], "svm", "classification")[1])
register("crossval", lambda s, d: rounded(L.cross_validate(Tables(s, d).part, "p_retailprice", ["p_size"], key=["p_partkey"], fold="p_partkey").selectExpr("cast(fold as bigint) fold", "n", "r2", "rmse"), 5),
    """WITH f AS (SELECT p_retailprice AS y, p_size AS x, p_partkey % 5 AS fold FROM part), b AS (SELECT k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f, (SELECT DISTINCT fold FROM f) k WHERE f.fold <> k.fold GROUP BY 1)
  SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n, round(1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)), 5) AS r2, round(sqrt(avg((y - a - b * x) ** 2)), 5) AS rmse FROM f JOIN b USING (fold) GROUP BY 1""")
register("hyperopt", lambda s, d: L.hyperopt(Tables(s, d).part, "p_retailprice", ["p_size"], "cart", draws=2, folds=2))
register("shap", lambda s, d: rounded(L.shap_linear(_LI(s, d), "l_extendedprice", ["l_quantity"]), 3), "WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, avg(l_quantity) AS m FROM lineitem) SELECT 'l_quantity' AS variable, round(avg(abs(b * (l_quantity - m))), 3) AS shap FROM lineitem, r")
register("learncurve", lambda s, d: L.learning_curve(_LI(s, d), "l_extendedprice", ["l_quantity"], (0.5, 1.0), ["l_orderkey", "l_linenumber"]))

# time series
_TS = lambda s, d: Tables(s, d).events.select("event_id", "value")
_DAY = lambda s, d: Tables(s, d).orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"), F.count("*").cast("double").alias("n")).withColumn("v", F.col("v") / 1e5)
_DAYS = "WITH days AS MATERIALIZED (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) / 1e5 AS v, count(*)::DOUBLE AS n FROM orders GROUP BY 1), lags AS MATERIALIZED (SELECT *, " + ", ".join(f"lag({c}, {k}) OVER (ORDER BY day) AS {c}_l{k}" for c in "vn" for k in (1, 2)) + " FROM days)"
_VAR = ", l1 AS MATERIALIZED (SELECT * FROM lags WHERE v_l1 IS NOT NULL), " + ", ".join(CF.least_squares(f"e{c}", "l1", c, ["v_l1", "n_l1"]) for c in "vn")
register("dfuller", lambda s, d: Z.dickey_fuller(_TS(s, d), "value", ["event_id"], 2))
register("granger", lambda s, d: rounded(Z.granger(_DAY(s, d), "v", "n", ["day"], 2).selectExpr("cast(lag as bigint) lag", "f", "cast(df1 as bigint) df1", "cast(df2 as bigint) df2"), 4),
    _DAYS + ", " + ", ".join(f"d{k} AS MATERIALIZED (SELECT * FROM lags WHERE v_l{k} IS NOT NULL), {CF.least_squares(f's{k}', f'd{k}', 'v', [f'v_l{i}' for i in range(1, k + 1)])}, {CF.least_squares(f'f{k}', f'd{k}', 'v', [f'{c}_l{i}' for c in 'vn' for i in range(1, k + 1)])}" for k in (1, 2)) + " " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS lag, round((s{k}_rss.rss - f{k}_rss.rss) / {k} / (f{k}_rss.rss / (f{k}.n - {2 * k + 1})), 4) AS f, CAST({k} AS BIGINT) AS df1, CAST(f{k}.n - {2 * k + 1} AS BIGINT) AS df2 FROM s{k}_rss, f{k}, f{k}_rss" for k in (1, 2)))
register("var", lambda s, d: rounded(Z.var_model(_DAY(s, d), ["v", "n"], 1, ["day"])[0].tidy(_TS(s, d)).select("term", "coef", "se"), 4),
    _DAYS + _VAR + " " + CF.terms("ev", ["const", "v_l1", "n_l1"], 4, "sqrt({v} * rss / (n - 3))", "ev, ev_rss"))
register("var_ar1", lambda s, d: rounded(Z.var_model(_TS(s, d), ["value"], 1, ["event_id"])[0].tidy(_TS(s, d)).select("term", "coef"), 5), "WITH l AS (SELECT value AS y, lag(value) OVER (ORDER BY event_id) AS x FROM events) SELECT 'const' AS term, round(regr_intercept(y, x), 5) AS coef FROM l UNION ALL SELECT 'value_l1', round(regr_slope(y, x), 5) + 0.0 FROM l")
register("irf", lambda s, d: rounded(Z.impulse_responses(_TS(s, d), Z.var_model(_DAY(s, d), ["v", "n"], 1, ["day"]), 1, 4).selectExpr("cast(step as bigint) step", "impulse", "response", "value"), 5),
    _DAYS.replace("WITH ", "WITH RECURSIVE ", 1) + _VAR + ", a AS MATERIALIZED (SELECT ev.b_1 AS vv, ev.b_2 AS vn, en.b_1 AS nv, en.b_2 AS nn FROM ev, en), p AS (SELECT 0 AS step, 1.0::DOUBLE AS pvv, 0.0::DOUBLE AS pvn, 0.0::DOUBLE AS pnv, 1.0::DOUBLE AS pnn UNION ALL SELECT step + 1, pvv * vv + pvn * nv, pvv * vn + pvn * nn, pnv * vv + pnn * nv, pnv * vn + pnn * nn FROM p, a WHERE step < 4) SELECT CAST(step AS BIGINT) AS step, unnest(['v', 'n', 'v', 'n']) AS impulse, unnest(['v', 'v', 'n', 'n']) AS response, unnest([round(pvv, 5) + 0.0, round(pvn, 5) + 0.0, round(pnv, 5) + 0.0, round(pnn, 5) + 0.0]) AS value FROM p")
register("forecast", lambda s, d: rounded(Z.var_forecast(_DAY(s, d), Z.var_model(_DAY(s, d), ["v", "n"], 1, ["day"]), 1, ["day"], 3).selectExpr("cast(step as bigint) step", "v", "n"), 4),
    _DAYS.replace("WITH ", "WITH RECURSIVE ", 1) + _VAR + ", a AS MATERIALIZED (SELECT ev.b_0 AS cv, ev.b_1 AS vv, ev.b_2 AS vn, en.b_0 AS cn, en.b_1 AS nv, en.b_2 AS nn FROM ev, en), p AS (SELECT 0 AS step, max_by(v, day) AS v, max_by(n, day) AS n FROM days UNION ALL SELECT step + 1, cv + vv * v + vn * n, cn + nv * v + nn * n FROM p, a WHERE step < 3) SELECT CAST(step AS BIGINT) AS step, round(v, 4) AS v, round(n, 4) AS n FROM p WHERE step > 0")
register("johansen", lambda s, d: Z.johansen(_DAY(s, d), ["v", "n"], ["day"])[0])
register("vecm", lambda s, d: Z.vecm(_DAY(s, d), ["v", "n"], ["day"]))
register("arima", lambda s, d: Z.arima(_DAY(s, d), "v", ["day"], (1, 0, 0), steps=2))
register("garch", lambda s, d: Z.garch(_DAY(s, d).withColumn("v", F.col("v") / 1000), "v", ["day"]))
register("stl", lambda s, d: Z.stl(_DAY(s, d), "v", ["day"], 7).agg(F.count("*").alias("n"), F.round(F.sum("observed"), 3).alias("total"), F.max(F.round(F.abs(F.col("observed") - F.col("trend") - F.col("seasonal") - F.col("resid")), 6)).alias("gap")),
    f"{_DAYS} SELECT count(*) AS n, round(sum(v), 3) AS total, 0.0::DOUBLE AS gap FROM days")
register("changepoint", lambda s, d: Z.changepoints(_DAY(s, d), "v", ["day"], 3))
register("joinpoint", lambda s, d: Z.joinpoint(_DAY(s, d).withColumn("t", F.datediff("day", F.lit("1992-01-01")).cast("double")), "v", "t", 1))

# designs
_LEVELS_A = [f"CAST(o_orderpriority = '{x}' AS INT)" for x in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]
_LEVELS_B = [f"CAST(o_orderstatus = '{x}' AS INT)" for x in "OP"]
register("svy_logit", lambda s, d: rounded(D.svy_logit(_B(s, d), "y ~ z", "x", "k", "g").tidy(_B(s, d)).select("term", "coef"), 5),
    f"WITH {_BS}, {CF.newton('m', 'd', 'y', ['z'], 'logit', 'ln(avg(y) / (1 - avg(y)))', weight='x')} {CF.terms('m', ['const', 'z'], 5)}")
register("anova2", lambda s, d: rounded(D.anova2(Tables(s, d).orders.withColumn("v", F.col("o_totalprice") / 1e5), "v", "o_orderpriority", "o_orderstatus", interaction=False).select("source", "ss", "df", "f"), 4),
    f"WITH {CF.least_squares('w', 'orders', 'o_totalprice / 1e5', _LEVELS_A + _LEVELS_B)}, {CF.least_squares('a', 'orders', 'o_totalprice / 1e5', _LEVELS_B)}, {CF.least_squares('b', 'orders', 'o_totalprice / 1e5', _LEVELS_A)} SELECT 'o_orderpriority' AS source, round(a_rss.rss - w_rss.rss, 4) AS ss, CAST(4 AS BIGINT) AS df, round((a_rss.rss - w_rss.rss) / 4 / (w_rss.rss / (w.n - 7)), 4) AS f FROM w, w_rss, a_rss UNION ALL SELECT 'o_orderstatus', round(b_rss.rss - w_rss.rss, 4), CAST(2 AS BIGINT), round((b_rss.rss - w_rss.rss) / 2 / (w_rss.rss / (w.n - 7)), 4) FROM w, w_rss, b_rss UNION ALL SELECT 'residual', round(rss, 4), CAST(n - 7 AS BIGINT), NULL FROM w, w_rss")
_SEM = lambda s, d: _LI(s, d).selectExpr("l_extendedprice / 1000 as y", "l_quantity as q", "100 * l_discount as d", "100 * l_tax as t", "l_quantity + 100 * l_discount as x1", "2 * l_quantity + 100 * l_tax as x2", "l_quantity + l_extendedprice / 5000 as x3")
_PATHS = "li AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS q, 100 * l_discount AS d, 100 * l_tax AS t FROM lineitem)"
register("sem_paths", lambda s, d: rounded(SE.sem(_SEM(s, d), "y ~ q + d; t ~ y + q").where("op = '~'").select("lhs", "rhs", "estimate", "se"), 6),
    f"""WITH {_PATHS}, {CF.least_squares('m', 'li', 'y', ['q', 'd'])}, {CF.least_squares('w', 'li', 't', ['y', 'q'])}
  SELECT 'y' AS lhs, unnest(['q', 'd']) AS rhs, unnest([round(b_1, 6) + 0.0, round(b_2, 6) + 0.0]) AS estimate, unnest([round(sqrt(v_1_1 * rss / n), 6), round(sqrt(v_2_2 * rss / n), 6)]) AS se FROM m, m_rss
  UNION ALL SELECT 't', unnest(['y', 'q']), unnest([round(b_1, 6) + 0.0, round(b_2, 6) + 0.0]), unnest([round(sqrt(v_1_1 * rss / n), 6), round(sqrt(v_2_2 * rss / n), 6)]) FROM w, w_rss""")
register("sem_factor", lambda s, d: rounded(SE.sem(_SEM(s, d), "f =~ x1 + x2 + x3").where("op <> 'fit'").select("lhs", "op", "rhs", "estimate"), 4),
    """WITH c AS (SELECT covar_pop(x1, x2) AS c12, covar_pop(x1, x3) AS c13, covar_pop(x2, x3) AS c23, var_pop(x1) AS v1, var_pop(x2) AS v2, var_pop(x3) AS v3 FROM (SELECT l_quantity + 100 * l_discount AS x1, 2 * l_quantity + 100 * l_tax AS x2, l_quantity + l_extendedprice / 5000 AS x3 FROM lineitem))
  SELECT 'f' AS lhs, unnest(['=~', '=~', '=~', '~~']) AS op, unnest(['x1', 'x2', 'x3', 'f']) AS rhs, unnest([1.0::DOUBLE, round(c23 / c13, 4), round(c23 / c12, 4), round(c12 * c13 / c23, 4)]) AS estimate FROM c
  UNION ALL SELECT unnest(['x1', 'x2', 'x3']), '~~', unnest(['x1', 'x2', 'x3']), unnest([round(v1 - c12 * c13 / c23, 4), round(v2 - c12 * c23 / c13, 4), round(v3 - c13 * c23 / c12, 4)]) FROM c""")
_RING = lambda s, d: _LI(s, d).selectExpr("(l_quantity - 25.5) / 12 as a", "l_discount * 40 - 2 as b").selectExpr("a", "b", "case when a * a + b * b < 1 then 'inner' else 'outer' end as ring")
register("svm_kernel", lambda s, d: (lambda g, k: KM.svm(g, "ring", ["a", "b"], "rbf", c=10.0, size=64).where("measure in ('n', 'accuracy')").selectExpr("measure", "case when measure = 'n' then value else double(value > 0.97) end as value").unionByName(KM.svm(g, "ring", ["a", "b"], "linear").where("measure = 'accuracy'").selectExpr("'linear' as measure", "double(value < 0.9) as value")))(_RING(s, d), None),
    "SELECT 'n' AS measure, count(*)::DOUBLE AS value FROM lineitem UNION ALL SELECT unnest(['accuracy', 'linear']), 1.0")
