"""Queries of reports, text, tests and epidemiology."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.commands import views as P
from tallyfold.operators import aggregate as A
from tallyfold.operators import text as W
from tallyfold.plans.catalogue import Tables, query, register, rounded
from tallyfold.plans.relational_queries import _H, _holes
from tallyfold.stats import evaluation as E
from tallyfold.stats import learning as L
from tallyfold.stats import network as N
from tallyfold.stats import survival as V
from tallyfold.stats import tests as H

_NEAREST = "CAST(round_even({q} * (n - 1), 0) AS BIGINT)"


def _summary_sql(table: str, c: str) -> str:
    q = ", ".join(f"round(min(v) FILTER (k = {_NEAREST.format(q=p)}), 4) AS {n}" for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
    return f"SELECT '{c}' AS variable, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(min(v), 4) AS min, round(max(v), 4) AS max, {q} FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS k, count(*) OVER () AS n FROM {table})"


register("summarize", lambda s, d: rounded(A.summarize(Tables(s, d).lineitem, ["l_quantity", "l_extendedprice"]), 4), _summary_sql("lineitem", "l_quantity") + " UNION ALL " + _summary_sql("lineitem", "l_extendedprice"))
register("summarize_linear", lambda s, d: rounded(A.summarize(Tables(s, d).customer, ["c_acctbal"], "linear").select("variable", "p25", "p50", "p75"), 4), "SELECT 'c_acctbal' AS variable, " + ", ".join(f"round(quantile_cont(c_acctbal, {p}), 4) AS {n}" for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))) + " FROM customer")
register("tabulate", lambda s, d: A.tabulate(_holes(s, d), "kind"), f'SELECT kind AS "value", count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM {_H}), 1) AS percent FROM {_H} GROUP BY kind')
register("tabstat", lambda s, d: rounded(A.tabstat(Tables(s, d).orders, ["o_totalprice"], ["mean", "sd", "min", "max", "n", "median", "sum", "var"], "o_orderstatus"), 2),
    "SELECT o_orderstatus, 'o_totalprice' AS variable, round(avg(o_totalprice), 2) AS mean, round(stddev_samp(o_totalprice), 2) AS sd, round(min(o_totalprice), 2) AS min, round(max(o_totalprice), 2) AS max, CAST(count(o_totalprice) AS DOUBLE) AS n, round(median(o_totalprice), 2) AS median, round(sum(o_totalprice), 2) AS sum, round(var_samp(o_totalprice), 2) AS var FROM orders GROUP BY 1")
_CC = ["l_quantity", "l_extendedprice", "l_discount"]
register("corr", lambda s, d: rounded(A.corr(Tables(s, d).lineitem, _CC)), " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for i, a in enumerate(_CC) for b in _CC[i:]))
register("spearman", lambda s, d: rounded(A.spearman(Tables(s, d).part, ["p_size", "p_retailprice"])),
    "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT 'p_size' AS var1, 'p_retailprice' AS var2, count(*) AS n, round(corr(a, b), 6) + 0.0 AS rho FROM r")
register("profile", lambda s, d: rounded(A.profile(_holes(s, d), ["value"]), 4),
    f"""SELECT 'value' AS variable, count(*) - count(value) AS missing, count(DISTINCT value) + 1 AS "unique", round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(median(value), 4) AS median, round(max(value), 4) AS max,
  round((avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / var_pop(value) ** 1.5, 4) AS skew, round(kurtosis_pop(value), 4) AS kurtosis, count(*) FILTER (value = 0) AS zeros, count(*) FILTER (value < 0) AS negatives FROM {_H}""")
register("crosstab", lambda s, d: rounded(A.crosstab(Tables(s, d).orders, "o_orderpriority", "o_orderstatus"), 4),
    'WITH c AS (SELECT o_orderpriority AS "row", o_orderstatus AS col, count(*) AS n FROM orders GROUP BY CUBE (1, 2)) SELECT c."row", c.col, c.n, round(100.0 * c.n / t.n, 4) AS row_percent FROM c JOIN (SELECT "row", n FROM c WHERE col IS NULL) t ON c."row" IS NOT DISTINCT FROM t."row"')
register("datadict", lambda s, d: A.data_dictionary(Tables(s, d).nation).select("name", "missing", "percent_missing", "unique", F.when(F.col("name") == "n_name", F.col("notes")).alias("notes")),
    """SELECT 'n_nationkey' AS name, count(*) - count(n_nationkey) AS missing, 0.0::DOUBLE AS percent_missing, count(DISTINCT n_nationkey) AS "unique", NULL AS notes FROM nation UNION ALL SELECT 'n_regionkey', count(*) - count(n_regionkey), 0.0, count(DISTINCT n_regionkey), NULL FROM nation
  UNION ALL SELECT 'n_name', count(*) - count(n_name), 0.0, count(DISTINCT n_name), (SELECT string_agg(n_name, ', ' ORDER BY n DESC, n_name) FROM (SELECT n_name, count(*) AS n FROM nation GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)) FROM nation""")
register("validate_rules", lambda s, d: A.validate(_holes(s, d), "value", {"notnull": None, "unique": None, "positive": None, "nonneg": None, "min": 10, "max": 100, "between": (5, 50), "oneof": [1.0, 2.0]}),
    f"""WITH f AS (SELECT count(*) - count(value) AS a, count(value) - count(DISTINCT value) AS b, count(*) FILTER (value <= 0) AS c, count(*) FILTER (value < 0) AS e, count(*) FILTER (value < 10) AS g, count(*) FILTER (value > 100) AS h, count(*) FILTER (value < 5 OR value > 50) AS i, count(*) FILTER (value NOT IN (1.0, 2.0)) AS j FROM {_H})
  SELECT rule, failed, failed = 0 AS passed FROM f, LATERAL (VALUES ('notnull', a), ('unique', b), ('positive', c), ('nonneg', e), ('min', g), ('max', h), ('between', i), ('oneof', j)) t(rule, failed)""")
register("assert_rule", lambda s, d: A.assert_rule(_holes(s, d), "value < 50"), f"SELECT count(*) AS checked, count(*) FILTER (NOT value < 50) AS failed, count(*) FILTER (NOT value < 50) = 0 AS passed FROM {_H}")
register("textfreq", lambda s, d: rounded(W.text_frequency(Tables(s, d).documents, "text", 20), 4),
    """WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), c AS (SELECT term, count(*) AS n FROM t WHERE length(term) >= 2 GROUP BY 1)
  SELECT term, n AS count, round(100.0 * n / (SELECT sum(n) FROM c), 4) AS percent FROM c ORDER BY n DESC, term LIMIT 20""")
register("tfidf", lambda s, d: rounded(W.tfidf(Tables(s, d).documents, "text", "doc_id", 20, stopwords=False), 5),
    r"""WITH t AS (SELECT doc_id AS k, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents), c AS MATERIALIZED (SELECT k, term, count(*) AS tf FROM t GROUP BY ALL), v AS MATERIALIZED (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY 1 ORDER BY total DESC, term LIMIT 1000),
  w AS MATERIALIZED (SELECT k, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w, n FROM c JOIN v USING (term), (SELECT count(*)::DOUBLE AS n FROM documents WHERE text IS NOT NULL)), l AS (SELECT k, sqrt(sum(w * w)) AS l FROM w GROUP BY 1) SELECT term, round(sum(w / l) / any_value(n), 5) AS mean_tfidf FROM w JOIN l USING (k) GROUP BY 1 ORDER BY sum(w / l) DESC, term LIMIT 20""")
register("lda", lambda s, d: W.lda(Tables(s, d).documents, "text", 3, 5, 5),
    None)
register("json_props", lambda s, d: Tables(s, d).events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")

# tests
_TWO = "event_type IN ('click', 'view')"
register("ttest_one", lambda s, d: rounded(H.ttest(Tables(s, d).events, "value", mu=50).select("statistic", "df", "estimate", "se"), 5), "SELECT round((avg(value) - 50) / (stddev_samp(value) / sqrt(count(*))), 5) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS df, round(avg(value) - 50, 5) AS estimate, round(stddev_samp(value) / sqrt(count(*)), 5) AS se FROM events")
register("ttest_two", lambda s, d: rounded(H.ttest(Tables(s, d).events.where(_TWO), "value", by="event_type").select("statistic", "df", "estimate", "se"), 4),
    f"""WITH g AS (SELECT event_type AS k, count(*) AS n, avg(value) AS m, var_samp(value) / count(*) AS v FROM events WHERE {_TWO} GROUP BY 1), a AS (SELECT * FROM g ORDER BY k LIMIT 1), b AS (SELECT * FROM g ORDER BY k DESC LIMIT 1)
  SELECT round((a.m - b.m) / sqrt(a.v + b.v), 4) AS statistic, round((a.v + b.v) ** 2 / (a.v ** 2 / (a.n - 1) + b.v ** 2 / (b.n - 1)), 2) AS df, round(a.m - b.m, 4) AS estimate, round(sqrt(a.v + b.v), 4) AS se FROM a, b""")
register("ttest_paired", lambda s, d: rounded(H.ttest(Tables(s, d).lineitem, "l_discount", paired="l_tax").select("statistic", "df", "estimate"), 5), "SELECT round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 5) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS df, round(avg(x), 5) AS estimate FROM (SELECT l_discount - l_tax AS x FROM lineitem)")
register("chi2", lambda s, d: rounded(H.chi2(Tables(s, d).orders, "o_orderpriority", "o_orderstatus").select("statistic", "df", "n", "cramers_v"), 5),
    """WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS o FROM orders GROUP BY ALL), m AS (SELECT a, b, o, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c)
  SELECT round(sum((o - e) ** 2 / e), 5) AS statistic, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS df, CAST(sum(o) AS BIGINT) AS n, round(sqrt(sum((o - e) ** 2 / e) / sum(o) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 5) AS cramers_v FROM m""")
_ANOVA = "WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), t AS (SELECT avg(value) AS m FROM events)"
register("anova", lambda s, d: rounded(H.anova(Tables(s, d).events, "value", "event_type").select("statistic", "df1", "df2"), 5), f"{_ANOVA} SELECT round((sum(n * (g.m - t.m) ** 2) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 5) AS statistic, count(*) - 1 AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2 FROM g, t")
_RANK = "r AS (SELECT event_type AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events {w}), s AS (SELECT g, count(*) AS n, sum(r) AS rs FROM r GROUP BY 1)"
register("ranksum", lambda s, d: rounded(H.ranksum(Tables(s, d).events.where(_TWO), "value", "event_type").select("u", "n1", "n2"), 3), f"WITH {_RANK.format(w='WHERE ' + _TWO)} SELECT round(min_by(rs - n * (n + 1) / 2, g), 3) AS u, min_by(n, g) AS n1, max_by(n, g) AS n2 FROM s")
register("kwallis", lambda s, d: rounded(H.kruskal(Tables(s, d).events, "value", "event_type").select("h", "df", "n"), 4),
    f"WITH {_RANK.format(w='')}, t AS (SELECT sum(c ** 3 - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM events GROUP BY value)), n AS (SELECT sum(n)::DOUBLE AS n FROM s) SELECT round((12 / (n.n * (n.n + 1)) * sum(rs ** 2 / s.n) - 3 * (n.n + 1)) / (1 - any_value(t.t) / (n.n ** 3 - n.n)), 4) AS h, count(*) - 1 AS df, CAST(n.n AS BIGINT) AS n FROM s, n, t GROUP BY n.n")
register("signrank", lambda s, d: rounded(H.signrank(Tables(s, d).events, "value", mu=50).select("w", "n"), 1), "WITH x AS (SELECT value - 50.0 AS d FROM events WHERE value <> 50), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM x) SELECT round(least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)), 1) AS w, count(*) AS n FROM r")
register("posthoc", lambda s, d: rounded(H.posthoc(Tables(s, d).events, "value", "event_type").select("group1", "group2", "diff", "statistic"), 4),
    "WITH g AS (SELECT event_type AS k, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), e AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS mse FROM g) SELECT a.k AS group1, b.k AS group2, round(b.m - a.m, 4) AS diff, round((b.m - a.m) / sqrt(mse * (1.0 / a.n + 1.0 / b.n)), 4) AS statistic FROM g a, g b, e WHERE a.k < b.k")
_LAB = "(SELECT sum((toxic = 1 AND quality = 1)::INT) AS a, sum((toxic = 1 AND quality = 0)::INT) AS b, sum((toxic = 0 AND quality = 1)::INT) AS c, sum((toxic = 0 AND quality = 0)::INT) AS d FROM labels)"
register("cs", lambda s, d: rounded(H.cohort(Tables(s, d).labels, "quality", "toxic").select("a", "b", "c", "d", "rr", "arr")), f"SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, round((a / (a + b)) / (c / (c + d)), 6) AS rr, round(a / (a + b) - c / (c + d), 6) + 0.0 AS arr FROM (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d FROM {_LAB})")
register("cc", lambda s, d: rounded(H.case_control(Tables(s, d).orders.selectExpr("int(o_orderstatus = 'F') as y", "int(o_totalprice > 250000) as x"), "y", "x").select("a", "b", "c", "d", "odds_ratio")),
    "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, round(a * d / (b * c), 6) AS odds_ratio FROM (SELECT sum((o_totalprice > 250000 AND o_orderstatus = 'F')::INT)::DOUBLE AS a, sum((o_totalprice > 250000 AND o_orderstatus <> 'F')::INT)::DOUBLE AS b, sum((o_totalprice <= 250000 AND o_orderstatus = 'F')::INT)::DOUBLE AS c, sum((o_totalprice <= 250000 AND o_orderstatus <> 'F')::INT)::DOUBLE AS d FROM orders)")
register("ir", lambda s, d: rounded(H.incidence(Tables(s, d).events.selectExpr("int(event_type = 'purchase') as y", "value"), "y", "value").select("cases", "person_time", "rate"), 5), "SELECT count(*) FILTER (event_type = 'purchase') AS cases, round(sum(value), 5) AS person_time, round(count(*) FILTER (event_type = 'purchase') / sum(value), 5) AS rate FROM events")
register("tost", lambda s, d: rounded(H.tost(Tables(s, d).events.where(_TWO), "value", "event_type", delta=2.0).select("diff", "se", "df", "t_low", "t_high"), 4),
    f"""WITH g AS (SELECT event_type AS k, count(*) AS n, avg(value) AS m, var_samp(value) / count(*) AS v FROM events WHERE {_TWO} GROUP BY 1), a AS (SELECT * FROM g ORDER BY k LIMIT 1), b AS (SELECT * FROM g ORDER BY k DESC LIMIT 1)
  SELECT round(a.m - b.m, 4) AS diff, round(sqrt(a.v + b.v), 4) AS se, CAST(floor((a.v + b.v) ** 2 / (a.v ** 2 / (a.n - 1) + b.v ** 2 / (b.n - 1))) AS BIGINT) AS df, round((a.m - b.m + 2) / sqrt(a.v + b.v), 4) AS t_low, round((a.m - b.m - 2) / sqrt(a.v + b.v), 4) AS t_high FROM a, b""")
_M = "(SELECT user_id, avg(value) AS x, stddev_samp(value) / sqrt(count(*)) AS s FROM events GROUP BY 1 HAVING count(*) > 4 AND stddev_samp(value) > 0)"
_meta = lambda s, d: Tables(s, d).events.groupBy("user_id").agg(F.avg("value").alias("x"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("s"), F.count("*").alias("n")).where("n > 4 and s > 0")
register("meta_fe", lambda s, d: rounded(H.meta(_meta(s, d), "x", "s", random=False).select("k", "estimate", "se", "q"), 4), f"SELECT count(*) AS k, round(sum(x / s ** 2) / sum(1 / s ** 2), 4) AS estimate, round(1 / sqrt(sum(1 / s ** 2)), 4) AS se, round(sum(x ** 2 / s ** 2) - sum(x / s ** 2) ** 2 / sum(1 / s ** 2), 4) AS q FROM {_M}")
register("meta_re", lambda s, d: rounded(H.meta(_meta(s, d), "x", "s").select("k", "estimate", "se", "tau2"), 4),
    f"WITH m AS {_M}, q AS (SELECT count(*) AS k, sum(x ** 2 / s ** 2) - sum(x / s ** 2) ** 2 / sum(1 / s ** 2) AS q, sum(1 / s ** 2) - sum(1 / s ** 4) / sum(1 / s ** 2) AS c FROM m), t AS (SELECT k, greatest(0, (q - (k - 1)) / c) AS t FROM q) SELECT any_value(k) AS k, round(sum(x / (s ** 2 + t)) / sum(1 / (s ** 2 + t)), 4) AS estimate, round(1 / sqrt(sum(1 / (s ** 2 + t))), 4) AS se, round(any_value(t), 4) AS tau2 FROM m, t")
register("jackknife", lambda s, d: rounded(H.jackknife(Tables(s, d).customer, "c_acctbal").select("estimate", "se", "n"), 4), "SELECT round(avg(c_acctbal), 4) AS estimate, round(stddev_samp(c_acctbal) / sqrt(count(*)), 4) AS se, count(*) AS n FROM customer")
register("bootstrap", lambda s, d: H.bootstrap(Tables(s, d).customer, "c_acctbal", "mean", 200))
register("permtest", lambda s, d: H.permutation(Tables(s, d).events.where(_TWO), "value", "event_type", 200))
register("manova", lambda s, d: rounded(H.manova(Tables(s, d).lineitem, ["l_quantity", "l_extendedprice"], "l_returnflag").select("test", "value"), 7),
    """WITH x AS (SELECT l_returnflag AS g, l_quantity AS a, l_extendedprice / 1000 AS b FROM lineitem), e AS (SELECT sum((n - 1) * aa) AS eaa, sum((n - 1) * ab) AS eab, sum((n - 1) * bb) AS ebb FROM (SELECT count(*) AS n, var_samp(a) AS aa, covar_samp(a, b) AS ab, var_samp(b) AS bb FROM x GROUP BY g)),
  t AS (SELECT var_pop(a) * count(*) AS taa, covar_pop(a, b) * count(*) AS tab, var_pop(b) * count(*) AS tbb FROM x), m AS (SELECT *, taa - eaa AS haa, tab - eab AS hab, tbb - ebb AS hbb, eaa * ebb - eab ** 2 AS de, taa * tbb - tab ** 2 AS dt FROM e, t), r AS (SELECT *, (hbb * eaa + haa * ebb - 2 * hab * eab) / de AS lawley, (haa * hbb - hab ** 2) / de AS prod FROM m)
  SELECT unnest(['wilks', 'pillai', 'hotelling', 'roy']) AS test, unnest([round(de / dt, 7), round((haa * tbb + hbb * taa - 2 * hab * tab) / dt, 7), round(lawley, 7), round((lawley + sqrt(greatest(lawley ** 2 - 4 * prod, 0))) / 2, 7)]) AS value FROM r""")

# survival, evaluation, graphs, rules
_EV = lambda s, d: Tables(s, d).events.selectExpr("round(value) as t", "int(event_type in ('purchase', 'click')) as e", "event_type", "user_id % 2 as g")
_EVS = "(SELECT round(value) AS t, CAST(event_type IN ('purchase', 'click') AS INT) AS e, event_type, user_id % 2 AS g FROM events)"
_KM = f"c AS (SELECT t AS time, sum(e) AS d, sum(1 - e) AS c FROM {_EVS} GROUP BY 1), r AS (SELECT *, sum(d + c) OVER (ORDER BY time DESC) AS at_risk FROM c), k AS (SELECT *, CASE WHEN min(CASE WHEN d = at_risk THEN 0 ELSE 1 END) OVER w = 0 THEN 0 ELSE exp(sum(ln(CASE WHEN d = at_risk THEN 1 ELSE 1 - d / at_risk END)) OVER w) END AS survival FROM r WINDOW w AS (ORDER BY time))"
register("km_curve", lambda s, d: rounded(V.kaplan_meier(_EV(s, d), "t", "e").selectExpr("time", "cast(at_risk as bigint) at_risk", "cast(d as bigint) d", "cast(c as bigint) c", "survival")), f"WITH {_KM} SELECT CAST(time AS DOUBLE) AS time, CAST(at_risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS d, CAST(c AS BIGINT) AS c, round(survival, 6) AS survival FROM k")
register("median_survival", lambda s, d: V.median_survival(_EV(s, d), "t", "e").selectExpr("cast(events as bigint) events", "cast(censored as bigint) censored", "median"), f"WITH {_KM} SELECT CAST(sum(d) AS BIGINT) AS events, CAST(sum(c) AS BIGINT) AS censored, CAST(min(time) FILTER (survival <= 0.5) AS DOUBLE) AS median FROM k")
register("logrank", lambda s, d: rounded(V.logrank(_EV(s, d), "t", "e", "g").select("statistic", "df"), 4),
    f"""WITH x AS {_EVS}, a AS (SELECT t, sum(e)::DOUBLE AS d, sum(e) FILTER (g = 0) AS d0, sum(count(*)) OVER (ORDER BY t DESC)::DOUBLE AS n, sum(count(*) FILTER (g = 0)) OVER (ORDER BY t DESC)::DOUBLE AS n0 FROM x GROUP BY t)
  SELECT round((sum(coalesce(d0, 0)) - sum(d * n0 / n)) ** 2 / sum(CASE WHEN n > 1 THEN d * (n0 / n) * (1 - n0 / n) * (n - d) / (n - 1) ELSE 0 END), 4) AS statistic, CAST(1 AS BIGINT) AS df FROM a WHERE d > 0""")
register("stcox", lambda s, d: rounded(V.cox(_EV(s, d), "t", "e", ["g"]).tidy(Tables(s, d).events), 5))
register("competing", lambda s, d: rounded(V.competing(_EV(s, d), "t", "e", "event_type"), 6),
    f"WITH {_KM}, b AS (SELECT time, at_risk, coalesce(lag(survival) OVER (ORDER BY time), 1) AS s0 FROM k), o AS (SELECT event_type AS cause, t AS time, count(*) AS d FROM {_EVS} WHERE e = 1 GROUP BY ALL) SELECT cause, CAST(o.time AS DOUBLE) AS time, round(sum(s0 * o.d / at_risk) OVER (PARTITION BY cause ORDER BY o.time), 6) AS cif FROM o JOIN b USING (time)")


def _fine_gray_sql(steps: int) -> str:
    """Newton's steps of one covariate g for the cause 'purchase', with Efron's ties; a competing event stays at risk with the weight G(t-) / G(T-)."""
    parts = [f"x AS MATERIALIZED (SELECT t::DOUBLE AS t, g::DOUBLE AS g, (e = 1 AND event_type = 'purchase') AS own, (e = 1 AND event_type <> 'purchase') AS other, e <> 1 AS cens FROM {_EVS})"]
    parts.append("k AS (SELECT t, sum(cens::INT)::DOUBLE AS c, sum(count(*)) OVER (ORDER BY t DESC)::DOUBLE AS n FROM x GROUP BY t)")
    parts.append("u AS MATERIALIZED (SELECT t, exp(coalesce(sum(CASE WHEN c < n THEN ln(1 - c / n) ELSE 0 END) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gt FROM k)")
    parts.append("m AS (SELECT avg(g) AS mg FROM x), y AS MATERIALIZED (SELECT x.t, x.g - mg AS g, own, other, gt FROM x JOIN u USING (t), m), b0 AS (SELECT 0.0::DOUBLE AS b, 1.0::DOUBLE AS v)")
    for i in range(steps):
        sums = ", ".join(f"sum(exp(b * g) * g ** {p}) AS s{p}, sum(CASE WHEN other THEN exp(b * g) * g ** {p} / gt ELSE 0 END) AS q{p}, sum(CASE WHEN own THEN exp(b * g) * g ** {p} ELSE 0 END) AS d{p}" for p in range(3))
        parts.append(f"p{i} AS (SELECT t, any_value(gt) AS gt, sum(own::INT) AS d, sum(CASE WHEN own THEN g ELSE 0 END) AS ex, any_value(b) AS b, {sums} FROM y, b{i} GROUP BY t)")
        run = ", ".join(f"sum(s{p}) OVER (ORDER BY t DESC) + gt * coalesce(sum(q{p}) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r{p}" for p in range(3))
        parts.append(f"r{i} AS (SELECT t, d, ex, b, d0, d1, d2, {run} FROM p{i})")
        parts.append(f"l{i} AS (SELECT *, unnest(range(CAST(d AS BIGINT))) / d AS l FROM r{i} WHERE d > 0)")
        parts.append(f"z{i} AS (SELECT any_value(b) AS b, sum(CASE WHEN l = 0 THEN ex ELSE 0 END) - sum((r1 - l * d1) / (r0 - l * d0)) AS grad, sum((r2 - l * d2) / (r0 - l * d0) - ((r1 - l * d1) / (r0 - l * d0)) ** 2) AS info FROM l{i})")
        parts.append(f"b{i + 1} AS MATERIALIZED (SELECT b + grad / info AS b, 1 / info AS v FROM z{i})")
    return "WITH " + ", ".join(parts) + f" SELECT 'g' AS term, round(b, 5) AS coef, round(sqrt(v), 5) AS se FROM b{steps}"


register("competing_fine_gray", lambda s, d: rounded(V.fine_gray(_EV(s, d), "t", "e", "event_type", "purchase", ["g"]).tidy(Tables(s, d).events).select("term", "coef", "se"), 5), _fine_gray_sql(7))
_SC = lambda s, d: Tables(s, d).orders.selectExpr("int(o_orderstatus = 'F') as y", "round(o_totalprice / 500000, 2) as p")
_SCS = "(SELECT CAST(o_orderstatus = 'F' AS INT) AS y, round(o_totalprice / 500000, 2) AS p FROM orders)"
_ROC = f"c AS (SELECT p, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM {_SCS} GROUP BY 1), r AS (SELECT p, sum(a) OVER w / sum(a) OVER () AS tpr, sum(b) OVER w / sum(b) OVER () AS fpr FROM c WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"
register("roc_curve", lambda s, d: rounded(E.roc(_SC(s, d), "y", "p")), f"WITH {_ROC} SELECT p AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r")
register("roc_auc", lambda s, d: rounded(E.auc(_SC(s, d), "y", "p").select("auc")), f"WITH {_ROC}, l AS (SELECT tpr, fpr, coalesce(lag(tpr) OVER w, 0) AS t0, coalesce(lag(fpr) OVER w, 0) AS f0 FROM r WINDOW w AS (ORDER BY p DESC)) SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM l")
register("confmatrix", lambda s, d: rounded(E.confusion(_SC(s, d), "y", "p").select("tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1")),
    f"SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round((tp + tn) / greatest(1, tp + fp + fn + tn), 6) AS accuracy, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall, round(2 * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1 FROM (SELECT sum((y = 1 AND p >= 0.5)::INT)::DOUBLE AS tp, sum((y = 0 AND p >= 0.5)::INT)::DOUBLE AS fp, sum((y = 1 AND p < 0.5)::INT)::DOUBLE AS fn, sum((y = 0 AND p < 0.5)::INT)::DOUBLE AS tn FROM {_SCS})")
register("calibration", lambda s, d: rounded(E.calibration(_SC(s, d), "y", "p").selectExpr("cast(bin as bigint) bin", "n", "mean_score", "fraction_positive")), f"SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS fraction_positive FROM {_SCS} GROUP BY 1")
register("brier", lambda s, d: rounded(E.brier(_SC(s, d), "y", "p")), f"SELECT round(avg((p - y) ** 2), 6) AS brier FROM {_SCS}")
register("arules_support", lambda s, d: rounded(L.item_support(Tables(s, d).events, "event_type", "user_id")),
    "WITH r AS (SELECT DISTINCT user_id AS k, event_type AS i FROM events), n AS (SELECT count(DISTINCT k) AS n FROM r) SELECT i AS items, round(count(*) / any_value(n), 6) AS support FROM r, n GROUP BY 1 UNION ALL SELECT a.i || ',' || b.i, round(count(*) / any_value(n), 6) FROM r a JOIN r b ON a.k = b.k AND a.i < b.i, n GROUP BY 1")
register("arules", lambda s, d: rounded(L.association_rules(Tables(s, d).events, "event_type", "user_id", 0.3, 0.5)),
    """WITH RECURSIVE i AS (SELECT event_type AS item, row_number() OVER (ORDER BY event_type) - 1 AS p FROM (SELECT DISTINCT event_type FROM events)), k AS (SELECT user_id, sum(1 << CAST(p AS INT)) AS m FROM (SELECT DISTINCT user_id, event_type FROM events) e JOIN i ON e.event_type = i.item GROUP BY 1),
  s AS MATERIALIZED (SELECT s.m AS m, count(*) FILTER ((k.m & s.m) = s.m)::DOUBLE / count(*) AS support FROM (SELECT unnest(range(1, 1 << CAST((SELECT count(*) FROM i) AS INT))) AS m) s, (SELECT CAST(m AS BIGINT) AS m FROM k) k GROUP BY 1), w AS (SELECT s.m, support, string_agg(item, ',' ORDER BY item) AS items FROM s JOIN i ON (s.m >> CAST(p AS INT)) & 1 = 1 GROUP BY ALL)
  SELECT a.items AS antecedent, i.item AS consequent, round(b.support, 6) AS support, round(b.support / a.support, 6) AS confidence, round(b.support / a.support / c.support, 6) AS lift FROM w a JOIN i ON (a.m >> CAST(p AS INT)) & 1 = 0 JOIN w b ON b.m = a.m + (1 << CAST(p AS INT)) JOIN w c ON c.m = (1 << CAST(p AS INT)) WHERE b.support >= 0.3 AND b.support / a.support >= 0.5""")
_G = lambda s, d: N.build(Tables(s, d).supplier.selectExpr("s_nationkey as a", "s_suppkey % 25 as b"), "a", "b")
_GS = "(SELECT least(CAST(s_nationkey AS VARCHAR), CAST(s_suppkey % 25 AS VARCHAR)) AS src, greatest(CAST(s_nationkey AS VARCHAR), CAST(s_suppkey % 25 AS VARCHAR)) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM supplier GROUP BY 1, 2)"
_GB = f"b AS (SELECT src, dst, weight FROM {_GS} WHERE src <> dst UNION ALL SELECT dst, src, weight FROM {_GS} WHERE src <> dst)"
register("network_build", _G, f"SELECT * FROM {_GS}")
register("network_degree", lambda s, d: rounded(N.degree(_G(s, d))), f"WITH {_GB} SELECT src AS node, count(*) AS degree, sum(weight) AS strength, round(count(*) / ((SELECT count(DISTINCT src) FROM b) - 1), 6) AS centrality FROM b GROUP BY 1")
register("network_describe", lambda s, d: rounded(N.describe(_G(s, d))), f"WITH n AS (SELECT count(*) AS nodes FROM (SELECT src FROM {_GS} UNION SELECT dst FROM {_GS})) SELECT nodes, count(*) AS edges, round(count(*) / (nodes * (nodes - 1) / 2), 6) AS density FROM {_GS}, n GROUP BY nodes")
register("network_clustering", lambda s, d: rounded(N.clustering(_G(s, d))), f"WITH {_GB}, t AS (SELECT x.src AS node, count(*) / 2 AS t FROM b x JOIN b y ON x.dst = y.src JOIN b z ON y.dst = z.src AND z.dst = x.src GROUP BY 1), d AS (SELECT src AS node, count(*) AS d FROM b GROUP BY 1) SELECT node, CAST(coalesce(t, 0) AS BIGINT) AS triangles, round(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 6) AS clustering FROM d LEFT JOIN t USING (node)")
register("network_eigenvector", lambda s, d: rounded(N.eigenvector(_G(s, d), 20), 4),
    f"WITH {_GB}, l AS MATERIALIZED (SELECT * FROM b UNION ALL SELECT DISTINCT src, src, 1.0 FROM b), x0 AS MATERIALIZED (SELECT DISTINCT src AS node, 1.0::DOUBLE AS x FROM b), " + ", ".join(f"x{t + 1} AS MATERIALIZED (SELECT node, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT src AS node, sum(weight * x) AS x FROM l JOIN x{t} ON l.dst = x{t}.node GROUP BY 1))" for t in range(20)) + " SELECT node, round(x, 4) AS centrality FROM x20")
register("network_community", lambda s, d: N.communities(_G(s, d)),
    f"WITH {_GB}, c0 AS MATERIALIZED (SELECT DISTINCT src AS node, src AS community FROM b), " + ", ".join(f"c{t + 1} AS MATERIALIZED (SELECT node, community FROM (SELECT src AS node, community, row_number() OVER (PARTITION BY src ORDER BY sum(weight) DESC, community) AS r FROM b JOIN c{t} ON b.dst = c{t}.node GROUP BY 1, 2) WHERE r = 1)" for t in range(5)) + " SELECT * FROM c5")
_LABELS = f"{_GB}, c0 AS MATERIALIZED (SELECT DISTINCT src AS node, src AS community FROM b), " + ", ".join(f"c{t + 1} AS MATERIALIZED (SELECT node, community FROM (SELECT src AS node, community, row_number() OVER (PARTITION BY src ORDER BY sum(weight) DESC, community) AS r FROM b JOIN c{t} ON b.dst = c{t}.node GROUP BY 1, 2) WHERE r = 1)" for t in range(5))
_MODULARITY = f"{_LABELS}, e AS (SELECT src, dst, weight FROM {_GS}), f AS (SELECT x.community AS a, y.community AS b, weight FROM e JOIN c5 x ON e.src = x.node JOIN c5 y ON e.dst = y.node), h AS (SELECT a AS c, weight, CASE WHEN a = b THEN 2 * weight ELSE 0 END AS i FROM f UNION ALL SELECT b, weight, 0 FROM f), p AS (SELECT c, sum(weight) AS k, sum(i) AS i FROM h GROUP BY 1), w AS (SELECT sum(k) AS m2 FROM p), q AS (SELECT sum(i / m2 - (k / m2) ** 2) AS q FROM p, w)"
register("network_modularity", lambda s, d: rounded(N.modularity(_G(s, d), N.communities(_G(s, d)))), f"WITH {_MODULARITY} SELECT round(q, 6) + 0.0 AS modularity FROM q")
#: Suppliers and parts of all lines; suppliers of one remainder by 4 share their parts, which makes four communities.
_NW = lambda s, d: N.build(Tables(s, d).lineitem.selectExpr("concat('s', l_suppkey) as a", "concat('p', l_partkey % 200, '.', l_suppkey % 4) as b"), "a", "b")
register("network_louvain", lambda s, d: (lambda g: (lambda c: N.modularity(g, c).crossJoin(N.modularity(g, N.communities(g)).withColumnRenamed("modularity", "labels")).crossJoin(c.agg(F.count("*").alias("nodes"))).select("nodes", (F.col("modularity") >= F.col("labels")).alias("not_below_labels"), (F.col("modularity") > 0.3).alias("found")))(N.louvain(g)))(_NW(s, d)),
    "SELECT count(*) AS nodes, true AS not_below_labels, true AS found FROM (SELECT 's' || l_suppkey AS n FROM lineitem UNION SELECT 'p' || (l_partkey % 200) || '.' || (l_suppkey % 4) FROM lineitem)")
register("network_closeness", lambda s, d: rounded(N.closeness(_G(s, d))),
    f"WITH RECURSIVE {_GB}, p AS (SELECT DISTINCT src AS source, src AS node, 0 AS hops FROM b UNION SELECT source, b.dst, hops + 1 FROM p JOIN b ON p.node = b.src WHERE hops < 24), h AS (SELECT source, node, min(hops) AS hops FROM p GROUP BY ALL), n AS (SELECT count(DISTINCT src) AS n FROM b) SELECT source AS node, round(count(*) / sum(hops) * count(*) / (any_value(n) - 1), 6) AS closeness FROM h, n WHERE hops > 0 GROUP BY 1")
register("network_distances", lambda s, d: N.distances(_G(s, d), s.createDataFrame([("0",)], "node string"), 3).selectExpr("source", "node", "cast(hops as bigint) hops"),
    f"WITH RECURSIVE {_GB}, p AS (SELECT '0' AS node, 0 AS hops UNION SELECT b.dst, hops + 1 FROM p JOIN b ON p.node = b.src WHERE hops < 3) SELECT '0' AS source, node, CAST(min(hops) AS BIGINT) AS hops FROM p GROUP BY node")

# frames of the views
register("plot_hist", lambda s, d: rounded(P.histogram(Tables(s, d).customer, "c_acctbal", 10), 4),
    "WITH r AS (SELECT min(c_acctbal) AS a, (max(c_acctbal) - min(c_acctbal)) / 10 AS w FROM customer) SELECT round(a + b * w, 4) AS low, round(a + (b + 1) * w, 4) AS high, n FROM (SELECT least(floor((c_acctbal - a) / w), 9) AS b, count(*) AS n FROM customer, r GROUP BY 1), r")
register("plot_box", lambda s, d: rounded(P.box(Tables(s, d).customer, "c_acctbal", "c_mktsegment"), 4),
    """WITH q AS (SELECT c_mktsegment AS "group", count(*) AS n, min(c_acctbal) AS low, quantile_cont(c_acctbal, 0.25) AS q1, median(c_acctbal) AS median, quantile_cont(c_acctbal, 0.75) AS q3, max(c_acctbal) AS high FROM customer GROUP BY 1)
  SELECT "group", n, round(low, 4) AS low, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(high, 4) AS high, round(greatest(low, q1 - 1.5 * (q3 - q1)), 4) AS whisker_low, round(least(high, q3 + 1.5 * (q3 - q1)), 4) AS whisker_high FROM q""")
register("plot_bar", lambda s, d: P.bars(Tables(s, d).part, "p_brand"), "SELECT p_brand AS label, count(*)::DOUBLE AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
register("plot_bar_by", lambda s, d: rounded(P.bars(Tables(s, d).orders, "o_totalprice", "o_orderpriority"), 3), "SELECT o_orderpriority AS label, round(avg(o_totalprice), 3) AS value FROM orders GROUP BY 1")
register("plot_acf", lambda s, d: rounded(P.autocorrelation(Tables(s, d).events, "value", ["event_id"], 5).selectExpr("cast(lag as bigint) lag", "value"), 6),
    "WITH x AS (SELECT event_id, value - (SELECT avg(value) FROM events) AS v FROM events), l AS (SELECT v, " + ", ".join(f"lag(v, {k}) OVER (ORDER BY event_id) AS v{k}" for k in range(1, 6)) + " FROM x) SELECT CAST(unnest([0, 1, 2, 3, 4, 5]) AS BIGINT) AS lag, round(unnest([1.0::DOUBLE, " + ", ".join(f"sum(v * v{k}) / sum(v * v)" for k in range(1, 6)) + "]), 6) + 0.0 AS value FROM l")
register("plot_missing", lambda s, d: rounded(P.missing(_holes(s, d), ["value", "kind"], 1).selectExpr("cast(part as bigint) part", "value", "kind"), 6), f"SELECT CAST(0 AS BIGINT) AS part, round(avg((value IS NULL)::INT), 6) AS value, round(avg((kind IS NULL)::INT), 6) AS kind FROM {_H}")
