"""Distribution functions, the languages, null and NaN rules, and models against constructed truth."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.functions import dsl
from tallyfold.operators import aggregate, joins, sets, transform
from tallyfold.operators.ordered import numbered, order_statistics
from tallyfold.stats import dist, regression
from tallyfold.stats import tests as stat_tests


@pytest.mark.parametrize(
    ("got", "want"),
    [(dist.t_cdf(2, 10), 0.96330598), (dist.f_cdf(3, 2, 10), 0.90463257), (dist.chi2_cdf(4, 3), 0.73853587), (dist.norm_ppf(0.975), 1.95996398), (dist.t_ppf(0.975, 10), 2.22813885), (dist.studentized_range_cdf(3.5, 3, 20), 0.9437)],
)
def test_distributions(got, want):
    assert got == pytest.approx(want, abs=2e-3 if want == 0.9437 else 1e-7)


def test_distributions_against_commons_math(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for x in (0.3, 1.7, 4.2):
        assert dist.t_cdf(x, 7) == pytest.approx(d.TDistribution(7.0).cumulativeProbability(x), abs=1e-10)
        assert dist.f_cdf(x, 3, 9) == pytest.approx(d.FDistribution(3.0, 9.0).cumulativeProbability(x), abs=1e-9)
        assert dist.chi2_cdf(x, 5) == pytest.approx(d.ChiSquaredDistribution(5.0).cumulativeProbability(x), abs=1e-10)


def test_expressions(spark):
    df = spark.createDataFrame([(7, 2, "ab", None), (-7, 3, "Ac", 1.0)], "a long, b long, s string, n double")
    value = lambda e: [r[0] for r in df.select(dsl.expression(e, df)).collect()]
    assert value("a % b") == [1, 2]
    assert value("a / (b - 2)") == [math.inf, -7.0]
    assert value("-a ** 2") == [49, 49]
    assert value("s + 'x'") == ["abx", "Acx"]
    assert value("not a > 0 or b == 2") == [True, True]
    assert value("fill_null(n, 5)") == [5.0, 1.0]
    assert value("contains(s, '^A')") == [False, True]
    with pytest.raises(dsl.ExpressionError):
        dsl.expression("zz + 1", df)
    with pytest.raises(dsl.ExpressionError):
        dsl.expression("a +", df)


def test_formula():
    assert dsl.formula("y ~ a*b + c + a").names == ["a", "b", "a:b", "c"]


def test_nulls_and_nan(spark):
    df = spark.createDataFrame([(1, None), (2, math.nan), (3, 4.0)], "k long, v double")
    assert transform.drop_null(df, ["v"]).count() == 2
    assert [r.v for r in transform.fill_null(df, "v", "value", 0.0).orderBy("k").collect()][0] == 0.0
    assert aggregate.group_by(df, ["v"], [("k", "count")]).count() == 3
    assert sets.unique(df, "v").count() == 3


def test_order(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "i long, v double")
    got = numbered(df.repartition(5), ["i"]).orderBy("i").collect()
    assert [r["__rn"] for r in got] == list(range(500))
    assert {r.q: r.value for r in order_statistics(df, "v", [0.5], "linear").collect()}[0.5] == np.quantile([i % 7 for i in range(500)], 0.5)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k long, v double, s string")
    assert transform.fill_null(df, "v", "mean").count() == 0
    assert transform.bin_values(df, "v", 3).count() == 0
    assert sets.drop_duplicates(df, ["k"]).count() == 0
    assert transform.rolling(df, "v", 3, "mean", ["k"]).count() == 0
    assert joins.anti_join(df, df, "k").count() == 0


def test_null_keys_do_not_match(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k long, x long")
    assert joins.merge(a, a, "k").count() == 1
    assert joins.anti_join(a, a, "k").count() == 1


def test_ratios():
    assert joins.ratio("abcd", "abcd") == 100
    assert joins.ratio("ab", "ba") == 50
    assert joins.token_sort_ratio("a b", "b a") == 100
    assert joins.partial_ratio("bc", "abcd") == 100


def test_models_recover_truth(spark):
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=3000), rng.normal(size=3000)
    y = 1 + 2 * x - z + 0.1 * rng.normal(size=3000)
    p = (rng.random(3000) < 1 / (1 + np.exp(-(0.5 + x)))).astype(int)
    k = rng.poisson(np.exp(0.3 + 0.5 * x))
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, z, y, p, k, strict=True)], "x double, z double, y double, p double, k double")
    assert regression.ols(df, "y ~ x + z").params == pytest.approx([1, 2, -1], abs=0.02)
    assert regression.glm(df, "p ~ x", "logit").params == pytest.approx([0.5, 1], abs=0.2)
    assert regression.glm(df, "p ~ x", "probit").params == pytest.approx([0.3, 0.6], abs=0.15)
    assert regression.glm(df, "k ~ x", "poisson").params == pytest.approx([0.3, 0.5], abs=0.1)
    assert regression.quantreg(df, "y ~ x + z").params == pytest.approx([1, 2, -1], abs=0.02)
    a = np.column_stack((np.ones(3000), x, z))
    e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    want = np.sqrt(np.diag(np.linalg.inv(a.T @ a) * (e @ e) / 2997))
    assert regression.ols(df, "y ~ x + z").se == pytest.approx(want, rel=1e-6)


def test_jackknife_against_leaving_out(spark):
    v = [1.0, 2.0, 4.0, 8.0, 9.0, 12.0, 13.0, 20.0, 21.0]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for stat, f in (("mean", np.mean), ("std", lambda a: np.std(a, ddof=1)), ("median", np.median), ("max", np.max)):
        loo = np.array([f([x for j, x in enumerate(v) if j != i]) for i in range(len(v))])
        r = stat_tests.jackknife(df, "v", stat).first()
        assert r.estimate == pytest.approx(f(v))
        assert r.se == pytest.approx(math.sqrt((len(v) - 1) * loo.var()), rel=1e-6), stat


def test_streaming_windows(spark, tmp_path):
    from tallyfold.streaming import windows

    spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k long, v double").parquet(f"{tmp_path}/in")
    q = windows.tumbling(stream, "ts", "10 minutes", "5 minutes", ["k"], "v").writeStream.outputMode("complete").format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("out").agg(F.sum("n")).first()[0] == 100


def test_series_queries_read_every_day(spark):
    from tallyfold.plans import catalogue

    sf = "/root/testdata/sf0.001"
    days = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("to_date(o_orderdate) as day").distinct().count()
    assert catalogue.queries()["stl"](spark, sf).first()["n"] == days
    assert all(catalogue.queries()[name](spark, sf).count() for name in ("arima", "garch"))


def test_fuzzy_join_compares_all_at_every_size(spark):
    from tallyfold.operators import joins

    left = spark.createDataFrame([("0000-0000",), ("abcdefghij",), ("zzz",)], "name string")
    right = spark.createDataFrame([("0000-0000",), ("axcxexgxij",), ("other",)], "name string")
    got = {(r["name"], r["_fuzzy_match"], r["_fuzzy_score"]) for r in joins.fuzzy_join(left, right, "name", 60).collect()}
    assert got == {("0000-0000", "0000-0000", 100.0), ("abcdefghij", "axcxexgxij", 60.0), ("zzz", None, None)}


def test_hierarchical_query_reads_every_supplier(spark):
    from tallyfold.plans import catalogue

    sf = "/root/testdata/sf0.1"
    whole = spark.read.parquet(f"{sf}/supplier.parquet").count()
    assert sum(r["size"] for r in catalogue.queries()["hierarchical"](spark, sf).collect()) == whole
