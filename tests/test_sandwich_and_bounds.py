"""Sandwich errors of likelihood models, learning curves, and levels that must be few."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import aggregate as A
from tallyfold.session import Session
from tallyfold.stats import learning as L
from tallyfold.stats import likelihood as K
from tallyfold.stats import regression as R
from tallyfold.stats import survival, tests as H


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(8)
    x, g = r.normal(0, 1, 1200), r.integers(0, 40, 1200)
    e = x + r.normal(0, 1, 40)[g] * 0.5 + r.logistic(0, 1, 1200)
    pdf = pd.DataFrame({"x": x, "g": g, "two": (e > 0).astype(int), "three": np.digitize(e, [-1, 1]), "n": r.poisson(np.exp(0.3 * x + 0.5)), "amount": np.maximum(1 + 2 * x + r.normal(0, 1, 1200), 0)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("how", [{"robust": True}, {"cluster": "g"}])
def test_two_levels_equal_the_binary_model(sample, how):
    _, df = sample
    for link in ("logit", "probit"):
        got, want = K.ordered(df, "two ~ x", link, **how), R.glm(df, "two ~ x", link, **how)
        assert np.allclose([-got.params[0], got.params[1]], want.params, atol=1e-4)
        assert np.allclose(got.se, want.se, rtol=2e-3 if link == "logit" else 0.03)  # observed against expected information
    got, want = K.mlogit(df, "two ~ x", **how), R.glm(df, "two ~ x", "logit", **how)
    assert np.allclose(got.params, want.params, atol=1e-4) and np.allclose(got.se, want.se, rtol=2e-3)


def test_ordered_cut_errors_by_the_delta_method(sample):
    """Three levels: the cuts' sandwich against scores in the cuts themselves."""
    pdf, df = sample
    fit = K.ordered(df, "three ~ x", robust=True)
    x, y = pdf.x.to_numpy(), pdf.three.to_numpy()

    def ll(p):
        c, f = np.array([-np.inf, p[0], p[1], np.inf]), lambda z: 1 / (1 + np.exp(-z))
        return np.log(f(c[y + 1] - p[2] * x) - f(c[y] - p[2] * x))

    h, k, b = 1e-4, 3, fit.params
    e = np.eye(k) * h
    s = np.column_stack([(ll(b + e[i]) - ll(b - e[i])) / (2 * h) for i in range(k)])
    hess = np.array([[(ll(b + e[i] + e[j]) - ll(b + e[i] - e[j]) - ll(b - e[i] + e[j]) + ll(b - e[i] - e[j])).sum() / (4 * h * h) for j in range(k)] for i in range(k)])
    inv = np.linalg.inv(-hess)
    want = np.sqrt(np.diag(inv @ s.T @ s @ inv * 1200 / 1199))
    assert np.allclose(fit.se, want, rtol=5e-3)


def test_other_models_take_both(sample, spark):
    _, df = sample
    for fit in (K.negbin, K.tobit, K.zip_model):
        y = "amount" if fit is K.tobit else "n"
        plain, robust, cluster = fit(df, f"{y} ~ x"), fit(df, f"{y} ~ x", robust=True), fit(df, f"{y} ~ x", cluster="g")
        assert np.allclose(plain.params, robust.params, atol=1e-6) and np.allclose(plain.params, cluster.params, atol=1e-6)
        assert np.allclose(robust.se[:2], plain.se[:2], rtol=0.25) and not np.allclose(robust.se, cluster.se, rtol=1e-4)
    holes = df.withColumn("g", F.when(F.col("g") > 3, F.col("g")))
    assert K.ordered(holes, "three ~ x", cluster="g").n == df.where("g > 3").count()
    s = Session(spark)
    s.use(df)
    one, two = s.run("ologit three ~ x").collect(), s.run("ologit three ~ x, robust").collect()
    three = s.run("oprobit three ~ x --cluster=g").collect()
    assert one[2].coef == pytest.approx(two[2].coef) and one[2].se != two[2].se and three[2].term == "x"
    both = s.run("logit two ~ x, cluster(g) robust").collect()
    assert both[1].se == pytest.approx(R.glm(df, "two ~ x", "logit", cluster="g").se[1])
    with pytest.raises(ValueError, match="not known"):
        s.run("ologit three ~ x, sturdy")


def test_learning_curves(sample, spark):
    _, df = sample
    got = L.model_curve(df, "two", ["x"], "logit", 3, 4).collect()
    assert [round(r.share, 2) for r in got] == [0.1, 0.55, 1.0] and got[0].n < got[1].n < got[2].n == 900
    assert 0.6 < got[2].cv < 0.9 and abs(got[2].train - got[2].cv) < 0.05
    again = L.model_curve(df.repartition(5), "two", ["x"], "logit", 3, 4).collect()
    assert all(a.n == b.n and a.cv == pytest.approx(b.cv) for a, b in zip(got, again, strict=True))
    s = Session(spark)
    s.use(df)
    rf = s.run("learncurve amount x --model=rf --steps=2 --cv=2 --n=5").collect()
    assert len(rf) == 2 and rf[1].cv > 0.6
    assert s.run("learncurve amount x --steps=4").count() == 4
    for bad in ("learncurve amount x --model=svm", "learncurve amount x --folds=3"):
        with pytest.raises(ValueError):
            s.run(bad)


def test_few_levels(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 100).alias("a"), (F.col("id") % 3).alias("b"), F.col("id").cast("double").alias("v"))
    monkeypatch.setattr(A, "MOST_COLUMNS", 50)
    for many in (lambda: A.pivot(df, "v", "a", ["b"]), lambda: A.reshape_wide(df, ["v"], ["b"], "a")):
        with pytest.raises(ValueError, match="more than 50"):
            many()
    monkeypatch.setattr(K, "MOST_LEVELS", 10)
    for fit in (K.ordered, K.mlogit):
        with pytest.raises(ValueError, match="more than 10"):
            fit(df, "a ~ v")
    monkeypatch.setattr(survival, "MOST_GROUPS", 10)
    with pytest.raises(ValueError, match="more than 10"):
        survival.logrank(df.withColumn("e", F.lit(1)), "v", "e", "a")
    monkeypatch.setattr(H, "MOST_GROUPS", 10)
    with pytest.raises(ValueError, match="more than 10"):
        H.anova(df, "v", "a")
    assert A.pivot(df, "v", "b", ["a"]).columns == ["a", "0", "1", "2"]


def test_chi2(spark):
    rows = [("a", "x")] * 30 + [("a", "y")] * 5 + [("b", "x")] * 12 + [("c", "y")] * 9 + [(None, "x"), ("a", None)]
    got = H.chi2(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    o = np.array([[30, 5], [12, 0], [0, 9]], float)  # cells without rows
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    assert got.statistic == pytest.approx(((o - e) ** 2 / e).sum()) and (got.df, got.n) == (2, 56)
    corner = [("a", "x")] * 3 + [("b", "y")] * 4 + [("b", "x")] * 2
    o = np.array([[3, 0], [2, 4]], float)
    e = np.outer(o.sum(1), o.sum(0)) / 9
    gap = np.abs(o - e)
    got = H.chi2(spark.createDataFrame(corner, "a string, b string"), "a", "b").first()
    assert got.statistic == pytest.approx(((gap - np.minimum(0.5, gap)) ** 2 / e).sum()) and got.df == 1
    with pytest.raises(ValueError, match="no rows"):
        H.chi2(spark.createDataFrame([], "a string, b string"), "a", "b")
