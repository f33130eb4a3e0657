"""B-splines against the divided-difference form, splines against least squares, local regression against direct fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfold.session import Session
from tallyfold.stats import smooth as S


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(5)
    x = np.round(r.uniform(0, 10, 400), 1)  # ties
    z = r.normal(0, 1, 400)
    y = np.sin(x) + 0.3 * z + r.normal(0, 0.2, 400)
    y[::37] += 8  # outliers
    pdf = pd.DataFrame({"x": x, "z": z, "y": y})
    return pdf, spark.createDataFrame(pdf)


def direct(pdf, frac, rounds):
    """Local lines by weighted least squares at every row, window by window."""
    x, y = pdf.x.to_numpy(), pdf.y.to_numpy()
    k, robust, fit = max(2, int(frac * len(x) + 1e-10)), np.ones(len(x)), None
    for t in range(rounds + 1):
        if t:
            e = np.abs(y - fit)
            u = np.minimum(e / (6 * np.median(e)), 1)
            robust = (1 - u**2) ** 2
        fit = np.empty(len(x))
        for i, v in enumerate(x):
            d = np.abs(x - v)
            h = np.sort(d)[k - 1]
            s = d / h
            w = np.where(s <= 0.001, 1, np.where(s <= 0.999, (1 - np.minimum(s, 1) ** 3) ** 3, 0)) * robust
            a = np.column_stack((np.ones(len(x)), x - v))
            fit[i] = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0]
    return fit


@pytest.mark.parametrize(("frac", "rounds"), [(0.3, 3), (0.15, 0), (1.0, 1)])
def test_loess_equals_direct_fits(sample, frac, rounds):
    pdf, df = sample
    got = S.loess_values(df, "y", "x", frac, rounds).toPandas()
    want = pd.Series(direct(got, frac, rounds))
    assert np.allclose(got.smooth, want, atol=1e-7)
    curve = S.loess(df.repartition(6), "y", "x", frac, rounds).toPandas()
    assert curve.x.is_monotonic_increasing and np.allclose(curve.smooth, got.groupby("x").smooth.first(), atol=1e-8)


def test_loess_between_points(sample, spark):
    pdf, df = sample
    close = S.loess_values(df, "y", "x", 0.3, 1, 40).toPandas()
    assert np.abs(close.smooth - direct(close, 0.3, 1)).max() < 0.05
    assert S.loess(df, "y", "x", 0.3, 0, 12).count() == 12
    radii = S._radii(df.groupBy("x").agg(F.count("*").alias("n")), np.array([0.0, 3.33, 10.0]), 90)
    assert np.allclose(radii, [np.sort(np.abs(pdf.x - v))[89] for v in (0.0, 3.33, 10.0)], atol=0)


def test_loess_edges(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert S.loess(empty, "y", "x").count() == 0 and S.loess_values(empty, "y", "x").columns == ["x", "y", "smooth"]
    one = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (None, 1.0), (float("nan"), 1.0), (3.0, None)], "x double, y double")
    assert [(r.x, r.smooth) for r in S.loess(one, "y", "x", rounds=0).collect()] == [(1.0, 3.0)]
    got = S.loess_values(one, "y", "x", rounds=0).collect()
    assert sum(r.smooth is None for r in got) == 3
    line = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(30)], "x double, y double")
    assert all(r.smooth == pytest.approx(2 * r.x + 1) for r in S.loess(line, "y", "x").collect())  # residuals of size 0
    with pytest.raises(ValueError, match="frac"):
        S.loess(line, "y", "x", 0.0)


def _deboor(t, i, d, u, last):
    if d == 0:
        return float(t[i] <= u < t[i + 1] or (u == t[-1] and i == last))
    a = (u - t[i]) / (t[i + d] - t[i]) * _deboor(t, i, d - 1, u, last) if t[i + d] > t[i] else 0.0
    b = (t[i + d + 1] - u) / (t[i + d + 1] - t[i + 1]) * _deboor(t, i + 1, d - 1, u, last) if t[i + d + 1] > t[i + 1] else 0.0
    return a + b


def test_b_splines(sample, spark):
    at = [0.0, 2.0, 5.0, 10.0]
    us = [0.0, 0.5, 2.0, 4.99, 5.0, 9.0, 10.0]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    basis = S.b_splines(F.col("u"), at)
    got = np.array([list(r) for r in df.select(*basis).collect()])
    t = [0.0] * 3 + at + [10.0] * 3
    want = np.array([[_deboor(t, i, 3, u, len(t) - 5) for i in range(1, len(t) - 4)] for u in us])
    assert got.shape == (7, 5) and np.allclose(got, want)


@pytest.mark.parametrize("kind", ["natural", "bs"])
def test_splines_equal_truncated_powers(sample, kind):
    pdf, df = sample
    at = [2.0, 5.0, 7.5]
    both = S.spline_values(df, "y", ["x", "z"], 3, kind)
    assert both.columns == ["x", "z", "y", "smooth"]
    with pytest.raises(ValueError, match="inside"):
        S.spline_fit(df, "y", ["x"], [99.0], kind)
    one = S.spline_values(df, "y", ["x"], at, kind).toPandas()
    x = one.x.to_numpy()
    lo, hi = x.min(), x.max()
    cube = lambda k: np.maximum(x - k, 0) ** 3
    if kind == "bs":
        a = np.column_stack([x**0, x, x**2, x**3, *(cube(k) for k in at)])
    else:
        d = lambda k: (cube(k) - cube(hi)) / (hi - k)
        ks = [lo, *at]
        a = np.column_stack([x**0, x, *(d(k) - d(at[-1]) for k in ks[:-1])])
    want = a @ np.linalg.lstsq(a, one.y.to_numpy(), rcond=None)[0]
    assert np.allclose(one.smooth, want, atol=1e-6)
    s = {r.measure: r.value for r in S.spline_summary(df, "y", ["x"], at, kind).collect()}
    rss = float(((one.y - want) ** 2).sum())
    assert s["n"] == 400 and s["rmse"] == pytest.approx(np.sqrt(rss / 400)) and abs(s["mean_residual"]) < 1e-8
    assert s["r2"] == pytest.approx(1 - rss / ((one.y - one.y.mean()) ** 2).sum())


def test_command(sample, spark):
    _, df = sample
    s = Session(spark)
    s.use(df)
    assert [r.term for r in s.run("spline y x").collect()] == ["const", "x", "s1", "s2", "s3", "s4"]
    assert [r.term for r in s.run("spline y x --knots=2,5 --type=bs").collect()] == ["const", *(f"x_s{i}" for i in range(1, 6))]
    assert s.run("spline y x --type=loess --frac=0.5").columns == ["x", "smooth"]
    assert {r.measure for r in s.run("spline y x --type=loess --summary").collect()} >= {"n", "r2", "rmse"}
    s.run("spline y x z --knots=3 --gen=curve")
    assert s.df.columns == ["x", "z", "y", "curve"]
    with pytest.raises(ValueError, match="natural, bs or loess"):
        s.run("spline y x --type=cubic")
    with pytest.raises(ValueError, match="not known"):
        s.run("spline y x --knot=3")
