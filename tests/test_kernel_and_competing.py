"""Kernel machines and subdistribution hazards against direct computation."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tallyfold.session import Session
from tallyfold.stats import kernel, survival


def _rings(spark, n=1200):
    r = np.random.default_rng(0)
    angle, inner = r.uniform(0, 2 * math.pi, n), r.random(n) < 0.5
    radius = np.where(inner, 1.0, 2.5) + r.normal(0, 0.15, n)
    rows = zip(range(n), (radius * np.cos(angle)).tolist(), (radius * np.sin(angle)).tolist(), np.where(inner, "in", "out").tolist(), strict=True)
    return spark.createDataFrame([*rows, (n, None, 1.0, "in"), (n + 1, 0.0, 1.0, None)], "id long, x double, y double, ring string")


def _measures(df):
    return {r.measure: r.value for r in df.collect()}


def test_kernels_tell_rings_apart_and_a_line_does_not(spark):
    df = _rings(spark)
    got = {k: _measures(kernel.svm(df, "ring", ["x", "y"], k)) for k in kernel.KERNELS}
    assert got["rbf"]["accuracy"] > 0.98 and got["poly"]["accuracy"] > 0.98 and got["linear"]["accuracy"] < 0.75
    assert got["rbf"]["n"] == 1200 and got["poly"]["features"] == 9


def test_features_have_the_kernel_as_product():
    r = np.random.default_rng(1)
    points = r.normal(size=(12, 3))
    f = kernel.fourier_features(points, 0.4, 20_000)
    assert np.allclose(f @ f.T, np.exp(-0.4 * ((points[:, None] - points) ** 2).sum(axis=2)), atol=0.04)
    f = kernel.monomial_features(points, 0.7, 3)
    assert np.allclose(f @ f.T + 1, (0.7 * points @ points.T + 1) ** 3, atol=1e-9)


def test_partitioning_does_not_matter(spark):
    df = _rings(spark).where("id < 600")
    one, many = (kernel.fit_machine(d, "ring", ["x", "y"], size=64) for d in (df.coalesce(1), df.repartition(13, "x")))
    assert np.allclose(one.model.coefficients.toArray(), many.model.coefficients.toArray(), atol=1e-3)
    got = one.predict(df)
    assert got.columns == [*df.columns, "prediction"] and got.count() == 600 and {r[0] for r in got.select("prediction").distinct().collect()} == {"in", "out"}


def test_kernel_regression(spark):
    r = np.random.default_rng(2)
    x = r.uniform(-3, 3, 800)
    df = spark.createDataFrame([(float(a), float(math.sin(2 * a) + e)) for a, e in zip(x, r.normal(0, 0.1, 800), strict=True)], "x double, y double")
    assert _measures(kernel.svm(df, "y", ["x"], "rbf", "regression", c=100.0, gamma=1.0))["r2"] > 0.9
    assert _measures(kernel.svm(df, "y", ["x"], "linear", "regression"))["r2"] < 0.5


def test_kernel_edges(spark, tmp_path):
    df = _rings(spark, 200)
    with pytest.raises(ValueError, match="kernels"):
        kernel.fit_machine(df, "ring", ["x"], "other")
    with pytest.raises(ValueError, match="two classes"):
        kernel.fit_machine(df.where("ring = 'in'"), "ring", ["x"])
    with pytest.raises(ValueError, match="no complete rows"):
        kernel.fit_machine(df.limit(0), "ring", ["x"])
    df.write.parquet(f"{tmp_path}/t.parquet")
    s = Session(spark)
    s.run(f"load {tmp_path}/t.parquet")
    s.run("svm ring x y kernel(rbf) C(5) gamma(0.5)")
    assert _measures(s.result)["gamma"] == 0.5 and _measures(s.result)["accuracy"] > 0.9
    with pytest.raises(ValueError, match="shape"):
        s.run("svm ring x y kernel(rbf) shape(2)")


# competing risks


def _risks(n=500, ties=False, others=True, seed=3):
    r = np.random.default_rng(seed)
    x, z = r.normal(size=n), (r.random(n) < 0.4).astype(float)
    t = r.exponential(1 / np.exp(0.6 * x - 0.5 * z))
    c = r.exponential(2.0, n)
    time, event = np.minimum(t, c), (t <= c).astype(int)
    cause = np.where(r.random(n) < (0.35 if others else 0.0), "b", "a")
    if ties:
        time = np.ceil(time * 6) / 6
    return [(float(a), int(b), str(k), float(u), float(v)) for a, b, k, u, v in zip(time, event, cause, x, z, strict=True)]


def _score(rows, beta):
    """Score, information and log likelihood of the weighted risk sets, made pair by pair."""
    t, e, k = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x = np.array([r[3:] for r in rows])

    def g(at):
        out = 1.0
        for s in np.unique(t[(e == 0) & (t < at)]):
            out *= 1 - ((t == s) & (e == 0)).sum() / (t >= s).sum()
        return out

    curve = {s: g(s) for s in np.unique(t)}
    own, other = (e == 1) & (k == "a"), (e == 1) & (k != "a")
    risk = np.exp(x @ beta)
    score, info, ll = np.zeros(2), np.zeros((2, 2)), 0.0
    for s in np.unique(t[own]):
        w = np.where(t >= s, 1.0, np.where(other, curve[s] / np.array([curve[v] for v in t]), 0.0)) * risk
        tied = own & (t == s)
        for step in range(tied.sum()):
            part = w - np.where(tied, risk * step / tied.sum(), 0.0)
            mean = part @ x / part.sum()
            info += (x * part[:, None]).T @ x / part.sum() - np.outer(mean, mean)
            score -= mean
            ll -= math.log(part.sum())
        score += x[tied].sum(axis=0)
        ll += (x[tied] @ beta).sum()
    return score, info, ll


@pytest.mark.parametrize("ties", [False, True])
def test_fine_gray_against_pairwise_risk_sets(spark, ties):
    rows = _risks(ties=ties)
    df = spark.createDataFrame([*rows, (None, 1, "a", 1.0, 0.0), (1.0, 1, "a", None, 0.0)], "t double, e int, cause string, x double, z double")
    fit = survival.fine_gray(df.repartition(5), "t", "e", "cause", "a", ["x", "z"])
    score, info, _ = _score(rows, fit.params)
    assert np.abs(score).max() < 1e-5 and np.allclose(fit.cov, np.linalg.inv(info), rtol=1e-6)
    assert fit.n == 500 and fit.params[0] > 0.1


def test_many_times_are_cut_into_ranges(spark):
    df = spark.createDataFrame(_risks(6000, seed=5), "t double, e int, cause string, x double, z double")
    rows = survival.bucketed(df, ["t"])
    assert rows.select(survival.BUCKET).distinct().count() > 1
    fit = survival.fine_gray(df, "t", "e", "cause", "a", ["x", "z"])
    sample = _risks(6000, seed=5)
    times = np.array([r[0] for r in sample])
    assert fit.n == 6000 and abs(fit.params[0] - 0.4) < 0.3 and len(np.unique(times)) == 6000


def test_without_competing_events_it_is_cox(spark):
    for ties in (False, True):
        df = spark.createDataFrame(_risks(ties=ties, others=False), "t double, e int, cause string, x double, z double")
        fit, cox = survival.fine_gray(df, "t", "e", "cause", "a", ["x", "z"]), survival.cox(df, "t", "e", ["x", "z"])
        assert np.allclose(fit.params, cox.params, atol=1e-7) and np.allclose(fit.cov, cox.cov, rtol=1e-5) and math.isclose(fit.stats["ll"], cox.stats["ll"], rel_tol=1e-9)


def test_competing_command(spark, tmp_path):
    spark.createDataFrame(_risks(200), "t double, e int, cause string, x double, z double").write.parquet(f"{tmp_path}/t.parquet")
    s = Session(spark)
    s.run(f"load {tmp_path}/t.parquet")
    s.run("competing t e cause x z")
    assert [(r.cause, r.term) for r in s.result.collect()] == [("a", "x"), ("a", "z"), ("b", "x"), ("b", "z")]
    s.run("competing t e cause")
    assert s.result.columns == ["cause", "time", "cif"]
    with pytest.raises(ValueError, match="no event"):
        survival.fine_gray(s.df, "t", "e", "cause", "none", ["x"])
