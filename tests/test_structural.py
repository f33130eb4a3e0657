"""Structural equation models: derivatives, closed forms, agreement of the methods, and what raises."""

from __future__ import annotations

import numpy as np
import pytest

from tallyfold.session import Session
from tallyfold.stats import structural as SE

MODEL = "f =~ x1 + x2 + x3; g =~ x4 + x5 + x6; g ~ f + z; y ~ g + z; x1 ~~ x4"


def _data(n=3000, seed=1):
    r = np.random.default_rng(seed)
    z, f = r.normal(2, 1, n), r.normal(size=n)
    g = 0.7 * f + 0.4 * z + 0.6 * r.normal(size=n)
    e = r.normal(size=(n, 7)) * 0.5
    shared = r.normal(size=n) * 0.4
    return {"x1": f + e[:, 0] + shared, "x2": 0.8 * f + e[:, 1], "x3": 1.3 * f + e[:, 2], "x4": g + e[:, 3] + shared, "x5": 0.5 * g + e[:, 4], "x6": 1.1 * g + e[:, 5], "z": z, "y": 0.9 * g - 0.3 * z + e[:, 6]}


def _table(spark, data):
    names = list(data)
    return spark.createDataFrame([tuple(map(float, row)) for row in zip(*data.values(), strict=True)], ", ".join(f"{n} double" for n in names))


def test_derivatives_equal_differences():
    model, data = SE.parse(MODEL), _data(200)
    sample = np.cov(np.array([data[v] for v in model.observed]), bias=True)
    implied = SE.Implied(model, sample)
    at = implied.start(sample) + 0.1
    whole, b = implied.at(at)
    d = implied.derivatives(whole, b)
    for k in range(len(at)):
        step = np.zeros(len(at))
        step[k] = 1e-6
        p = len(sample)
        gap = (implied.at(at + step)[0] - implied.at(at - step)[0])[:p, :p] / 2e-6
        assert np.allclose(d[k], gap, atol=1e-6)


@pytest.mark.parametrize("method", ["ml", "gls", "wls", "uls"])
def test_all_methods_find_the_truth(spark, method):
    got = {(r.lhs, r.op, r.rhs): r for r in SE.sem(_table(spark, _data()), MODEL, method).collect()}
    truth = {("f", "=~", "x2"): 0.8, ("f", "=~", "x3"): 1.3, ("g", "=~", "x5"): 0.5, ("g", "=~", "x6"): 1.1, ("g", "~", "f"): 0.7, ("g", "~", "z"): 0.4, ("y", "~", "g"): 0.9, ("y", "~", "z"): -0.3, ("x1", "~~", "x4"): 0.16, ("f", "~~", "f"): 1.0, ("g", "~~", "g"): 0.36}
    for key, v in truth.items():
        assert abs(got[key].estimate - v) < 0.08
        if method != "uls":
            assert abs(got[key].estimate - v) < 4.5 * got[key].se and got[key].p < 0.01
    assert got["f", "=~", "x1"].estimate == 1.0 and got["f", "=~", "x1"].se is None
    assert got["df", "fit", ""].estimate == 36 - 1 - 18
    if method == "ml":
        assert got["cfi", "fit", ""].estimate > 0.99 and got["rmsea", "fit", ""].estimate < 0.03 and got["p", "fit", ""].estimate > 1e-3
    assert abs(got["y", "~", "g"].std) < 1 and 0 < got["f", "~~", "f"].std <= 1 + 1e-9


def test_bootstrap_agrees_with_the_errors():
    data, model = _data(1500, 3), SE.parse(MODEL)
    whole = np.array([data[v] for v in model.observed])
    fitted = SE.fit_covariance(model, np.cov(whole, bias=True), 1500)
    r = np.random.default_rng(0)
    draws = [SE.fit_covariance(model, np.cov(whole[:, r.integers(0, 1500, 1500)], bias=True), 1500).values for _ in range(150)]
    assert np.all(np.abs(np.std(draws, axis=0) / fitted.errors - 1) < 0.35)


def test_a_recursive_model_is_least_squares(spark):
    data = _data(400)
    got = {(r.lhs, r.rhs): r.estimate for r in SE.sem(_table(spark, data), "x4 ~ x1 + z\nx5 ~ x4 + x1").where("op = '~'").collect()}
    for y, xs in (("x4", ["x1", "z"]), ("x5", ["x4", "x1"])):
        a = np.column_stack([np.ones(400), *(data[x] for x in xs)])
        b = np.linalg.lstsq(a, data[y], rcond=None)[0]
        assert np.allclose([got[y, x] for x in xs], b[1:], atol=1e-8)


def test_fixed_parameters_and_factor_covariances(spark):
    df = _table(spark, _data())
    got = {(r.lhs, r.op, r.rhs): r.estimate for r in SE.sem(df, "f =~ 1*x1 + 0.8*x2 + x3; g =~ x4 + x5 + x6").collect()}
    assert got["f", "=~", "x2"] == 0.8 and abs(got["f", "~~", "g"] - 0.7) < 0.1  # roots are correlated
    free = {(r.lhs, r.op, r.rhs): r.estimate for r in SE.sem(df, "f =~ x1 + x2 + x3; f ~~ 1*f").collect()}
    assert free["f", "~~", "f"] == 1.0


@pytest.mark.parametrize("text, words", [
    ("", "lines"), ("f = x1 + x2", "not a line"), ("f =~ x1 + + x2", "not a line"), ("y ~ x1; y ~ x1", "twice"), ("x1 ~~ x2; x2 ~~ x1", "twice"), ("y ~ y", "itself"),
    ("f =~ x1 + x2", "more parameters"), ("f =~ x1 + x2; g =~ x1 + x2; y ~ f", "more parameters|told apart"),
])
def test_models_that_cannot_be_fitted_raise(spark, text, words):
    with pytest.raises(ValueError, match=words):
        SE.sem(_table(spark, _data(50)), text)


def test_data_that_cannot_be_fitted_raise(spark):
    data = _data(50)
    with pytest.raises(ValueError, match="dependent"):
        SE.sem(_table(spark, {**data, "x2": 2 * data["x1"]}), "y ~ x1 + x2")
    with pytest.raises(ValueError, match="no complete rows"):
        SE.sem(_table(spark, data).limit(0), "y ~ x1")
    with pytest.raises(ValueError, match="methods"):
        SE.sem(_table(spark, data), "y ~ x1", "best")


def test_sem_command(spark, tmp_path):
    _table(spark, _data(300)).write.parquet(f"{tmp_path}/t.parquet")
    s = Session(spark)
    s.run(f"load {tmp_path}/t.parquet")
    s.run(r"sem 'f =~ x1 + x2 + x3 \n y ~ f + z' --method=gls")
    assert {("y", "~", "f"), ("y", "~", "z")} <= {(r.lhs, r.op, r.rhs) for r in s.result.collect()}
    with pytest.raises(ValueError, match="not a line"):
        s.run("sem y on x1; f =~ x1 + x2 + x3")
    with pytest.raises(ValueError, match="start"):
        s.run("sem y ~ x1 --start=2")
