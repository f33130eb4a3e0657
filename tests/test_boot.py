"""Bootstrap of models against sandwich errors and against direct fits with the same weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tallyfold.session import Session
from tallyfold.stats import boot
from tallyfold.stats import regression as R


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(11)
    x, z = r.normal(1000, 3, 1500), r.integers(0, 4, 1500).astype(float)
    e = r.normal(0, 1, 1500) * (1 + np.abs(x - 1000))
    p = 1 / (1 + np.exp(-(0.5 * (x - 1000) - 0.3 * z)))
    pdf = pd.DataFrame({"y": 2 + 0.5 * x - z + e, "x": x, "z": z, "won": (r.random(1500) < p).astype(float), "n": r.poisson(np.exp(0.2 * z)).astype(float)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize(("family", "spec"), [("ols", "y ~ x + z"), ("logit", "won ~ x + z"), ("poisson", "n ~ z"), ("probit", "won ~ x")])
def test_near_sandwich(sample, family, spec):
    _, df = sample
    robust = R.ols(df, spec, robust=True) if family == "ols" else R.glm(df, spec, family, robust=True)
    rows = boot.model_bootstrap(df, spec, family, 300).collect()
    assert [r.term for r in rows] == robust.names
    for r, b, s in zip(rows, robust.params, robust.se, strict=True):
        assert r.coef == pytest.approx(b, rel=1e-6, abs=1e-8) and r.se == pytest.approx(s, rel=0.2) and r.low < b < r.high
        assert (r.resamples, r.failed) == (300, 0) and abs(r.bias) < 0.4 * s


def test_equals_weighted_fits_and_any_partitioning(sample, spark):
    pdf, _ = sample
    pdf = pd.concat([pdf.head(200), pdf.head(60), pdf.head(60)])  # repeated rows share a count
    df = spark.createDataFrame(pdf)
    _, a = boot.resampled(df, "y ~ x + z", n=12)
    _, b = boot.resampled(df.repartition(9), "y ~ x + z", n=12)
    assert np.allclose(a, b, rtol=1e-7)
    _, c = boot.resampled(df, "won ~ x + z", "logit", n=12)
    from pyspark.sql import functions as F

    for y, got, family in (("y", a, "ols"), ("won", c, "logit")):
        rows = df.groupBy("x", "z", y).agg(F.count("*").alias("k")).withColumn("h", F.xxhash64("x", "z", y)).toPandas()
        for i in (0, 7):
            w = boot._counts_drawn(rows["k"].to_numpy(), boot._uniform(rows["h"].to_numpy().view(float), i, 42))
            drawn = spark.createDataFrame(rows.loc[rows.index.repeat(w.astype(int))])
            want = R.ols(drawn, "y ~ x + z") if family == "ols" else R.glm(drawn, "won ~ x + z", "logit")
            assert np.allclose(got[i], want.params, rtol=1e-5, atol=1e-6)


def test_collinear_resamples_fail_and_bounds(spark):
    few = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (4.0, 1.0), (3.0, None), (float("nan"), 1.0)], "y double, x double")
    r = boot.model_bootstrap(few, "y ~ x", n=200).first()
    assert r.failed > 0 and r.resamples + r.failed == 200
    with pytest.raises(ValueError, match="resamples"):
        boot.model_bootstrap(few, "y ~ x", n=1)


def test_command(sample, spark):
    _, df = sample
    s = Session(spark)
    s.use(df)
    with pytest.raises(ValueError, match="fit"):
        s.run("bootstrap n(50)")
    s.run("logit won ~ x + z")
    got = s.run("bootstrap n(60) ci(0.9)").collect()
    assert [r.term for r in got] == ["const", "x", "z"] and got[0].resamples == 60
    s.run("quantreg y ~ x")
    with pytest.raises(ValueError, match="ols, logit"):
        s.run("bootstrap n(50)")
