"""Resampling against exact errors; ranges of the global order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfold.operators.ordered import BUCKET, bucketed, quantiles, running_all
from tallyfold.stats import tests as H


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(4)
    pdf = pd.DataFrame({"v": np.round(r.normal(10, 2, 900), 1), "g": np.where(np.arange(900) < 400, "a", "b")})
    return pdf, spark.createDataFrame(pdf)


def test_bootstrap(sample):
    pdf, df = sample
    got = H.bootstrap(df, "v", "mean", 400).first()
    assert got.estimate == pytest.approx(pdf.v.mean()) and got.se == pytest.approx(pdf.v.std() / 30, rel=0.15)
    median = H.bootstrap(df, "v", "median", 300).first()
    assert median.estimate == pytest.approx(pdf.v.median()) and median.se == pytest.approx(1.2533 * pdf.v.std() / 30, rel=0.3)
    assert median.low <= pdf.v.median() <= median.high
    again = H.bootstrap(df.repartition(7), "v", "mean", 400).first()
    assert again.se == pytest.approx(got.se)  # draws do not depend on partitions


def test_permutation(sample):
    pdf, df = sample
    a, b = pdf.v[pdf.g == "a"], pdf.v[pdf.g == "b"]
    z = abs(a.mean() - b.mean()) / math.sqrt(pdf.v.var() * (1 / len(a) + 1 / len(b)))
    got = H.permutation(df, "v", "g", 500).first()
    assert got.p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=0.08)
    assert H.permutation(df.withColumn("v", F.col("v") + F.when(F.col("g") == "a", 2).otherwise(0)), "v", "g", 200).first().p < 0.01


def test_ranges_split_texts_and_equal_leading_keys(spark):
    df = spark.range(20_000).select(F.lit(1).alias("a"), F.format_string("row%08d", (F.col("id") * 7919) % 20_000).alias("t"), F.col("id").cast("double").alias("x"))
    sizes = bucketed(df, ["a", "t"]).groupBy(BUCKET).count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 10_000
    run = running_all(df, ["a", "t"], {"s": ("x", "sum"), "m": ("x", "max"), "c": ("x", "count"), "l": ("x", "last")}).toPandas().sort_values("t")
    assert np.allclose(run.s, run.x.cumsum()) and np.allclose(run.m, run.x.cummax()) and (run.c == np.arange(1, 20_001)).all() and (run.l == run.x).all()


def test_quantiles_of_several_columns(spark):
    pdf = pd.DataFrame({"a": [3.0, 1.0, None, 2.0, 2.0], "b": [1.0, None, None, 5.0, 9.0]})
    got = {(r.variable, r.q): r.value for r in quantiles(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double"), ["a", "b"], [0.0, 0.5, 1.0], "linear").collect()}
    assert got == {("a", 0.0): 1.0, ("a", 0.5): 2.0, ("a", 1.0): 3.0, ("b", 0.0): 1.0, ("b", 0.5): 5.0, ("b", 1.0): 9.0}
