"""Cases of the findings of round 3; each failed before its change."""

from __future__ import annotations

from fractions import Fraction

import pytest


def _rss(rows, y):
    """Exact squared residuals of y on the columns of `rows`, in fractions."""
    k = len(rows[0])
    a = [[sum(r[i] * r[j] for r in rows) for j in range(k)] + [sum(r[i] * v for r, v in zip(rows, y, strict=True))] for i in range(k)]
    c = [r[-1] for r in a]
    for i in range(k):
        for r in range(k):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [u - f * w for u, w in zip(a[r], a[i], strict=True)]
    return sum(v * v for v in y) - sum(a[i][k] / a[i][i] * c[i] for i in range(k)), [a[i][k] / a[i][i] for i in range(k)]


def test_endogtest_keeps_its_digits_with_weak_instruments(spark):
    from tallyfold.stats import regression as R

    data = [(3 * (i * 7919 % 4001) + i * 31 % 1009, 100_000 + i * 7919 % 4001, i * 104729 % 997) for i in range(2000)]
    y, q, z = ([Fraction(v) for v in c] for c in zip(*data, strict=True))
    _, (b0, b1) = _rss([(Fraction(1), t) for t in z], q)
    small, _ = _rss([(Fraction(1), t) for t in q], y)
    wide, _ = _rss([(Fraction(1), t, b0 + b1 * u) for t, u in zip(q, z, strict=True)], y)
    want = float((small - wide) / (wide / (len(data) - 3)))
    got = R.endogtest(spark.createDataFrame(data, "y long, q long, z long"), "y", [], ["q"], ["z"]).first()["statistic"]
    assert got == pytest.approx(want, rel=1e-6)


def test_svm_solver_sees_each_different_row_once(spark, monkeypatch):
    from pyspark.ml.classification import LinearSVC
    from tallyfold.stats import kernel as K

    seen, fit = [], LinearSVC.fit
    monkeypatch.setattr(LinearSVC, "fit", lambda self, data, *a: (seen.append(data.count()), fit(self, data, *a))[1])
    data = spark.range(4000).selectExpr("id % 10 / 10D as a", "id % 7 / 7D as b").selectExpr("a", "b", "int(a * a + b * b > 0.6) as y")
    got = {r["measure"]: r["value"] for r in K.svm(data, "y", ["a", "b"], "rbf", c=10.0, size=32).collect()}
    assert seen == [70]
    assert got["n"] == 4000 and got["accuracy"] > 0.9


def test_equal_features_are_fitted_and_explained_once(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor
    from tallyfold.stats import explain as E

    seen, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, data, *a: (seen.append(data.count()), fit(self, data, *a))[1])
    data = spark.range(3000).selectExpr("id", "double(id % 5) as a", "double(id % 3) as b", "id % 5 + 2 * (id % 3) + id % 2 as y").repartition(2)
    trees = E.fit_trees(data, "y", ["a", "b"], "gbm", n=5, depth=3)
    assert seen == [15]
    done = E.attribute(data, ["a", "b"], trees)
    assert "BroadcastHashJoin" in done._jdf.queryExecution().executedPlan().toString()
    rows = done.collect()
    assert len(rows) == 3000
    assert max(abs(sum(r["shap"]) + trees.base - r["prediction"]) for r in rows) < 1e-9


def test_ward_in_rounds_finds_the_clusters_of_the_whole_matrix(spark, monkeypatch):
    from tallyfold.stats import multivariate as M

    # no two distances are equal: ties leave several trees
    data = spark.range(400).selectExpr("pmod(xxhash64(id), 1000003) / 7D as a", "ln(1 + pmod(xxhash64(id, 1), 1009)) as b").union(spark.range(1).selectExpr("400000D as a", "9D as b"))
    for columns, ks in ((["a"], [5]), (["a", "b"], [4])):
        for k in ks:
            monkeypatch.setattr(M, "MOST_ROWS", 5000)
            want = [r["size"] for r in M.hierarchical(data, columns, k).collect()]
            monkeypatch.setattr(M, "MOST_ROWS", 100)
            monkeypatch.setattr(M, "WARD_BLOCK", 50)
            assert [r["size"] for r in M.hierarchical(data, columns, k).collect()] == want


def test_ward_takes_more_rows_than_one_matrix(spark):
    from tallyfold.stats import multivariate as M

    data = spark.range(6000).selectExpr("id % 1500 + 10000 * (id % 3) as a")
    assert [r["size"] for r in M.hierarchical(data, ["a"], 3).collect()] == [2000, 2000, 2000]


def test_louvain_steps_take_the_modularity_from_the_pass_over_gains(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tallyfold.stats import network as N

    rows = [(f"{g}{i}", f"{g}{j}", 1.0 + (i + j) % 3) for g in "abc" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0), ("b1", "c1", 1.0), ("a2", "a2", 2.0)]
    edges = N.build(spark.createDataFrame(rows, "s string, t string, w double"), "s", "t", "w")
    total = sum(r[2] for r in rows)
    labels = N._strengths(edges).select("node", F.substring("node", 1, 1).alias("community"), "k")
    asks, score, found = N._weighed(N._both(edges), labels, total, 2.0)
    assert score == pytest.approx(N.modularity(edges, labels).first()[0], rel=1e-12) and found == 0
    assert asks.count() == 15
    monkeypatch.setattr(N, "modularity", None)
    held = {}
    for r in N.louvain(edges).collect():
        held.setdefault(r["community"], set()).add(r["node"])
    assert sorted(held) == ["a0", "b0", "c0"] and all(len(v) == 5 for v in held.values())
