"""Shapley values of trees, nearest donors, matching and imputation against enumeration and brute force."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import ordered
from tallyfold.operators.nearest import nearest
from tallyfold.session import Session
from tallyfold.stats import causal, explain, imputation


def _known(tree, x, features, node=0):
    if tree.left[node] < 0:
        return tree.value[node]
    a, b = int(tree.left[node]), int(tree.right[node])
    if tree.feature[node] in features:
        return _known(tree, x, features, a if x[tree.feature[node]] <= tree.threshold[node] else b)
    return (tree.cover[a] * _known(tree, x, features, a) + tree.cover[b] * _known(tree, x, features, b)) / tree.cover[node]


def _coalitions(tree, x):
    m = len(x)
    out = np.zeros(m)
    for j in range(m):
        rest = [k for k in range(m) if k != j]
        for size in range(m):
            weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
            for some in itertools.combinations(rest, size):
                out[j] += weight * (_known(tree, x, {*some, j}) - _known(tree, x, set(some)))
    return out


def _random_tree(rng, depth, features):
    nodes = []

    def add(left, cover):
        i = len(nodes)
        nodes.append([-1, np.nan, -1, -1, rng.normal(), float(cover)])
        if left and cover > 1:
            part = int(rng.integers(1, cover))
            nodes[i][:2] = int(rng.integers(features)), float(rng.normal())
            nodes[i][2] = add(left - 1, part)
            nodes[i][3] = add(left - 1, cover - part)
        return i

    add(depth, 300)
    return explain.Tree(*(np.array(x) for x in zip(*nodes, strict=True)))


def test_tree_attributions_equal_all_coalitions():
    rng = np.random.default_rng(0)
    for k in range(25):
        features = 1 + k % 5
        tree = _random_tree(rng, k % 7, features)  # features split again and again on one path
        x = rng.normal(size=(5, features))
        got = explain.tree_attributions(tree, x)
        assert np.allclose(got, [_coalitions(tree, row) for row in x], atol=1e-12)
        whole = explain.Ensemble((tree,), (1.0,))
        assert np.allclose(got.sum(axis=1) + whole.base, whole.predict(x), atol=1e-12)


def _numbers(spark, n=600):
    r = random.Random(3)
    rows = [(i, r.gauss(0, 1), r.gauss(0, 1), float(r.randint(0, 3))) for i in range(n)]
    rows = [(i, a, b, c, 2 * a + a * b - c + r.gauss(0, 0.1)) for i, a, b, c in rows]
    return spark.createDataFrame([*rows, (n, None, 1.0, 2.0, 3.0)], "id long, a double, b double, c double, y double")


@pytest.mark.parametrize("kind", ["cart", "rf", "gbm"])
def test_fitted_trees(spark, kind):
    df = _numbers(spark)
    trees = explain.fit_trees(df, "y", ["a", "b", "c"], kind, n=4, depth=3)
    rows = explain.attribute(df, ["a", "b", "c"], trees).orderBy("id").collect()
    assert len(rows) == 600  # the row without a is left out
    for x in rows[:20]:
        want = sum(w * _coalitions(t, [x.a, x.b, x.c]) for t, w in zip(trees.trees, trees.weights, strict=True))
        assert np.allclose(x.shap, want, atol=1e-9) and math.isclose(sum(x.shap) + trees.base, x.prediction, abs_tol=1e-9)
    wide = {r.variable: r.shap for r in explain.shap_trees(df.repartition(7, "b"), "y", ["a", "b", "c"], kind, n=4, depth=3).collect()}
    assert set(wide) == {"a", "b", "c", "base", "prediction"}
    if kind == "cart":
        from pyspark.ml.regression import DecisionTreeRegressor

        from tallyfold.stats.learning import features

        data = features(df, "y", ["a", "b", "c"])
        model = DecisionTreeRegressor(maxDepth=3, minInstancesPerNode=5, seed=42).fit(data)
        assert sorted(round(r.prediction, 9) for r in model.transform(data).collect()) == sorted(round(r.prediction, 9) for r in rows)


def test_shap_command(spark, tmp_path):
    _numbers(spark).write.parquet(f"{tmp_path}/t.parquet")
    s = Session(spark)
    s.run(f"load {tmp_path}/t.parquet")
    s.run("shap y a b c --model=gb --n=3 --depth=2")
    assert [r.variable for r in s.result.collect()][0] == "a"
    with pytest.raises(ValueError):
        s.run("shap y a b --model=other")


# nearest donors


@pytest.mark.parametrize("k", [1, 3, 50])
def test_nearest_against_brute_force(spark, k):
    r = random.Random(k)
    donors = [(r.choice(["g", "h"]), r.choice([0.0, 1.0, 1.0, r.uniform(-5, 5)]), i) for i in range(80)] + [("g", None, 900), ("only donors", 1.0, 901)]
    asks = [(r.choice(["g", "h", "none"]), r.choice([0.0, 1.0, r.uniform(-9, 9)]), i) for i in range(60)] + [("g", None, 70), (None, 1.0, 71)]
    got = nearest(spark.createDataFrame(asks, "by string, v double, ask long"), spark.createDataFrame(donors, "by string, v double, donor_id long"), "v", k, ["by"], ["donor_id"])
    found = sorted((x.ask, x.near, x.donor.donor_id, x.distance) for x in got.collect())
    want = []
    for g, v, i in asks:
        near = sorted((abs(w - v), w, d) for h, w, d in donors if h == g and w is not None) if v is not None else []
        want += [(i, n, d, gap) for n, (gap, _, d) in enumerate(near[:k], 1)]
    # of equal values only k lie in reach of a place; they are taken in the order of the ties
    assert [(a, n, gap) for a, n, _, gap in found] == [(a, n, gap) for a, n, _, gap in sorted(want)]
    assert len({(a, d) for a, _, d, _ in found}) == len(found)


def test_nearest_of_empty_tables(spark):
    some = spark.createDataFrame([(1.0, 1)], "v double, i long")
    assert nearest(some.limit(0), some, "v", 2).count() == 0 and nearest(some, some.limit(0), "v", 2).count() == 0


@pytest.mark.parametrize("nn, caliper", [(1, None), (3, None), (3, 0.002), (40, 0.5)])
def test_matching_against_brute_force(spark, nn, caliper):
    r = random.Random(nn)
    rows = [(float(r.random() < 0.4), r.choice([1.0, 2.0, r.gauss(1, 1)]), r.gauss(5, 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "t double, x double, y double")
    scores = causal.propensity(df, "t", ["x"]).collect()
    if caliper is None:
        caliper = 0.2 * float(np.std([s.pscore for s in scores]))
    groups = {}
    for s in scores:
        if not s.t:
            groups.setdefault(s.pscore, []).append(s.y)
    gaps = []
    for s in scores:
        if s.t:
            left, total, weight = nn, 0.0, 0.0
            for gap, p in sorted((abs(p - s.pscore), p) for p in groups):
                k = min(left, len(groups[p])) if gap <= caliper else 0
                total, weight, left = total + k * np.mean(groups[p]), weight + k, left - k
            if weight:
                gaps.append(s.y - total / weight)
    got = causal.psmatch(df, "y", "t", ["x"], caliper, nn).first()
    assert got.matched == len(gaps) and math.isclose(got.att, np.mean(gaps), abs_tol=1e-9) and math.isclose(got.se, np.std(gaps, ddof=1) / math.sqrt(len(gaps)), abs_tol=1e-9)


def test_matching_command(spark, tmp_path):
    r = random.Random(1)
    spark.createDataFrame([(i % 2, r.gauss(0, 1), r.gauss(0, 1)) for i in range(100)], "t long, x double, y double").write.parquet(f"{tmp_path}/t.parquet")
    s = Session(spark)
    s.run(f"load {tmp_path}/t.parquet")
    s.run("psmatch y ~ x, treatment(t) nn(3) caliper(0.1)")
    assert s.result.first().matched > 0
    s.run("psmatch y ~ x, treatment(t) caliper(0)")
    assert s.result.first().matched == 0
    with pytest.raises(ValueError, match="neighbours"):
        s.run("psmatch y ~ x, treatment(t) neighbours(3)")


# imputation


def _holes(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):
        x = r.gauss(0, 1)
        score, yes = float(min(5, max(1, round(3 + x + r.gauss(0, 0.3))))), float(x + r.gauss(0, 0.5) > 0)
        rows.append((i, x, None if i % 5 == 0 else score, None if i % 7 == 0 else yes, float("nan") if i % 11 == 0 else 2 * x + r.gauss(0, 0.2)))
    return spark.createDataFrame(rows, "id long, x double, score double, yes double, z double")


METHODS = {"x": "regress", "score": "pmm", "yes": "logit", "z": "regress"}


def test_imputation_fills_by_method(spark):
    out = imputation.impute(_holes(spark), METHODS, 3, 3, 4, seed=1)
    rows = out.collect()
    assert len(rows) == 1200 and out.columns == ["id", "x", "score", "yes", "z", "_mi"]
    assert all(v is not None and v == v for r in rows for v in (r.x, r.score, r.yes, r.z))
    assert {r.score for r in rows} == {1.0, 2.0, 3.0, 4.0, 5.0}  # a value that another row holds, always
    assert {r.yes for r in rows if r.id % 7 == 0} == {0.0, 1.0}
    gaps = [r.score - (3 + r.x) for r in rows if r.id % 5 == 0]
    assert abs(np.mean(gaps)) < 0.2 and np.std(gaps) < 0.8
    assert np.std([r.z - 2 * r.x for r in rows if r.id % 11 == 0]) < 0.4
    copies = {k: sorted((r.id, r.score) for r in rows if r._mi == k) for k in (1, 2, 3)}
    assert copies[1] != copies[2]  # drawn anew in every copy
    kept = {r.id: r for r in _holes(spark).collect()}
    assert all(r.score == kept[r.id].score for r in rows if r.id % 5)


def test_imputation_is_the_same_again(spark):
    once, again = (sorted(map(tuple, imputation.impute(_holes(spark), METHODS, 2, 2, seed=9).collect())) for _ in range(2))
    assert np.allclose(once, again, atol=1e-9)


def test_imputation_draws_parameters(spark):
    few = spark.createDataFrame([(float(i), 2.0 * i + (i % 3) if i < 12 else None) for i in range(16)], "x double, y double")
    out = imputation.impute(few, {"x": "regress", "y": "regress"}, 40, 1, seed=3).where("x = 15").select("y").collect()
    fixed = imputation.impute(few, {"x": "regress", "y": "regress"}, 2, 1, draw=False).where("x = 15").select("y").distinct().collect()
    assert len(fixed) == 1 and abs(np.mean([r.y for r in out]) - fixed[0].y) < 1.0
    assert np.std([r.y for r in out]) > 0.9  # more than the residuals' own 0.86: the line is drawn too


def test_imputation_edges(spark):
    whole = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5)], "a double, b double")
    assert imputation.impute(whole, {"a": "pmm", "b": "regress"}, 2, 2).count() == 4
    with pytest.raises(ValueError, match="no value"):
        imputation.impute(spark.createDataFrame([(None, 1.0)], "a double, b double"), {"a": "pmm", "b": "pmm"})
    with pytest.raises(ValueError, match="median"):
        imputation.impute(whole, {"a": "median"})


def test_imputation_command(spark, tmp_path):
    _holes(spark).write.parquet(f"{tmp_path}/t.parquet")
    s = Session(spark)
    s.run(f"load {tmp_path}/t.parquet")
    s.run("mi impute chained (pmm) score (logit) yes (regress) x z, add(2) knn(3) rounds(1)")
    assert {r.score for r in s.df.select("score").distinct().collect()} == {1.0, 2.0, 3.0, 4.0, 5.0}
    assert s.df.count() == 800
    s.run("mi estimate: ols z ~ x + yes")
    assert [r.term for r in s.result.collect()] == ["const", "x", "yes"]


# ranges of the global order


def test_ranges_hold_like_many_rows(spark):
    df = spark.range(2_000_000).selectExpr("id % 1000 as day", "id")
    sizes = [r["count"] for r in ordered.bucketed(df, ["day"]).groupBy(ordered.BUCKET).count().collect()]
    assert len(sizes) == 40 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert ordered.bucketed(df.where("id < 10"), ["day"]).select(F.max(ordered.BUCKET)).first()[0] == 0
