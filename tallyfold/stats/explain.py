"""Shapley values of tree models, path-dependent: additive attributions of each row's prediction.

A tree is read as arrays of its nodes: feature, threshold, children, value and cover
(the weight of the training rows there). With features S known, the tree's value at a
row follows the row at splits on S and weighs both sides by cover elsewhere. A feature's
Shapley value is the integral over t of the product of (t o + (1 - t) z) over the other
features on a leaf's path, times (o - z) and the leaf's value; o says whether the row
agrees with all splits on a feature, z is the share of cover that they keep. The product
is a polynomial in t, so that Gauss-Legendre points of half its degree are exact. A tree
is walked once for a whole Arrow batch of rows, and features that split twice on a path
take back what their upper split counted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col
from tallyfold.stats.frames import complete, frame
from tallyfold.storage import new_path, remove

#: Rows of a batch that a tree is walked for at once.
ROWS = 2_000
#: Different rows of features that are explained first and then joined; where there are about more, every row is explained.
FEW_ROWS = 50_000


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first; a leaf's children are -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def expectation(self, node: int = 0) -> float:
        """The value where no feature is known."""
        if self.left[node] < 0:
            return float(self.value[node])
        a, b = int(self.left[node]), int(self.right[node])
        return float((self.cover[a] * self.expectation(a) + self.cover[b] * self.expectation(b)) / self.cover[node])

    def most_features(self, node: int = 0, seen: frozenset = frozenset()) -> int:
        """Different features on one path, at most."""
        if self.left[node] < 0:
            return len(seen)
        wider = seen | {int(self.feature[node])}
        return max(self.most_features(int(self.left[node]), wider), self.most_features(int(self.right[node]), wider))


@dataclass(frozen=True)
class Ensemble:
    trees: tuple[Tree, ...]
    weights: tuple[float, ...]

    @property
    def base(self) -> float:
        return float(sum(w * t.expectation() for t, w in zip(self.trees, self.weights, strict=True)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree, weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            while (inner := tree.left[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                goes = x[rows, tree.feature[node]] <= tree.threshold[node]
                at[rows] = np.where(goes, tree.left[node], tree.right[node])
            out += weight * tree.value[at]
        return out

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """A row's values by feature; they add up to its prediction less `base`."""
        out = np.zeros(x.shape)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            out += weight * tree_attributions(tree, x)
        return out


def tree_attributions(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Shapley values of one tree: (rows, features)."""
    out = np.zeros(x.shape)
    points = max(1, (tree.most_features() + 1) // 2)
    at, weight = np.polynomial.legendre.leggauss(points)
    t, weight = (at + 1) / 2, weight / 2

    def walk(node: int, product: np.ndarray, known: dict[int, tuple[np.ndarray, float]]) -> np.ndarray:
        """The sum of value times product over the leaves below; adds their attributions to `out`."""
        if tree.left[node] < 0:
            return product * tree.value[node]
        j, total = int(tree.feature[node]), np.zeros_like(product)
        agrees = x[:, j] <= tree.threshold[node]
        for child, goes in ((int(tree.left[node]), agrees), (int(tree.right[node]), ~agrees)):
            if not tree.cover[child]:
                continue
            share = float(tree.cover[child] / tree.cover[node])
            upper = known.get(j)
            o, z = (goes, share) if upper is None else (goes & upper[0], share * upper[1])
            own = t * o[:, None] + (1 - t) * z
            above = None if upper is None else t * upper[0][:, None] + (1 - t) * upper[1]
            below = walk(child, product * own if above is None else product / above * own, known | {j: (o, z)})
            out[:, j] += (o - z) * (below / own @ weight)
            if above is not None:
                out[:, j] -= (upper[0] - upper[1]) * (below / above @ weight)
            total += below
        return total

    walk(0, np.ones((len(x), points)), {})
    return out


def ensemble(model) -> Ensemble:
    """The trees of a fitted regression tree, forest or boosting of MLlib, from its saved node table."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = new_path(spark)
    model.save(path)
    rows = spark.read.parquet(f"{path}/data")
    rows = rows.select("treeID", "nodeData.*") if "treeID" in rows.columns else rows.select(F.lit(0).alias("treeID"), "*")
    # nodes of a bounded number of trees of bounded depth, whatever the rows that were fitted
    nodes = rows.select("treeID", "id", "prediction", F.col("impurityStats")[0].alias("cover"), "leftChild", "rightChild", "split.featureIndex", F.col("split.leftCategoriesOrThreshold").alias("cuts"), "split.numCategories").toPandas()
    remove(path, spark)
    if ((nodes.leftChild >= 0) & (nodes.numCategories >= 0)).any():
        raise ValueError("splits on categories have no threshold")
    trees = []
    for _, n in nodes.sort_values(["treeID", "id"]).groupby("treeID"):
        cuts = np.array([c[0] if len(c) else np.nan for c in n.cuts])
        trees.append(Tree(*(np.asarray(v) for v in (n.featureIndex, cuts, n.leftChild, n.rightChild, n.prediction, n.cover))))
    weights = model.treeWeights if hasattr(model, "treeWeights") else [1.0]
    scale = 1.0 / len(trees) if "RandomForest" in type(model).__name__ else 1.0
    return Ensemble(tuple(trees), tuple(float(w) * scale for w in weights))


def attribute(df: DataFrame, columns: Sequence[str], trees: Ensemble) -> DataFrame:
    """df's complete rows with `shap`, an array of a value for each of `columns`, and `prediction`. Rows with equal features share their values."""
    rows = complete(df, {c: col(c) for c in columns})
    names = [f"v{i}" for i in range(len(columns))]
    keys = [(col(c).cast("double") + 0.0).alias(f"__{v}") for c, v in zip(columns, names, strict=True)]
    if rows.agg(F.approx_count_distinct(F.struct(*keys))).first()[0] <= FEW_ROWS:
        asked = rows.select(*keys).distinct().withColumn("__e", _explained(df, [F.col(f"__{v}").alias(v) for v in names], trees))
        found = rows.withColumns({f"__k{v}": k for v, k in zip(names, keys, strict=True)}).join(F.broadcast(asked), [F.col(f"__k{v}") == F.col(f"__{v}") for v in names])
    else:
        found = rows.withColumn("__e", _explained(df, [col(c).cast("double").alias(v) for c, v in zip(columns, names, strict=True)], trees))
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), "__e.shap", "__e.prediction")


def _explained(df: DataFrame, inputs: Sequence[Column], trees: Ensemble) -> Column:
    """shap and prediction of the features in `inputs`."""
    held = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("shap array<double>, prediction double")
    def explain(features: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in features:
            x = part.to_numpy(np.float64)
            found = [held.value.attributions(x[i : i + ROWS]) for i in range(0, len(x), ROWS)]
            shap = np.concatenate(found) if found else np.zeros(x.shape)
            yield pd.DataFrame({"shap": list(shap), "prediction": held.value.predict(x)})

    return explain(F.struct(*inputs))


def fit_trees(df: DataFrame, y: str, columns: Sequence[str], kind: str = "rf", **options) -> Ensemble:
    """A forest (rf), boosting (gbm) or single tree (cart) of regression on complete rows.

    Boosting by squares sees rows with equal features as one: their mean with their number as its weight gives the same splits and values.
    """
    from tallyfold.stats.learning import _estimator, features

    rows, estimator = features(df, y, columns), _estimator(kind, "regression", **options)
    if kind == "gbm":
        rows = rows.groupBy("features").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
        estimator = estimator.setWeightCol("weight")
    rows = rows.persist()
    try:
        return ensemble(estimator.fit(rows))
    finally:
        rows.unpersist()


def shap_trees(df: DataFrame, y: str, columns: Sequence[str], kind: str = "rf", **options) -> DataFrame:
    """variable and mean |shap| over all complete rows, the greatest first; the last rows are `base` and `prediction`, the mean prediction."""
    trees = fit_trees(df, y, columns, kind, **options)
    done = attribute(df.where(col(y).isNotNull()), columns, trees)
    got = done.agg(*(F.avg(F.abs(F.col("shap")[i])) for i in range(len(columns))), F.avg("prediction")).first()
    ranked = sorted(zip(columns, got, strict=False), key=lambda p: (-(p[1] or 0.0), p[0]))
    return frame(df.sparkSession, [*({"variable": c, "shap": v} for c, v in ranked), {"variable": "base", "shap": trees.base}, {"variable": "prediction", "shap": got[-1]}], "variable string, shap double")
