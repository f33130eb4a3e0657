"""Support vector machines with kernels, by explicit features of the kernel and a distributed linear solver.

The Gaussian kernel exp(-gamma |x - z|^2) is the mean of cos(w (x - z)) over normal w:
random Fourier features sqrt(2 / D) cos(w x + b) have it as their inner product, up to
an error of about 1 / sqrt(D). The polynomial kernel (gamma x z + 1)^degree is the exact
inner product of scaled monomials. Features are made from Arrow batches by weights that
a seed fixes, so that they do not depend on how rows are dealt. The solver sees n rows
of D features and no pair of rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col
from tallyfold.stats.frames import complete, frame
from tallyfold.storage import discard, written

KERNELS = ("linear", "rbf", "poly")
#: Random features of the Gaussian kernel; monomials of the polynomial kernel, at most.
FEATURES, MOST_MONOMIALS = 256, 2_000


def fourier_features(x: np.ndarray, gamma: float, size: int = FEATURES, seed: int = 42) -> np.ndarray:
    """Features whose inner product is the Gaussian kernel, up to the error of `size` draws."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * gamma), (x.shape[1], size)), rng.uniform(0, 2 * math.pi, size)
    return math.sqrt(2 / size) * np.cos(x @ w + b)


def monomial_features(x: np.ndarray, gamma: float, degree: int = 3) -> np.ndarray:
    """Features whose inner product is (gamma x z + 1)^degree, without the constant one."""
    out = []
    for d in range(1, degree + 1):
        for which in itertools.combinations_with_replacement(range(x.shape[1]), d):
            ways = math.factorial(degree) // math.factorial(degree - d)
            for i in set(which):
                ways //= math.factorial(which.count(i))
            out.append(math.sqrt(ways * gamma**d) * x[:, which].prod(axis=1))
    return np.column_stack(out)


@dataclass
class Machine:
    """A fitted machine: the linear model on the kernel's features, and what made them."""

    model: object
    columns: list[str]
    kernel: str
    gamma: float
    degree: int
    size: int
    seed: int
    centre: list[float]
    levels: list

    def features(self) -> Column:
        xs = [col(c).cast("double") - F.lit(m) for c, m in zip(self.columns, self.centre, strict=True)]
        if self.kernel == "linear":
            return array_to_vector(F.array(*xs))
        rbf, gamma, degree, size, seed = self.kernel == "rbf", self.gamma, self.degree, self.size, self.seed

        @F.pandas_udf("array<double>")
        def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for part in parts:
                x = part.to_numpy(np.float64)
                yield pd.Series(list(fourier_features(x, gamma, size, seed) if rbf else monomial_features(x, gamma, degree)))

        return array_to_vector(made(F.struct(*(x.alias(f"x{i}") for i, x in enumerate(xs)))))

    def predict(self, df: DataFrame, new: str = "prediction") -> DataFrame:
        """df's complete rows with the predicted level or value."""
        rows = complete(df, {c: col(c) for c in self.columns}).withColumn("__f", self.features())
        made = self.model.setFeaturesCol("__f").setPredictionCol("__p").transform(rows)
        value = F.element_at(F.lit(self.levels), F.col("__p").cast("int") + 1) if self.levels else F.col("__p")
        return made.withColumn(new, value).select(*df.columns, new)


#: Copies of a row among those that `_counted` makes.
COPIES = "__copies"


def _counted(df: DataFrame, y: str, columns: Sequence[str]) -> DataFrame:
    """The different complete rows of y and columns, with the number of their copies: all that a fit and its score depend on."""
    rows = complete(df, {x: col(x) for x in columns}).where(col(y).isNotNull())
    return rows.groupBy(*(col(x).alias(x) for x in dict.fromkeys((y, *columns)))).agg(F.count("*").alias(COPIES))


def fit_machine(df: DataFrame, y: str, columns: Sequence[str], kernel: str = "rbf", c: float = 1.0, gamma: str | float = "scale", task: str = "classification", degree: int = 3, size: int = FEATURES, seed: int = 42) -> Machine:
    """Hinge loss (two classes) or Huber's loss (task regression) plus half the squared weights over n c, on the kernel's features.

    gamma is a number, `auto` for 1 / columns, or `scale` for 1 / (columns x their variance, taken over all values together).
    Copies of a row are one row with a weight. The solver keeps its blocks of features; they are kept nowhere else.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.regression import LinearRegression

    if kernel not in KERNELS:
        raise ValueError(f"there are the kernels {', '.join(KERNELS)}")
    if kernel == "poly" and math.comb(len(columns) + degree, degree) > MOST_MONOMIALS:
        raise ValueError(f"the kernel has more than {MOST_MONOMIALS} monomials")
    complete_rows = complete(df, {x: col(x) for x in columns}).where(col(y).isNotNull())
    stats = complete_rows.agg(F.count("*"), *(f(col(x).cast("double")) for x in columns for f in (F.avg, F.var_pop))).first()
    n, means, spread = stats[0], list(stats[1::2]), list(stats[2::2])
    if not n:
        raise ValueError("no complete rows")
    if gamma in ("scale", "auto"):
        k = len(columns)
        variance = np.mean(spread) + np.var(means)
        gamma = 1 / k if gamma == "auto" else 1 / (k * max(float(variance), 1e-300))
    levels: list = []
    label = col(y).cast("double")
    if task == "classification":
        levels = sorted(r[0] for r in complete_rows.select(col(y)).distinct().limit(3).collect())
        if len(levels) != 2:
            raise ValueError("two classes are told apart")
        label = (col(y) == F.lit(levels[1])).cast("double")
    machine = Machine(None, list(columns), kernel, float(gamma), degree, size, seed, means, levels)
    rows = written(_counted(df, y, columns))
    data = rows.select(label.alias("label"), F.col(COPIES).cast("double").alias("weight"), machine.features().alias("features"))
    weight = 1 / (n * max(c, 1e-12))
    solver = LinearSVC(regParam=weight, maxIter=100, tol=1e-6, standardization=False, weightCol="weight") if levels else LinearRegression(loss="huber", regParam=weight, maxIter=200, standardization=False, weightCol="weight")
    machine.model = solver.fit(data)
    discard(rows)
    return machine


def svm(df: DataFrame, y: str, columns: Sequence[str], kernel: str = "rbf", task: str = "classification", **options) -> DataFrame:
    """measure and value: rows, features, gamma, and accuracy (or r2) on the rows that were fitted."""
    machine = fit_machine(df, y, columns, kernel, task=task, **options)
    done, w = machine.predict(_counted(df, y, columns), "__hat"), F.col(COPIES)
    if machine.levels:
        n, hits = done.agg(F.sum(w), F.sum(F.when(col(y) == F.col("__hat"), w).otherwise(0))).first()
        score = hits / n
        name = "accuracy"
    else:
        n, mean = done.agg(F.sum(w), F.sum(w * col(y)) / F.sum(w)).first()
        rss, tss = done.agg(F.sum(w * (col(y) - F.col("__hat")) ** 2), F.sum(w * (col(y) - F.lit(mean)) ** 2)).first()
        score, name = 1 - rss / tss, "r2"
    size = {"linear": len(columns), "rbf": machine.size, "poly": math.comb(len(columns) + machine.degree, machine.degree) - 1}[kernel]
    rows = [{"measure": "n", "value": n}, {"measure": "features", "value": size}, {"measure": "gamma", "value": machine.gamma}, {"measure": name, "value": score}]
    return frame(df.sparkSession, [{k: float(v) if k == "value" else v for k, v in r.items()} for r in rows], "measure string, value double")
