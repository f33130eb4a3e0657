"""Machine learning on MLlib: trees, forests, boosting, linear support vectors, search, validation, rules."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col
from tallyfold.stats.frames import CONST, complete, cross_products, frame
from tallyfold.stats.regression import Y, _inverse


def features(df: DataFrame, y: str, columns: Sequence[str], task: str = "regression") -> DataFrame:
    """label and features of complete rows; a class label is numbered in its order."""
    rows = complete(df, {c: col(c) for c in columns}).where(col(y).isNotNull())
    if task == "classification":
        from tallyfold.operators.transform import encode

        rows = encode(rows, y, "label").withColumn("label", F.col("label").cast("double"))
    else:
        rows = rows.withColumn("label", col(y).cast("double"))
    rows = rows.select("label", *(col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)))
    return VectorAssembler(inputCols=[f"__v{i}" for i in range(len(columns))], outputCol="features").transform(rows)


def _estimator(kind: str, task: str, **k):
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    seed = k.pop("seed", 42)
    depth = min(k.pop("depth", None) or (5 if kind == "cart" else 3 if kind == "gbm" else 10), 30)
    reg = task == "regression"
    if kind == "cart":
        return (R.DecisionTreeRegressor if reg else C.DecisionTreeClassifier)(maxDepth=depth, minInstancesPerNode=k.get("least", 5), seed=seed)
    if kind == "rf":
        return (R.RandomForestRegressor if reg else C.RandomForestClassifier)(numTrees=k.get("n", 100), maxDepth=depth, seed=seed)
    if kind == "gbm":
        return (R.GBTRegressor if reg else C.GBTClassifier)(maxIter=k.get("n", 100), stepSize=k.get("rate", 0.1), maxDepth=depth, seed=seed)
    if kind == "svm":
        return C.LinearSVC(regParam=1 / max(k.get("c", 1.0), 1e-9) / 1000) if not reg else R.LinearRegression(loss="huber", regParam=1e-3)
    if kind == "logit":
        return C.LogisticRegression(regParam=k.get("reg", 1e-3))
    if kind in ("ridge", "lasso"):
        return R.LinearRegression(regParam=k.get("alpha", 0.1), elasticNetParam=float(kind == "lasso"))
    raise ValueError(f"no model {kind}")


def train(df: DataFrame, y: str, columns: Sequence[str], kind: str = "rf", task: str = "regression", **options) -> tuple[object, DataFrame]:
    """A fitted model, and (variable, importance) by importance; the fit measure is in the last row, `score` (R2 or accuracy)."""
    rows = features(df, y, columns, task).persist()
    model = _estimator(kind, task, **options).fit(rows)
    done = model.transform(rows)
    if task == "regression":
        score = 1 - done.agg(F.sum((F.col("label") - F.col("prediction")) ** 2)).first()[0] / (rows.agg(F.var_pop("label") * F.count("*")).first()[0] or 1.0)
    else:
        score = done.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    rows.unpersist()
    weights = model.featureImportances.toArray() if hasattr(model, "featureImportances") else np.abs(model.coefficients.toArray())
    ranked = sorted(zip(columns, weights.tolist(), strict=True), key=lambda p: (-p[1], p[0]))
    return model, frame(df.sparkSession, [*({"variable": c, "importance": w} for c, w in ranked), {"variable": "score", "importance": score}], "variable string, importance double")


def cross_validate(df: DataFrame, y: str, columns: Sequence[str], folds: int = 5, key: Sequence[str] = (), seed: int = 42, fold: str | None = None) -> DataFrame:
    """fold, n, r2 and rmse of least squares: one pass sums the products of every fold, and each is left out by subtraction.

    Rows are dealt by a hash of `key`, or by the whole number `fold` modulo `folds`.
    """
    cols = {CONST: F.lit(1.0), **{c: col(c).cast("double") for c in columns}, Y: col(y).cast("double")}
    rows = complete(df, {c: x for c, x in cols.items() if c != CONST})
    part = F.pmod(col(fold).cast("long") if fold else F.xxhash64(F.lit(seed), *(col(c) for c in key or df.columns)), F.lit(folds)).alias("__fold")
    names = list(cols)
    means = rows.agg(*(F.avg(x) for x in cols.values())).first()
    shift = {c: 0.0 if c == CONST else m for c, m in zip(names, means, strict=True)}
    got = {r["__fold"]: r for r in rows.groupBy(part).agg(F.count("*").alias("n"), *cross_products(cols, None, shift)).collect()}
    k = len(names)
    parts = {}
    for f, r in got.items():
        m = np.zeros((k, k))
        m[np.triu_indices(k)] = r[2:]
        parts[f] = (r["n"], m + np.triu(m, 1).T)
    total, out = sum(m for _, m in parts.values()), []
    for f, (n, m) in sorted(parts.items()):
        rest = total - m  # products of columns less their means: the constant takes the shift
        b = _inverse(rest[:-1, :-1]) @ rest[:-1, -1]
        rss = m[-1, -1] - 2 * b @ m[:-1, -1] + b @ m[:-1, :-1] @ b
        tss = m[-1, -1] - m[0, -1] ** 2 / n
        out.append({"fold": f, "n": n, "r2": 1 - rss / tss, "rmse": float(np.sqrt(max(rss, 0) / n))})
    return frame(df.sparkSession, out, "fold long, n long, r2 double, rmse double")


def hyperopt(df: DataFrame, y: str, columns: Sequence[str], kind: str = "rf", task: str = "regression", folds: int = 3, draws: int = 6, seed: int = 42) -> DataFrame:
    """setting and score of a random search with cross-validation, fitted in parallel; the best first."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator

    rng = np.random.default_rng(seed)
    est = _estimator(kind, task, n=20)
    space = {"maxDepth": [2, 3, 5, 8], "numTrees": [10, 20, 50], "maxIter": [10, 20, 40], "regParam": [1e-3, 1e-2, 0.1, 1.0]}
    own = [p for p in est.params if p.name in space and (kind != "svm" or p.name != "maxIter")]
    grid = [{p: space[p.name][rng.integers(len(space[p.name]))] for p in own} for _ in range(draws)]
    judge = RegressionEvaluator(metricName="r2") if task == "regression" else MulticlassClassificationEvaluator(metricName="accuracy")
    rows = features(df, y, columns, task).persist()
    got = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, parallelism=4, seed=seed).fit(rows)
    rows.unpersist()
    ranked = sorted(zip(got.avgMetrics, grid, strict=True), key=lambda p: -p[0])
    return frame(df.sparkSession, [{"rank": i + 1, "setting": ", ".join(f"{p.name}={v}" for p, v in g.items()), "score": s} for i, (s, g) in enumerate(ranked)], "rank long, setting string, score double")


def shap_linear(df: DataFrame, y: str, columns: Sequence[str]) -> DataFrame:
    """variable and the mean |b * (x - mean)|: exact attributions of a linear model."""
    from tallyfold.functions.dsl import Formula
    from tallyfold.stats.regression import ols

    fit = ols(df, Formula(y, tuple((c,) for c in columns)))
    rows = complete(df, {**{c: col(c) for c in columns}, "y": col(y)})
    means = rows.agg(*(F.avg(col(c)) for c in columns)).first()
    got = rows.agg(*(F.avg(F.abs(F.lit(float(b)) * (col(c) - F.lit(m)))) for c, b, m in zip(columns, fit.params[1:], means, strict=True))).first()
    ranked = sorted(zip(columns, got, strict=True), key=lambda p: -p[1])
    return frame(df.sparkSession, [{"variable": c, "shap": v} for c, v in ranked], "variable string, shap double")


def scored(model: object, rows: DataFrame, task: str) -> float:
    """R2 or accuracy of a model on rows of `features`."""
    done = model.transform(rows)
    if task == "classification":
        return done.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    rss, tss = done.agg(F.sum((F.col("label") - F.col("prediction")) ** 2), F.var_pop("label") * F.count("*")).first()
    return 1 - rss / tss if tss else float("nan")


#: Models of a learning curve: the estimator and its task (None: that of the outcome).
CURVES = {"logit": ("logit", "classification"), "rf": ("rf", None), "gb": ("gbm", "regression"), "cart": ("cart", None)}


def model_curve(df: DataFrame, y: str, columns: Sequence[str], kind: str = "rf", steps: int = 10, folds: int = 5, task: str | None = None, seed: int = 42, **options) -> DataFrame:
    """share, n, train, train_sd, cv and cv_sd: mean scores over the folds (R2, or accuracy) of models fitted on growing shares.

    Rows are dealt to folds, and ordered for the shares, by two hashes of their values: a
    larger share holds the smaller ones, equal rows stay together, and any partitioning
    gives the same curve. The score of a fold is taken on all its rows. A fold without
    rows, or whose training rows hold one class, is left out of the means.
    """
    if kind not in CURVES:
        raise ValueError(f"a learning curve takes {', '.join(CURVES)} or ols")
    kind, own = CURVES[kind]
    task = own or task or "regression"
    rows = complete(df, {c: col(c) for c in columns}).where(col(y).isNotNull())
    every = features(rows, y, columns, task)
    values = F.struct("label", F.col("features").cast("string"))
    place = lambda n: F.pmod(F.xxhash64(F.lit(n), values), F.lit(1_000_000))
    dealt = every.withColumn("__fold", F.pmod(F.xxhash64(F.lit(seed), values), F.lit(folds))).withColumn("__at", place(seed + 1) / 1_000_000).persist()
    out = []
    for s in np.linspace(0.1, 1.0, steps):
        got = []
        for f in range(folds):
            train_rows = dealt.where((F.col("__fold") != f) & (F.col("__at") < float(s)))
            test = dealt.where(F.col("__fold") == f)
            n, classes = train_rows.agg(F.count("*"), F.count_distinct("label")).first()
            if not n or not test.take(1) or (task == "classification" and classes < 2):
                continue
            model = _estimator(kind, task, seed=seed, **options).fit(train_rows)
            got.append((n, scored(model, train_rows, task), scored(model, test, task)))
        if got:
            a = np.array(got)
            out.append({"share": float(s), "n": int(a[:, 0].mean()), "train": a[:, 1].mean(), "train_sd": a[:, 1].std(), "cv": a[:, 2].mean(), "cv_sd": a[:, 2].std()})
    dealt.unpersist()
    return frame(df.sparkSession, out, "share double, n long, train double, train_sd double, cv double, cv_sd double")


def learning_curve(df: DataFrame, y: str, columns: Sequence[str], sizes: Sequence[float] = (0.1, 0.3, 0.5, 1.0), key: Sequence[str] = (), folds: int = 5) -> DataFrame:
    """share, n, train and cross-validated R2 of least squares on hashed shares of the rows."""
    from tallyfold.functions.dsl import Formula
    from tallyfold.stats.regression import ols

    out = []
    u = F.pmod(F.xxhash64(F.lit(7), *(col(c) for c in key or df.columns)), F.lit(10_000)) / 10_000
    for s in sizes:
        part = df.where(u < s)
        fit = ols(part, Formula(y, tuple((c,) for c in columns)))
        cv = cross_validate(part, y, columns, folds, key=key).agg(F.avg("r2")).first()[0]
        out.append({"share": s, "n": fit.n, "train_r2": fit.stats["r2"], "cv_r2": cv})
    return frame(df.sparkSession, out)


def association_rules(df: DataFrame, item: str, key: str, min_support: float = 0.05, min_confidence: float = 0.5) -> DataFrame:
    """antecedent, consequent (texts), support, confidence and lift."""
    from pyspark.ml.fpm import FPGrowth

    baskets = df.where(col(item).isNotNull()).groupBy(col(key)).agg(F.collect_set(col(item).cast("string")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return model.associationRules.select(text("antecedent").alias("antecedent"), text("consequent").alias("consequent"), "support", "confidence", "lift")


def item_support(df: DataFrame, item: str, key: str) -> DataFrame:
    """items, support of all single items and pairs of a basket; pairs are made inside a basket's distinct items."""
    rows = df.where(col(item).isNotNull()).select(col(key).alias("k"), col(item).cast("string").alias("i")).distinct()
    total = rows.select("k").distinct().agg(F.count("*").alias("__n"))
    single = rows.groupBy(F.col("i").alias("items")).count()
    baskets = rows.groupBy("k").agg(F.array_sort(F.collect_set("i")).alias("x"))
    pairs = baskets.select(F.explode(F.flatten(F.transform("x", lambda a, n: F.transform(F.slice(F.col("x"), n + 2, F.size("x")), lambda b: F.concat_ws(",", a, b))))).alias("items")).groupBy("items").count()
    return single.unionByName(pairs).crossJoin(F.broadcast(total)).select("items", (F.col("count") / F.col("__n")).alias("support"))
