"""Evaluation of classifiers from counts of the distinct scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col, count_if
from tallyfold.operators.ordered import running_all
from tallyfold.operators.transform import need


def roc(df: DataFrame, outcome: str, score: str) -> DataFrame:
    """threshold, tpr and fpr at every distinct score, from the highest down."""
    need(df, outcome, score)
    y, s = col(outcome).cast("int"), col(score).cast("double")
    counts = df.where(y.isNotNull() & s.isNotNull()).groupBy((-s).alias("k")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    return _curve(counts).select((-F.col("k")).alias("threshold"), (F.col("cp") / F.col("tp")).alias("tpr"), (F.col("cn") / F.col("tn")).alias("fpr"))


def _curve(counts: DataFrame) -> DataFrame:
    """Counts of positives p and negatives n at each k with their running sums cp, cn and totals tp, tn."""
    total = counts.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    return running_all(counts, ["k"], {"cp": ("p", "sum"), "cn": ("n", "sum")}).crossJoin(F.broadcast(total))


def auc(df: DataFrame, outcome: str, score: str) -> DataFrame:
    """The area under the curve by trapezia, and Youden's threshold."""
    need(df, outcome, score)
    y, s = col(outcome).cast("int"), col(score).cast("double")
    counts = df.where(y.isNotNull() & s.isNotNull()).groupBy((-s).alias("k")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    area = F.col("n") / F.col("tn") * (F.col("cp") - F.col("p") / 2) / F.col("tp")  # a trapezium between two thresholds
    gain = F.struct((F.col("cp") / F.col("tp") - F.col("cn") / F.col("tn")).alias("g"), (-F.col("k")).alias("t"))
    return _curve(counts).agg(F.sum(area).alias("auc"), F.max_by(-F.col("k"), gain).alias("youden"))


def confusion(df: DataFrame, outcome: str, predicted: str, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn and measures; denominators are at least 1."""
    need(df, outcome, predicted)
    y, p = col(outcome).cast("double") > 0.5, col(predicted).cast("double") >= threshold
    c = df.where(col(outcome).isNotNull() & col(predicted).isNotNull()).agg(count_if(y & p).alias("tp"), count_if(~y & p).alias("fp"), count_if(y & ~p).alias("fn"), count_if(~y & ~p).alias("tn"))
    one = lambda x: F.greatest(x, F.lit(1))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    d = [x.cast("double") for x in (tp, fp, fn, tn)]
    mcc = (d[0] * d[3] - d[1] * d[2]) / F.sqrt(one((d[0] + d[1]) * (d[0] + d[2]) * (d[3] + d[1]) * (d[3] + d[2])))
    return c.select("*", ((tp + tn) / one(tp + fp + fn + tn)).alias("accuracy"), (tp / one(tp + fp)).alias("precision"), (tp / one(tp + fn)).alias("recall"), (tn / one(tn + fp)).alias("specificity"), (2 * tp / one(2 * tp + fp + fn)).alias("f1"), (tn / one(tn + fn)).alias("npv"), mcc.alias("mcc"))


def calibration(df: DataFrame, outcome: str, score: str, bins: int = 10) -> DataFrame:
    """bin, n, mean score and share of positives; scores are in [0, 1]."""
    need(df, outcome, score)
    s = col(score).cast("double")
    b = F.least(F.floor(s * bins), F.lit(bins - 1)).cast("int")
    return df.where(s.isNotNull() & col(outcome).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(s).alias("mean_score"), F.avg(col(outcome).cast("double")).alias("fraction_positive")).orderBy("bin")


def brier(df: DataFrame, outcome: str, score: str) -> DataFrame:
    return df.agg(F.avg((col(score).cast("double") - col(outcome).cast("double")) ** 2).alias("brier"))
