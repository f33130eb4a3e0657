"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled one and its
mean variance. A row's log ratio is the difference of the classes' log densities
(Mahalanobis distances by cached Cholesky factors) and log priors. The shrinkage is the
one with the least out-of-fold log loss. Log ratios of densities run to thousands, where
a logistic function is 0 or 1; so the score is a logistic function of their signed
logarithm, whose slope and intercept are fitted to out-of-fold rows: scores are
probabilities, and rows with different log ratios have different ones.

Cases: null and empty texts are scored from zero statistics; a class without two
labelled rows makes the score the other class's share, and with fewer than MOST_FOLDS
the shrinkage and the scores are not tuned; repeated rows score alike; texts of any
length are measured whole; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import map_arrow, small_batches, text_bytes
from tallyfold.llm.docstats import measure, ratios
from tallyfold.llm.quality_rules import SAMPLE, labelled_statistics

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: A document is predicted to be good from this score on.
LEAST_SCORE = 0.7
#: Folds, and the shrinkages (towards the pooled covariance, then towards its mean variance) that are tried.
MOST_FOLDS = 5
SHRINKAGES = tuple((a, b) for a in (0.05, 0.1, 0.3, 0.6) for b in (0.02, 0.1, 0.3))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def transform(m: np.ndarray) -> np.ndarray:
    """Ratios with a logarithm against their long right tails."""
    return np.log(0.01 + np.maximum(ratios(m), 0))


@dataclass(frozen=True)
class Discriminant:
    """centre, scale: of the features. Per class: mean, inverse Cholesky factor, and log prior minus half the log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    share: float

    #: Slope and intercept on the signed logarithm of the log ratio; None: the logistic function of the ratio itself.
    line: tuple[float, float] | None = None

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = [o - 0.5 * (((z - mean) @ f.T) ** 2).sum(axis=1) for mean, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.share)
        ratio = self.log_ratio(x)
        at = np.clip(ratio, -50, 50) if self.line is None else self.line[0] * signed_log(ratio) + self.line[1]
        return 1 / (1 + np.exp(-at))


def signed_log(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.log1p(np.abs(x))


def logistic_line(s: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of y on s by Newton's steps; targets lie a row's weight inside 0 and 1, so that separated classes have a slope."""
    ones = max(float(y.sum()), 1.0)
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    a = np.column_stack((s, np.ones(len(s))))
    b = np.array([1.0, 0.0])
    loss = lambda v: float(np.logaddexp(0, a @ v).sum() - target @ (a @ v))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-9 * np.eye(2), a.T @ (target - p))
        size = 1.0
        while loss(b + size * step) > loss(b) and size > 1e-6:
            size /= 2
        b = b + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(b[0]), 1e-6), float(b[1])


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = 0.1, to_identity: float = 0.02) -> Discriminant:
    """`to_pooled`, `to_identity`: how far class covariances shrink to the pooled one, and then to its mean variance."""
    share = float(y.mean()) if len(y) else 0.5
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Discriminant(np.zeros(0), np.ones(0), np.zeros((0, 0)), np.zeros((0, 0, 0)), np.zeros(0), share)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z, d = (x - centre) / scale, x.shape[1]
    parts = [z[y == k] for k in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, covs, strict=True)) / len(z)
    factors, offsets = [], []
    for p, c in zip(parts, covs, strict=True):
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * np.trace(c) / d * np.eye(d)
        lower = np.linalg.cholesky(c + 1e-9 * np.eye(d))
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(len(p) / len(z)) - np.log(np.diag(lower)).sum())
    return Discriminant(centre, scale, np.array([p.mean(axis=0) for p in parts]), np.array(factors), np.array(offsets), share)


def tuned(x: np.ndarray, y: np.ndarray, folds: int = MOST_FOLDS) -> Discriminant:
    """`fit` with the shrinkage of the least out-of-fold log loss, and scores fitted to the out-of-fold log ratios."""
    if min((y == 0).sum(), (y == 1).sum()) < 2 * folds:
        return fit(x, y)
    fold = np.empty(len(y), np.int64)
    for k in (0, 1):  # rows come in the order of a hash; each class is dealt in turn
        fold[y == k] = np.arange((y == k).sum()) % folds
    best = None
    for shrinkage in SHRINKAGES:
        ratio = np.empty(len(y))
        for f in range(folds):
            ratio[fold == f] = fit(x[fold != f], y[fold != f], *shrinkage).log_ratio(x[fold == f])
        line = logistic_line(signed_log(ratio), y)
        at = line[0] * signed_log(ratio) + line[1]
        loss = float(np.mean(np.logaddexp(0, at) - y * at))
        if best is None or loss < best[0] - 1e-12:
            best = loss, shrinkage, line
    return replace(fit(x, y, *best[1]), line=best[2])


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant:
    """Learns `labels.quality` from at most `sample` labelled rows, none of them held out."""
    m, y = labelled_statistics(docs, labels.where(~held_out()), "quality", sample)
    return tuned(transform(m), y)


def quality_scores(docs: DataFrame, model: Discriminant, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    small_batches(docs.sparkSession)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        score = model.score(transform(measure(text_bytes(batch.column("text")))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= least).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), each, SCHEMA)
