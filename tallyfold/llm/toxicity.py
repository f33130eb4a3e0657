"""Toxicity: a classifier chain of linear models over words and word beginnings.

The labels hold one category, so the chain derives two narrower ones from it and from
markers, which are terms that nearly only toxic documents hold: `marked` (toxic, with a
marker), `severe` (toxic, with SEVERE marker uses or more) and `toxic` (the label
itself), in this order. Each later model also reads the logits of the earlier
categories' probabilities: out-of-fold ones when it is fitted, the full models' when
documents are scored. An out-of-fold model sees nothing of its fold: its terms, its
markers and so its targets come from the other folds alone.

The sample is bounded, written once, and read twice: to count terms by fold, and to
count the chosen terms in each document.

Cases: null and empty texts have no terms and get the models' base probability;
repeated rows score alike; without labels, or with one class only, every probability
is the label's share; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import cut, labelled_sample, map_arrow, small_batches, text_bytes
from tallyfold.llm.quality_rules import SAMPLE

CATEGORIES = ("marked", "severe", "toxic")
SCHEMA = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", is_toxic boolean"
#: Terms that the models read, at most; marker uses from which a toxic document is severe.
TERMS, SEVERE = 256, 3
#: Share of a marker's documents that are toxic, at least.
PRECISION = 0.9
#: Characters of the word beginnings that are terms beside whole words.
BEGINNINGS = (5, 6, 8)
FOLDS = 5

_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """The word and its beginnings, which end in `*`."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def _words(raw: bytes) -> list[str]:
    return _WORD.findall(raw.decode("utf-8", "replace").lower())


def find_terms(texts: DataFrame, bound: int = TERMS) -> list[list[str]]:
    """For each fold the `bound` terms that lean most to toxic documents of the other folds, and last those of all; texts has text, y and fold."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for raw, y, fold in zip(text_bytes(batch.column("text")), batch.column("y").to_pylist(), batch.column("fold").to_pylist(), strict=True):
            seen.update((t, fold, y == 1) for t in {t for w in set(_words(raw)) for t in terms_of(w)})
        keys = sorted({k[:2] for k in seen})
        counts = ([seen[(*k, c)] for k in keys] for c in (False, True))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array(c, pa.int64()) for c in counts)], names=["term", "fold", "n0", "n1"])

    due_by = {r["fold"]: (r["n"], r["toxic"]) for r in texts.groupBy("fold").agg(F.count("*").alias("n"), F.sum((F.col("y") == 1).cast("long")).alias("toxic")).collect()}
    counted = map_arrow(texts.select("text", "y", "fold"), each, "term string, fold long, n0 long, n1 long")
    columns = [F.sum(F.when(F.col("fold") == k, F.col(n)).otherwise(0)).alias(f"{n}_{k}") for k in range(FOLDS) for n in ("n0", "n1")]
    counts = cut(counted.groupBy("term").agg(*columns).where(" + ".join(f"n1_{k}" for k in range(FOLDS)) + " >= 5"))
    found = []
    for left_out in (*range(FOLDS), None):
        kept = [k for k in range(FOLDS) if k != left_out]
        n, toxic = (sum(due_by.get(k, (0, 0))[i] for k in kept) for i in range(2))
        n0, n1 = (sum((F.col(f"{c}_{k}") for k in kept), F.lit(0)) for c in ("n0", "n1"))
        due = (n0 + n1) * (toxic / max(n, 1))
        lean = (n1 - due) / F.sqrt(due + 1)
        found.append([r["term"] for r in counts.where(n1 >= 5).select("term", lean.alias("lean")).where("lean > 2").orderBy(F.desc("lean"), "term").limit(bound).collect()])
    return found


class Reader:
    """Counts of `terms` in texts, at most 3 of each counted."""

    def __init__(self, terms: list[str], cached: int = 200_000) -> None:
        self.index, self.cache, self.cached = {t: i for i, t in enumerate(terms)}, {}, cached

    def _of(self, word: str) -> tuple[int, ...]:
        if len(self.cache) >= self.cached:
            self.cache.clear()
        found = self.cache[word] = tuple(i for t in terms_of(word) if (i := self.index.get(t)) is not None)
        return found

    def counts(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.index)), np.float64)
        for row, raw in zip(out, texts, strict=True):
            for word in _words(raw):
                found = self.cache.get(word)
                for i in self._of(word) if found is None else found:
                    row[i] += 1
        return np.minimum(out, 3)


@dataclass(frozen=True)
class Chain:
    terms: list[str]
    weights: list[np.ndarray] = field(default_factory=list)
    share: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category."""
        if not self.weights:
            return np.full((len(x), len(CATEGORIES)), self.share)
        found = np.zeros((len(x), 0))
        for w in self.weights:
            found = np.column_stack((found, _apply(w, np.column_stack((x, _logits(found))))))
        return found


def _logits(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -50, 50)))


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept comes first and is not shrunk."""
    a = np.column_stack((np.ones(len(x)), x))
    ridge = np.full(a.shape[1], l2)
    ridge[0] = 1e-6
    w = np.zeros(a.shape[1])
    mean = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
    w[0] = np.log(mean / (1 - mean))
    if not 0 < y.sum() < len(y):
        return w
    for _ in range(steps):
        p = _apply(w, x)
        d = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((a * d[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return w


def _targets(x: np.ndarray, y: np.ndarray, columns: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The categories of `rows`, by the markers that they themselves show among the term columns."""
    x, y = x[np.ix_(rows, columns)], y[rows]
    held = x > 0
    markers = held[y == 1].sum(axis=0) >= PRECISION * np.maximum(held.sum(axis=0), 1)
    uses = x[:, markers].sum(axis=1)
    return [((y == 1) & (uses >= least)).astype(float) for least in (1, SEVERE, 0)]


def fit_chain(terms: list[list[str]], x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
    """Models of the categories in order; terms: of each fold's models and last of all; x: counts of `every_term(terms)`; y: the label."""
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < y.sum() < len(y):
        return Chain(terms[-1], [], share)
    place = {t: i for i, t in enumerate(every_term(terms))}
    columns = [np.array([place[t] for t in ts], np.int64) for ts in terms]
    every = np.arange(len(y))
    parts = [(c, every[fold != k], every[fold == k]) for k, c in enumerate(columns[:-1])]
    full, by_fold = _targets(x, y, columns[-1], every), [_targets(x, y, c, rows) for c, rows, _ in parts]
    earlier, weights = np.zeros((len(y), 0)), []
    for j in range(len(CATEGORIES)):
        logits, out = _logits(earlier), np.full(len(y), share)
        weights.append(fit_linear(np.column_stack((x[:, columns[-1]], logits)), full[j]))
        for targets, (c, rows, rest) in zip(by_fold, parts, strict=True):
            if len(rows) and len(rest):
                w = fit_linear(np.column_stack((x[np.ix_(rows, c)], logits[rows])), targets[j])
                out[rest] = _apply(w, np.column_stack((x[np.ix_(rest, c)], logits[rest])))
        earlier = np.column_stack((earlier, out))
    return Chain(terms[-1], weights, share)


def every_term(terms: list[list[str]]) -> list[str]:
    return sorted({t for ts in terms for t in ts})


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Learns `labels.toxic` from at most `sample` labelled documents, whose ids are broadcast."""
    small_batches(docs.sparkSession)
    ids = labelled_sample(labels, "toxic", sample)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).alias("fold")
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y", fold))
    terms = find_terms(texts)
    reader = Reader(every_term(terms))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = reader.counts(text_bytes(batch.column("text"))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "y", "fold")), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "fold", "x"])

    # documents that share a labelled id add rows; the bound holds all the same
    rows = map_arrow(texts, each, "doc_id long, y int, fold long, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(sample).collect()
    x = np.array([np.frombuffer(r["x"], np.uint8) for r in rows], float).reshape(len(rows), len(reader.index))
    return fit_chain(terms, x, np.array([r["y"] == 1 for r in rows], float), np.array([r["fold"] for r in rows], np.int64))


def toxicity_scores(docs: DataFrame, chain: Chain, least: float = 0.5) -> DataFrame:
    """A probability for each category, and is_toxic: that of the last is `least` or more."""
    small_batches(docs.sparkSession)
    reader = Reader(chain.terms)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = chain.score(reader.counts(text_bytes(batch.column("text"))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(p[:, -1] >= least)], names=["doc_id", *(f"p_{c}" for c in CATEGORIES), "is_toxic"])

    return map_arrow(docs.select("doc_id", "text"), each, SCHEMA)
