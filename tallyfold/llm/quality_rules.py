"""Quality rules: base rules on whole texts, then gradient-boosted trees on document statistics.

The trees are fitted on a bounded sample of labelled documents (`sample`, by a hash of
doc_id), flattened to numpy arrays and scored in Arrow batches. The score may only
fall with symbols, repeated lines, repeated words, `!` and `|` (monotonic constraints).

Cases: a null or empty text has 0 words and fails the base rules; repeated rows are
judged alike; without labels the trees are a constant that keeps; an empty table gives
an empty result; further columns are kept by `keep_good` and not read by the rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import boosting
from tallyfold.llm.common import labelled_sample, map_arrow, small_batches, text_bytes
from tallyfold.llm.docstats import COLUMNS, RATIOS, measure, ratios

#: Features with which a document's score may only fall.
FALLING = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "bang_ratio", "bar_ratio")
#: Labelled documents from which the trees learn, at most.
SAMPLE = 20_000
#: A document is kept from this score on.
LEAST_SCORE = 0.5

BASE = COLUMNS[:5]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double"


def base_failed(m: np.ndarray) -> np.ndarray:
    """Under 50 words, or over half of the words in repeated 3-word windows."""
    words, repeated = m[:, COLUMNS.index("n_words")], m[:, COLUMNS.index("n_repeat_words")]
    return (words < 50) | (100 * repeated > 50 * words)


def labelled_statistics(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of a bounded sample; the sample's ids are broadcast (at most `bound` rows)."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(labels, column, bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = measure(text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *(pa.array(m[:, i]) for i in range(len(COLUMNS)))], names=["doc_id", "y", *COLUMNS])

    found = map_arrow(rows.select("doc_id", "text", "y"), each, "doc_id long, y int, " + ", ".join(f"{c} long" for c in COLUMNS))
    # documents that share a labelled id add rows; the bound holds all the same
    pdf = found.orderBy(F.xxhash64("doc_id"), "doc_id", "y", *COLUMNS).limit(bound).toPandas()
    pdf = pdf.sort_values(["doc_id", "y", *COLUMNS]).reset_index(drop=True)
    return pdf[list(COLUMNS)].to_numpy(np.int64).reshape(-1, len(COLUMNS)), pdf["y"].to_numpy(float)


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> boosting.Forest:
    """Trees for `labels.quality`, learned from at most `sample` labelled documents."""
    m, y = labelled_statistics(docs, labels, "quality", sample)
    return boosting.fit(ratios(m), y, {RATIOS.index(c): -1 for c in FALLING})


def quality_rules(docs: DataFrame, forest: boosting.Forest, least: float = LEAST_SCORE) -> DataFrame:
    """Per document the base counts, base_failed, kept and the trees' score."""
    small_batches(docs.sparkSession)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = measure(text_bytes(batch.column("text")))
        failed, score = base_failed(m), forest.score(ratios(m))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *(pa.array(m[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)],
            names=["doc_id", *BASE, "base_failed", "kept", "score"],
        )

    return map_arrow(docs.select("doc_id", "text"), each, SCHEMA)


def keep_good(docs: DataFrame, forest: boosting.Forest, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs`, with all their columns, that the rules keep."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = measure(text_bytes(batch.column("text")))
                yield batch.filter(pa.array(~base_failed(m) & (forest.score(ratios(m)) >= least)))

    return docs.mapInArrow(run, docs.schema)
