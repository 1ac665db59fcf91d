"""Quality scores by positive-unlabelled learning with the non-negative risk.

Trusted positives are documents labelled good; every document of the corpus, whatever
its label, is unlabelled text. With a share pi of good documents and a linear score g,

    risk = pi * mean_pos (g - 1)^2 + max(0, mean_all (g + 1)^2 - pi * mean_pos (g + 1)^2)

where the second part estimates the risk on bad documents and can't be negative. With
the squared loss, both parts depend on the data through two matrices of sums of
products of features only. They are gathered from all documents in one pass and summed
cell by cell, so that no task adds whole matrices, and the risk is minimised on the
driver, exactly: where the second part would fall below zero, its weight is lowered
until it is zero.

The prior pi is the share of label 1 in the labelled sample; the same sample sets a
slope and an offset that turn g into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.llm.batches import byte_rows, pieces
from perilake.llm.features import WIDTH, shape_features
from perilake.llm.labelled import calibrate, fold, probability, training_labels

#: Labelled rows that are used at most, and the ridge on standardised features.
SAMPLE, RIDGE = 20_000, 0.01
#: Cells of a symmetric matrix that are summed; all others mirror them.
UPPER = np.triu_indices(WIDTH)


@dataclass
class Linear:
    """A score of features, and the probability that it stands for."""

    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, texts: list[bytes]) -> np.ndarray:
        return shape_features(texts) @ self.weights

    def score(self, texts: list[bytes]) -> np.ndarray:
        return probability(self.raw(texts), self.slope, self.offset)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of features over a task's rows and its positives, one row per cell of the upper triangle."""
    sums = np.zeros((2, WIDTH, WIDTH))
    for whole in batches:
        for batch in pieces(whole, "body"):
            x = shape_features(byte_rows(batch.column("body")))
            good = np.array(batch.column("positive").to_pylist(), bool)
            sums += x.T @ x, x[good].T @ x[good]
    every, good = sums[0][UPPER], sums[1][UPPER]
    cell = np.flatnonzero((every != 0) | (good != 0))
    yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "every": every[cell], "good": good[cell]})


def product_sums(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices over a frame with body and positive; one row per cell reaches the driver."""
    cells = rows.mapInArrow(_products, "cell int, every double, good double") \
        .groupBy("cell").agg(F.sum("every").alias("every"), F.sum("good").alias("good")).collect()
    out = np.zeros((2, len(UPPER[0])))
    for r in cells:
        out[:, r.cell] = r.every, r.good
    full = np.zeros((2, WIDTH, WIDTH))
    full[:, UPPER[0], UPPER[1]] = full[:, UPPER[1], UPPER[0]] = out
    return full[0], full[1]


def minimise(every: np.ndarray, good: np.ndarray, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the smallest non-negative risk, from both matrices of sums."""
    n, n_good = every[-1, -1], good[-1, -1]
    centre = every[-1] / n
    spread = np.sqrt(np.maximum(np.diag(every) / n - centre ** 2, 0))
    used = spread > 1e-9
    centre[-1], spread[-1], used[-1] = 0, 1, True
    # Standardised features: (x - centre) / spread; the constant stays.
    change = np.eye(WIDTH) - np.outer(np.eye(WIDTH)[-1], np.where(used, centre, 0))
    change = (change / np.where(used, spread, 1)) * used
    a, p = change.T @ (every / n) @ change, change.T @ (good / n_good) @ change
    b, q = a[-1], p[-1]
    penalty = ridge * np.eye(WIDTH)
    penalty[~used, ~used] = 1

    def best(share):
        return np.linalg.solve((1 - share) * prior * p + share * a + penalty, (1 + share) * prior * q - share * b)

    def negative_part(w):
        return w @ a @ w + 2 * w @ b + 1 - prior * (w @ p @ w + 2 * w @ q + 1)

    low, high = 0.0, 1.0
    if negative_part(best(1.0)) >= 0:
        low = 1.0
    for _ in range(40 * (low < 1)):
        middle = (low + high) / 2
        low, high = (low, middle) if negative_part(best(middle)) < 0 else (middle, high)
    return change @ best(low)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Linear:
    """Fit on all documents and at most ``sample`` labelled ids outside the held-out fold.

    Null or empty texts count with their features like all others. Where rows share an
    id, its lowest raw score counts in the calibration. Without any
    document or positive label, every text gets the smoothed share of label 1.
    """
    known = F.broadcast(training_labels(labels, id_col, label_col, folds, held, sample))
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("body"))
    every, good = product_sums(rows.join(known, "row_id", "left").select(
        "body", F.coalesce(F.col("label") == 1, F.lit(False)).alias("positive")))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), sum(n for k, n in counts.items() if k != 1)
    model = Linear(np.zeros(WIDTH))
    if every[-1, -1] and good[-1, -1]:
        model = Linear(minimise(every, good, n1 / (n1 + n0)))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "body"):
                yield pa.RecordBatch.from_pydict({"row_id": batch.column("row_id"), "label": batch.column("label"),
                                                  "raw": model.raw(byte_rows(batch.column("body")))})

    # One row for each labelled id, however many rows share it.
    seen = rows.join(known, "row_id").select("row_id", "body", "label").mapInArrow(raw, "row_id long, label int, raw double") \
        .groupBy("row_id").agg(F.min("label").alias("label"), F.min("raw").alias("raw")).collect()
    model.slope, model.offset = calibrate(np.array([r.raw for r in seen]), np.array([r.label == 1 for r in seen], int))
    return model


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
          folds: int = 5, held: int = 0) -> DataFrame:
    """Per row: the id, held_out, score and predicted.

    Nulls count as empty texts, null ids as not held out. Repeated rows are scored each
    time; an empty table gives an empty result; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "body"):
                yield pa.RecordBatch.from_pydict({
                    "row_id": batch.column("row_id"), "held_out": batch.column("held_out"),
                    "score": model.score(byte_rows(batch.column("body")))})

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("body"),
                       F.coalesce(fold(id_col, folds) == held, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "row_id long, held_out boolean, score double").select(
        F.col("row_id").alias(id_col), "held_out", "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents with a score of ``threshold`` or more, all columns unchanged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text_col):
                yield batch.filter(pa.array(model.score(byte_rows(batch.column(text_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
