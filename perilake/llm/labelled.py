"""Bounded samples of labelled rows, held-out folds and calibration of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id lies in no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def training_labels(labels: DataFrame, id_col: str, label_col: str, folds: int, held: int, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids outside the held-out fold, by hash: row_id, label.

    Ids with several labels count with the lowest; null ids and labels are left out.
    The limit bounds what is broadcast, at 17 bytes a row.
    """
    return labels.filter(F.col(label_col).isNotNull() & (fold(id_col, folds) != held)) \
        .groupBy(F.col(id_col).cast("long").alias("row_id")).agg(F.min(label_col).cast("int").alias("label")) \
        .orderBy(F.xxhash64("row_id"), "row_id").limit(limit)


def calibrate(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into the probability of label 1 (Newton's method).

    Targets are smoothed by the class sizes, so that classes which don't overlap give
    finite values. With one class only, the smoothed share of label 1 is constant.
    """
    n1, n0 = labels.sum(), (1 - labels).sum()
    if not n1 or not n0:
        share = (n1 + 1) / (n1 + n0 + 2)
        return 0.0, float(np.log(share / (1 - share)))
    middle, spread = scores.mean(), scores.std() or 1.0
    x = np.stack([(scores - middle) / spread, np.ones(len(scores))], 1)
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - target * z).sum() + 1e-9 * w @ w

    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (p - target) + 2e-9 * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def probability(scores: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scores * slope + offset, -35, 35)))
