"""Whitening of embeddings by blockwise QR, a bidiagonal qd solver and twisted vectors.

Each task reduces its centred rows to one triangle by QR, batch after batch; triangles
meet a few at a time, level by level, until one is left. It is as large as the vectors
are wide, whatever the number of rows. Its singular values and right singular vectors
(``bidiagonal``) are the square roots of n times the covariance's eigenvalues and its
eigenvectors; the covariance itself is never formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.llm.bidiagonal import EPS, bidiagonalise, right_vectors, squared_values
from perilake.llm.pivots import _matrix, whole_vectors
from perilake.llm.shared import cut, fresh_path

#: Triangles that meet in one task.
FAN_IN = 16
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """Mean and whitening directions of a fit list of ``n`` vectors, ``width`` wide."""

    n: int
    width: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.sums, self.n) @ self.directions / np.sqrt(self.values)


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """``x - sums / n`` in doubles, with the whole part of the mean taken off exactly first."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole).astype(float) - rest


def fit_list(rows: DataFrame, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """Each distinct whole-number vector once, as written rows, and the width of the longest."""
    x = whole_vectors(rows, vector_col, scale)
    path = fresh_path(rows.sparkSession, "vectors")
    # Copies of a vector collapse inside each task before they are shuffled.
    rows.select(x.alias("x")).filter("x IS NOT NULL").distinct().write.parquet(path)
    known = rows.sparkSession.read.parquet(path)
    return known, known.agg(F.max(F.size("x")).alias("n")).first().n or 0


def dimension_sums(known: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            n += len(x)
            # Halves of 32 bits, so that no sum of a batch leaves a long.
            total += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width + 1), pa.int32()), pa.array([str(v) for v in [*total, n]])], names=["at", "part"])

    parts = known.mapInArrow(add, "at int, part string").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    out = {r["at"]: int(r["s"]) for r in parts.collect()}  # one row for each dimension
    return out.get(width, 0), [out.get(i, 0) for i in range(width)]


def triangle(known: DataFrame, width: int, sums: list[int], n: int, fan_in: int = FAN_IN) -> np.ndarray:
    """The triangle of a QR factorisation of all centred rows."""
    def reduced(blocks: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, width))
        for block in blocks:
            r = np.linalg.qr(np.concatenate([r, block]), mode="r")
        return r

    def packed(key: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())],
                                          names=["key", "r"])

    def unpacked(column) -> Iterator[np.ndarray]:
        return (np.frombuffer(v.as_py(), "<f8").reshape(-1, width) for v in column)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reduced(centred(_matrix(b.column("x"), width), sums, n) for b in batches if b.num_rows)
        if len(r):
            yield packed(0, r)

    # Whole-numbered by task, so that groups of a few are known without counting.
    parts = cut(known.mapInArrow(local, "key long, r binary").select(F.shiftright(F.monotonically_increasing_id(), 33).alias("key"), "r"))
    left = parts.rdd.getNumPartitions()

    def joined(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([packed(table.column("key")[0].as_py(), reduced(unpacked(table.column("r"))))])

    while left > 1:
        left = -(-left // fan_in)
        parts = cut(parts.select(F.floor(F.col("key") / fan_in).alias("key"), "r").groupBy("key").applyInArrow(joined, "key long, r binary"))
    rows = parts.collect()  # one triangle
    out = np.zeros((width, width))
    if rows:
        r = np.frombuffer(rows[0]["r"], "<f8").reshape(-1, width)
        out[:len(r)] = r
    return out


def fit(rows: DataFrame, vector_col: str = "embedding", components: int = 4, scale: int = 256) -> tuple[Whitening, DataFrame]:
    """Whitening of the distinct vectors of ``rows``, and those vectors.

    Directions without spread are left out: there are as many as the vectors have
    independent directions, ``components`` at most.
    """
    known, width = fit_list(rows, vector_col, scale)
    n, sums = dimension_sums(known, width)
    if not n or not width:
        return Whitening(n, width, sums, np.zeros((width, 0)), np.zeros(0), 0.0), known
    r = triangle(known, width, sums, n)
    diagonal, above, v = bidiagonalise(r)
    values = squared_values(diagonal, above)
    count = min(components, int((values > values[0] * (EPS * max(n, width)) ** 2).sum()) if values[0] > 0 else 0)
    directions = v @ right_vectors(diagonal, above, count) if count else np.zeros((width, 0))
    return Whitening(n, width, sums, directions, values[:count] / n, float(values.sum() / n)), known


def identity_error(model: Whitening, known: DataFrame) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity.

    Covariances of batches are centred on their own means and merged.
    """
    k = len(model.values)
    if not k:
        return 0.0

    def merge(a, b):
        (n, mean, spread), (m, other, more) = a, b
        gap = other - mean
        return n + m, mean + gap * (m / (n + m)), spread + more + np.outer(gap, gap) * (n * m / (n + m))

    def part(w: np.ndarray):
        mean = w.mean(axis=0)
        return len(w), mean, (w - mean).T @ (w - mean)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            if batch.num_rows:
                new = part(model.apply(_matrix(batch.column("x"), model.width)))
                have = merge(have, new) if have else new
        if have:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[have[0]], have[1], have[2].ravel()]).tolist()])], names=["m"])

    have = None
    for row in known.mapInArrow(local, "m array<double>").toLocalIterator():  # k * k numbers of each task
        m = np.array(row["m"])
        new = m[0], m[1:k + 1], m[k + 1:].reshape(k, k)
        have = merge(have, new) if have else new
    return float(np.abs(have[2] / have[0] - np.eye(k)).max())


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)^2; null beyond a long."""
    most = max(int(np.abs(x.astype(float)).max(initial=0)) * model.n, max(map(abs, model.sums), default=0)) + 1
    if 4 * most * most * model.width < 1 << 62:
        gap = x * model.n - np.array(model.sums, np.int64)
        return (gap * gap).sum(axis=1).tolist()
    gap = x.astype(object) * model.n - np.array(model.sums, object)
    return [v if v <= LONG else None for v in (gap * gap).sum(axis=1).tolist()]


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4,
             scale: int = 256) -> DataFrame:
    """Whitened coordinates of every row: id, component, n, deviation, whitened, explained, identity_error.

    Entries are the floor of ``scale`` times the given ones. Rows whose vector is null,
    or holds a null or an entry that is not finite or that becomes 2^61 or more, are left out; an
    empty vector takes part, and a shorter vector counts as ended by zeros. A row
    without an id keeps its rows of the result, with a null id. Each distinct vector
    counts once in the fit, repeated rows are returned each time. There are fewer
    components where the vectors have fewer independent directions (none for one vector
    only); those of equal eigenvalues are any basis of their space. A deviation beyond a
    long is null. An empty table gives an empty result. Other columns are not read,
    whatever their names.
    """
    model, known = fit(rows, vector_col, components, scale)
    error = identity_error(model, known)
    k = len(model.values)
    # As large as the vectors are wide, times the components.
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch.column("x"), shared.value.width)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, shared.value.n)),
                 pa.array(np.repeat(np.array(_deviations(x, shared.value), object), k), pa.int64()),
                 pa.array(shared.value.apply(x).ravel()),
                 pa.array(np.tile(shared.value.values / shared.value.trace, m)), pa.array(np.full(m * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema[id_col].dataType.simpleString()
    x = whole_vectors(rows, vector_col, scale)
    out = rows.select(F.col(id_col).alias("id"), x.alias("x")).filter("x IS NOT NULL").mapInArrow(
        project, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
