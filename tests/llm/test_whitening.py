import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilake.llm import bidiagonal, whitening
from perilake.llm.queries import QUERIES

from conftest import SMALL, values

SCHEMA = "vec_id long, embedding array<float>"


def numbers(vector, width):
    x = [math.floor(256 * float(np.float32(c))) for c in vector]
    return x + [0] * (width - len(x))


def brute(rows, k=4):
    """Fit by a full eigensolver: n, deviations, coordinates up to sign, explained."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    x = {j: numbers(v, width) for j, (_, v) in enumerate(good)}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    centre = np.array(fit, float) - mean
    cov = centre.T @ centre / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-9 * max(e[0], 1e-300)).sum()))
    coords = {j: (np.array(row, float) - mean) @ v[:, :k] / np.sqrt(e[:k]) for j, row in x.items()}
    dev = {j: sum((n * a - s) ** 2 for a, s in zip(row, sums)) for j, row in x.items()}
    return [i for i, _ in good], n, dev, coords, e[:k] / np.trace(cov)


def compare(df, rows, k=4):
    ids, n, dev, coords, share = brute(rows, k)
    got = values(df.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"))
    found = {}
    for i, c, m, d, w, s, err in got:
        assert m == n and err < 1e-9 and abs(s / share[c - 1] - 1) < 1e-9
        found.setdefault(c, []).append((i is None, i or 0, d, w))
    assert len(found) == len(share)
    for c, have in found.items():
        want = sorted((i is None, i or 0, dev[j], coords[j][c - 1]) for j, i in enumerate(ids))
        have = sorted(have)
        assert [h[:3] for h in have] == [w[:3] for w in want]
        a, b = np.array([h[3] for h in have]), np.array([w[3] for w in want])
        sign = 1 if a @ b > 0 else -1
        assert np.abs(a - sign * b).max() < 1e-7


def test_whole_table(spark):
    rows = values(spark.read.parquet(f"{SMALL}/embeddings.parquet"), "vec_id", "embedding")
    compare(QUERIES["op12_whitening"](spark, SMALL), rows)


def test_nulls_repeats_short_vectors_and_clashing_names(spark):
    draw = np.random.default_rng(1)
    rows = [(int(i), [float(c) for c in draw.standard_normal(6) * [9, 7, 5, 3, 2, 1]]) for i in range(60)]
    rows += [rows[0]] * 30 + [(500, rows[3][1]), (501, []), (502, [1.0, 2.0]), (None, [0.5] * 6)]
    rows += [(600, None), (601, [None] + [1.0] * 5), (602, [math.nan] * 6), (603, [math.inf] + [0.0] * 5), (604, [3e38] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for name in ("id", "x", "n", "component"):
        df = df.withColumn(name, F.lit("a"))
    compare(whitening.whitened(df), rows[:-1])


def test_few_directions_and_no_rows(spark):
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)]
    assert {r[0] for r in values(whitening.whitened(spark.createDataFrame(line, SCHEMA)), "component")} == {1}
    compare(whitening.whitened(spark.createDataFrame(line, SCHEMA)), line)
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert values(whitening.whitened(spark.createDataFrame(rows, SCHEMA))) == []


def test_triangles_meet_level_by_level(spark):
    draw = np.random.default_rng(2)
    x = (draw.standard_normal((500, 5)) * 1000).astype(int).tolist()
    known = spark.createDataFrame([(v,) for v in x], "x array<bigint>").repartition(37)
    n, sums = whitening.dimension_sums(known, 5)
    assert (n, sums) == (500, np.sum(x, axis=0).tolist())
    r = whitening.triangle(known, 5, sums, n, fan_in=3)
    want = np.array(x, float) - np.mean(x, axis=0)
    assert np.allclose(r.T @ r, want.T @ want, rtol=1e-12)


def test_sums_of_large_numbers_are_exact(spark):
    x = [[(1 << 60) + i, -(1 << 60) + 3 * i] for i in range(40)]
    known = spark.createDataFrame([(v,) for v in x], "x array<bigint>")
    assert whitening.dimension_sums(known, 2) == (40, [sum(c) for c in zip(*x)])


@pytest.mark.parametrize("kind", ["random", "graded", "multiple", "low rank", "zero", "identity"])
def test_small_solver(kind):
    draw = np.random.default_rng(5)
    turn = np.linalg.qr(draw.standard_normal((12, 12)))[0]
    a = {
        "random": draw.standard_normal((12, 12)),
        "graded": np.diag(10.0 ** -np.arange(12)) + np.diag(0.3 * 10.0 ** -np.arange(11), 1),
        "multiple": turn @ np.diag([5.0] * 6 + [1.0] * 6) @ turn.T,
        "low rank": draw.standard_normal((12, 3)) @ draw.standard_normal((3, 12)),
        "zero": np.zeros((12, 12)), "identity": np.eye(12),
    }[kind]
    diagonal, above, v = bidiagonal.bidiagonalise(a)
    squares = bidiagonal.squared_values(diagonal, above)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.allclose(squares, want, rtol=1e-10, atol=1e-14 * max(want[0], 1e-300))
    w = v @ bidiagonal.right_vectors(diagonal, above, 4)
    assert np.allclose(w.T @ w, np.eye(4), atol=1e-12)
    assert np.abs(a.T @ a @ w - w * squares[:4]).max() <= 1e-12 * max(want[0], 1.0)


def test_small_values_of_a_bidiagonal_matrix_are_relatively_exact():
    """Values down to 1e-20 of the largest one, against exact arithmetic on their product."""
    diagonal, above = 10.0 ** -np.arange(0.0, 11.0), 0.5 * 10.0 ** -np.arange(0.0, 10.0)
    squares = bidiagonal.squared_values(diagonal, above)
    assert abs(np.log10(squares).sum() - np.log10(diagonal ** 2).sum()) < 1e-12
