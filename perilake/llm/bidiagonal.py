"""Singular values and right singular vectors of a small square matrix.

Householder reflections make it bidiagonal; dqds finds the squared singular values of
the bidiagonal matrix with small relative error; twisted factorisations give each
vector. It works on one matrix, as wide as the data.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(float).eps)
#: Transforms for one matrix, far more than needed; a bound so that nothing can run on.
ROUNDS = 200


def bidiagonalise(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B, and V, where ``a = U B V'``."""
    a = np.array(a, float)
    n = len(a)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray:
        u, norm = x.copy(), np.linalg.norm(x)
        if norm:
            u[0] += math.copysign(norm, u[0])
            u /= np.linalg.norm(u)
        return u

    for k in range(n):
        u = reflector(a[k:, k])
        a[k:, k:] -= 2.0 * np.outer(u, u @ a[k:, k:])
        if k < n - 2:
            w = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2.0 * np.outer(a[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= 2.0 * np.outer(v[:, k + 1:] @ w, w)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds transform: q, e and the d values; None if the shift is above the least eigenvalue."""
    d = [q[0] - shift]
    out_q, out_e = [], []
    for k in range(len(e)):
        top = d[k] + e[k]
        if d[k] < 0 or top <= 0:
            return None
        out_q.append(top)
        out_e.append(e[k] * (q[k + 1] / top))
        d.append(d[k] * (q[k + 1] / top) - shift)
    return None if d[-1] < 0 else ([*out_q, d[-1]], out_e, d)


def squared_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, in falling order, by dqds with deflation."""
    scale = float(max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0)))
    if not scale:
        return np.zeros(len(diagonal))
    found: list[float] = []
    todo = [([float(x / scale) ** 2 for x in diagonal], [float(x / scale) ** 2 for x in above], 0.0)]
    left = ROUNDS * len(diagonal)
    while todo:
        q, e, base = todo.pop()
        while len(q) > 1:
            small = EPS * EPS
            gone = next((k for k in reversed(range(len(e))) if e[k] <= small * (base + min(q[k], q[k + 1]))), None)
            if gone is not None:
                todo.append((q[:gone + 1], e[:gone], base))
                q, e = q[gone + 1:], e[gone + 1:]
                continue
            left -= 1
            if not left:
                raise ArithmeticError("the singular values did not converge")
            if (step := transform(q, e, 0.0)) is None or min(step[2]) <= 0:
                # An eigenvalue of nothing beyond the shift: the transform has moved it to the end.
                q, e = (step or (q, [0.0] * len(e), None))[:2]
                continue
            plain_q, plain_e, d = step
            # One over the trace of the inverse and the least d enclose the least eigenvalue.
            least, bound = min(d), 1.0 / sum(1.0 / x for x in d)
            q, e = plain_q, plain_e
            for shift in (least - 0.01 * (least - bound), (least + bound) / 2, bound * (1 - 4 * len(q) * EPS)):
                if shift > EPS * base and (step := transform(plain_q, plain_e, shift)):
                    q, e, base = step[0], step[1], base + shift
                    break
        found += [base + x for x in q]
    return np.sort(np.array(found))[::-1] * scale * scale


def _twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Vector of ``B'B`` for one eigenvalue, from the twist of least gamma."""
    n, d, b = len(diagonal), diagonal * diagonal, above * above
    off = diagonal[:-1] * above
    tiny = EPS * EPS * value or 1e-300
    safe = lambda x: x if abs(x) > tiny else math.copysign(tiny, x)
    down, up = np.empty(n), np.empty(n)
    s, p = np.empty(n), np.empty(n)
    s[0], p[n - 1] = -value, d[n - 1] - value
    for k in range(n - 1):
        down[k] = safe(s[k] + d[k])
        s[k + 1] = b[k] * (s[k] / down[k]) - value
    for k in reversed(range(n - 1)):
        up[k + 1] = safe(b[k] + p[k + 1])
        p[k] = p[k + 1] * (d[k] / up[k + 1]) - value
    at = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[at] = 1.0
    for k in reversed(range(at)):
        z[k] = -off[k] / down[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -off[k] / up[k + 1] * z[k]
    return z / np.linalg.norm(z)


def _iterated(diagonal: np.ndarray, above: np.ndarray, value: float, start: np.ndarray) -> np.ndarray:
    """One step of inverse iteration with ``B'B - value``, for values that one twist does not tell apart."""
    main = diagonal * diagonal
    main[1:] += above * above
    off = diagonal[:-1] * above
    matrix = np.diag(main - value * (1 + 4 * EPS)) + np.diag(off, 1) + np.diag(off, -1)
    try:
        z = np.linalg.solve(matrix, start)
    except np.linalg.LinAlgError:
        z = start
    return z / np.linalg.norm(z) if np.isfinite(z).all() and z.any() else start


def right_vectors(diagonal: np.ndarray, above: np.ndarray, count: int) -> np.ndarray:
    """Orthonormal right singular vectors of the ``count`` largest squared values, as columns.

    A matrix that falls into blocks is solved block by block, so that vectors of
    different blocks don't mix.
    """
    n = len(diagonal)
    size = np.maximum(np.abs(diagonal[:-1]), np.abs(diagonal[1:]))
    cuts = [0, *(np.flatnonzero(np.abs(above) <= EPS * size) + 1), n]
    pairs = [(float(x), a, b) for a, b in zip(cuts[:-1], cuts[1:]) for x in squared_values(diagonal[a:b], above[a:b - 1])]
    pairs = sorted(pairs, key=lambda t: -t[0])[:count]
    out = np.zeros((n, count))
    draw = np.random.default_rng(7)
    for j, (value, a, b) in enumerate(pairs):
        z = _twisted(diagonal[a:b], above[a:b - 1], value) if b - a > 1 else np.ones(1)
        known = out[a:b, :j]
        for attempt in range(8):
            rest = z - known @ (known.T @ z)
            if np.linalg.norm(rest) > 0.7:
                break
            z = _iterated(diagonal[a:b], above[a:b - 1], value, draw.standard_normal(b - a) if attempt % 2 == 0 else z)
        rest = rest - known @ (known.T @ rest)
        out[a:b, j] = rest / np.linalg.norm(rest)
    return out
