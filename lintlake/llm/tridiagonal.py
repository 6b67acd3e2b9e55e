"""Leading eigenvectors of a symmetric matrix: Householder, Sturm counts, inverse iteration.

Dense work on one matrix whose side is a number of dimensions, not of rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
# Eigenvalues closer than this share of the norm form a cluster.
CLUSTER_GAP = 1e-3
INVERSE_STEPS = 4


def tridiagonalised(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the reflectors' unit vectors, by Householder's reduction."""
    a = np.array(matrix, dtype=float)
    size = len(a)
    off, reflectors = np.zeros(max(0, size - 1)), []
    for k in range(size - 1):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        off[k] = -length if v[0] > 0 else length
        v[0] -= off[k]
        norm = np.linalg.norm(v)
        if norm == 0:
            reflectors.append(v)
            continue
        v /= norm
        reflectors.append(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
    return np.diag(a).copy(), off, reflectors


def counts_below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray, least: float) -> np.ndarray:
    """How many eigenvalues lie below each shift: negative terms of the Sturm sequence."""
    squares = np.concatenate(([0.0], off * off))
    q, below = np.ones_like(shifts), np.zeros(len(shifts), dtype=int)
    for d, s in zip(diagonal, squares):
        q = d - shifts - s / q
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, by bisection to the last bit the norm allows."""
    size = len(diagonal)
    around = np.concatenate(([0.0], np.abs(off))) + np.concatenate((np.abs(off), [0.0]))
    low, high = (diagonal - around).min(), (diagonal + around).max()
    norm = max(abs(low), abs(high), np.finfo(float).tiny)
    least = max(EPS * EPS * norm, np.finfo(float).tiny)
    rank = size - 1 - np.arange(min(most, size))
    lows, highs = np.full(len(rank), low - EPS * norm), np.full(len(rank), high + 4 * EPS * norm)
    while True:
        middle = (lows + highs) / 2
        done = (highs - lows <= EPS * np.maximum(np.abs(middle), EPS * norm)) | (middle <= lows) | (middle >= highs)
        if done.all():
            return middle
        above = counts_below(diagonal, off, middle, least) <= rank
        lows = np.where(above & ~done, middle, lows)
        highs = np.where(~above & ~done, middle, highs)


def _factored(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """Gaussian elimination of the shifted matrix with row exchanges."""
    size = len(diagonal)
    d, upper, second = list(diagonal - shift), [*off, 0.0], [0.0] * size
    swaps, factors = [False] * size, [0.0] * size
    for k in range(size - 1):
        below = off[k]
        if abs(d[k]) >= abs(below):
            if abs(d[k]) < least:
                d[k] = least
            factors[k] = below / d[k]
            d[k + 1] -= factors[k] * upper[k]
        else:
            swaps[k] = True
            factors[k] = d[k] / below
            d[k], kept = below, upper[k]
            upper[k], d[k + 1] = d[k + 1], kept - factors[k] * d[k + 1]
            second[k], upper[k + 1] = upper[k + 1], -factors[k] * upper[k + 1]
    if abs(d[-1]) < least:
        d[-1] = least
    return d, upper, second, swaps, factors


def _solved(factored, right: np.ndarray) -> np.ndarray:
    d, upper, second, swaps, factors = factored
    x = list(right)
    size = len(x)
    for k in range(size - 1):
        if swaps[k]:
            x[k], x[k + 1] = x[k + 1], x[k]
        x[k + 1] -= factors[k] * x[k]
    for k in range(size - 1, -1, -1):
        if k + 1 < size:
            x[k] -= upper[k] * x[k + 1]
        if k + 2 < size:
            x[k] -= second[k] * x[k + 2]
        x[k] /= d[k]
    return np.array(x)


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as columns, by inverse iteration; those of one cluster are kept orthogonal."""
    size = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    least = EPS * norm
    draw = np.random.default_rng(1)
    out, first = np.zeros((size, len(values))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER_GAP * norm:
            first = k
        factored = _factored(diagonal, off, value, least)
        x = draw.standard_normal(size)
        for _ in range(INVERSE_STEPS):
            for _ in range(2):
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
            x = _solved(factored, x / np.linalg.norm(x))
            x /= np.abs(x).max()
        for _ in range(2):
            x -= out[:, first:k] @ (out[:, first:k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def leading_eigenpairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    diagonal, off, reflectors = tridiagonalised(matrix)
    values = leading_values(diagonal, off, most)
    vectors = tridiagonal_vectors(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    return values, vectors
