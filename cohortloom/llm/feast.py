"""Eigenpairs of a symmetric matrix inside an interval, by contour integration.

The projector on the eigenvectors whose values lie in (low, high) is the
integral of the resolvent around a circle through both ends.  A Gauss-Legendre
rule on the upper half circle (the lower half is its conjugate) turns it into a
few solves with complex shifts; a Rayleigh-Ritz step on the filtered block gives
the pairs, and the block is filtered again until all residuals are at rounding
level.  How many pairs there are is known beforehand from the inertia of the
shifted matrix at both ends, so a missed pair is seen.
"""

from __future__ import annotations

import numpy as np

#: Quadrature points on the half circle.
NODES = 8
#: An interval is cut further while it holds more eigenvalues and is wider than ``CLUSTER`` of the spectrum.
PER_INTERVAL = 8
CLUSTER = 1e-6
ROUNDS = 40
_PIVOT = (1 + 17**0.5) / 8


def above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: the positive pivots of a symmetric factorisation (Sylvester's law).

    Pivots are 1 x 1, or 2 x 2 where the diagonal is too small; a 2 x 2 pivot chosen
    that way has one value of each sign.
    """
    left = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(left):
        diagonal = np.abs(np.diag(left))
        k = int(np.argmax(diagonal))
        off = np.abs(left - np.diag(np.diag(left)))
        p, q = np.unravel_index(int(np.argmax(off)), off.shape)
        if diagonal[k] == 0 and off[p, q] == 0:
            break
        if diagonal[k] >= _PIVOT * off[p, q]:
            rest = np.delete(np.arange(len(left)), k)
            positive += bool(left[k, k] > 0)
            left = left[np.ix_(rest, rest)] - np.outer(left[rest, k], left[k, rest]) / left[k, k]
        else:
            pair, rest = [p, q], np.delete(np.arange(len(left)), [p, q])
            positive += 1
            side = left[np.ix_(rest, pair)]
            left = left[np.ix_(rest, rest)] - side @ np.linalg.solve(left[np.ix_(pair, pair)], side.T)
    return positive


def intervals(matrix: np.ndarray, wanted: int, floor: float) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals that hold the ``wanted`` largest eigenvalues above ``floor``, or a few more.

    The matrix is positive semidefinite up to rounding.
    """
    high = 1.01 * min(float(np.trace(matrix)), float(np.abs(matrix).sum(axis=1).max()))
    if not high > 0:
        return []
    low, count = floor * high, above(matrix, floor * high)
    wanted = min(wanted, count)
    if not wanted:
        return []
    top = high
    while count > wanted and top - low > CLUSTER * high:
        middle = (low + top) / 2
        found = above(matrix, middle)
        low, count, top = (middle, found, top) if found >= wanted else (low, count, middle)
    out, open_ = [], [(low, high, count, 0)]
    while open_:
        a, b, n_a, n_b = open_.pop()
        if n_a - n_b > PER_INTERVAL and b - a > CLUSTER * high:
            middle = (a + b) / 2
            n = above(matrix, middle)
            open_ += [(a, middle, n_a, n), (middle, b, n, n_b)]
        elif n_a > n_b:
            out.append((a, b, n_a - n_b))
    return sorted(out, reverse=True)


def _filtered(matrix: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """The block after the quadrature of the resolvent around (low, high)."""
    points, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for x, w in zip(points, weights):
        turn = np.exp(0.5j * np.pi * (1 - x))
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(matrix)) - matrix, block.astype(complex))
        out += 0.5 * w * (radius * turn * solved).real
    return out


def _ritz(matrix: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz values, falling, and vectors of the space that the block spans."""
    basis, size, _ = np.linalg.svd(block, full_matrices=False)
    basis = basis[:, size > 1e-14 * size[0]] if size[0] > 0 else basis
    inner = basis.T @ matrix @ basis
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], (basis @ turn)[:, ::-1]


def pairs(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (low, high), falling, and their vectors as columns.

    If the block can't be brought to ``count`` pairs it is enlarged up to the whole
    space, in which Rayleigh-Ritz is exact.
    """
    d = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max())
    slack = 1e-9 * norm  # an eigenvalue on an interval's end belongs where the inertia counted it
    size = min(d, 2 * count + 4)
    while True:
        block = np.random.default_rng(size).standard_normal((d, size))
        for _ in range(ROUNDS):
            values, vectors = _ritz(matrix, _filtered(matrix, low, high, block))
            inside = np.flatnonzero((values > low - slack) & (values < high + slack))
            middle = np.abs(values - (low + high) / 2)
            inside = np.sort(inside[np.argsort(middle[inside], kind="stable")[:count]])
            rest = np.linalg.norm(matrix @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            if len(inside) == count and (rest <= 1e-14 * d * norm).all():
                return values[inside], vectors[:, inside]
            block = vectors
        if size == d:
            raise ArithmeticError(f"{len(inside)} of {count} eigenvalues found in ({low}, {high})")
        size = min(d, 2 * size)


def joined(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One Rayleigh-Ritz step over the vectors of all intervals: values, falling, and orthonormal vectors."""
    return _ritz(matrix, vectors)
