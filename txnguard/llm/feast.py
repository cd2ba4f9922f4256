"""Eigenpairs of a symmetric matrix by FEAST: contour integration per interval, verified by inertia counts."""

from __future__ import annotations

import numpy as np

#: Quadrature nodes on the upper half circle, and most eigenvalues that one interval is meant to hold.
NODES = 8
IN_INTERVAL = 4
#: Rounds of projection before an interval is given up, and the residual that counts as exact, relative to the matrix.
ROUNDS = 40
EXACT = 1e-13


class Inertia:
    """Numbers of eigenvalues below a shift, from the signs of the pivots of the shifted tridiagonal form."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.diagonal, self.beside = tridiagonal(matrix)
        self.scale = max(np.abs(self.diagonal).max(initial=0), np.abs(self.beside).max(initial=0), np.finfo(float).tiny)

    def below(self, shift: float) -> int:
        tiny, count, pivot = self.scale * np.finfo(float).eps ** 2, 0, 1.0
        for k, d in enumerate(self.diagonal):
            pivot = d - shift - (self.beside[k - 1] ** 2 / pivot if k else 0.0)
            if abs(pivot) < tiny:
                pivot = -tiny
            count += pivot < 0
        return count

    def bounds(self) -> tuple[float, float]:
        """An interval around all eigenvalues (Gershgorin)."""
        reach = np.abs(np.append(self.beside, 0)) + np.abs(np.append(0, self.beside))
        room = self.scale * 1e-8
        return float((self.diagonal - reach).min() - room), float((self.diagonal + reach).max() + room)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and second diagonal of a tridiagonal matrix with the same eigenvalues (Householder)."""
    a = np.array(matrix, float)
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size:
            x /= size
            a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
    return a.diagonal().copy(), a.diagonal(1).copy()


def intervals(inertia: Inertia, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals with the numbers of their eigenvalues, the highest first, that hold the ``wanted`` largest ones at least.

    An interval is halved until it has few eigenvalues or is so narrow that these are one to double precision.
    """
    low, high = inertia.bounds()
    narrow, found, have = inertia.scale * 1e-13, [], 0
    held = [(low, high, 0, len(inertia.diagonal))]
    while held and have < wanted:
        a, b, under, upto = held.pop()
        middle = (a + b) / 2
        if upto - under > IN_INTERVAL and b - a > narrow and a < middle < b:
            split = inertia.below(middle)
            held += [(a, middle, under, split), (middle, b, split, upto)]
        elif upto > under:
            found.append((a, b, upto - under))
            have += upto - under
    return found


def project(matrix: np.ndarray, a: float, b: float, block: np.ndarray) -> np.ndarray:
    """What the contour around [a, b] leaves of ``block``: a Gauss-Legendre sum of complex shifted solves."""
    points, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius, eye, out = (a + b) / 2, (b - a) / 2, np.eye(len(matrix)), np.zeros_like(block)
    for t, w in zip(points, weights, strict=True):
        turn = np.exp(1j * np.pi * (1 - t) / 2)
        out += w / 2 * (radius * turn * np.linalg.solve((centre + radius * turn) * eye - matrix, block)).real
    return out


def orthonormal(block: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns that are there to working precision."""
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    return u[:, s > s.max(initial=0) * 1e-14]


def ritz(matrix: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    small = basis.T @ matrix @ basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return values, basis @ vectors


def in_interval(matrix: np.ndarray, a: float, b: float, count: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of [a, b]: subspace iteration with the contour's projector, Rayleigh-Ritz in each round.

    The subspace has room for more than ``count``; it grows while the inertia count is not met.
    """
    middle, reach = (a + b) / 2, max(b - a, scale * 1e-12) * 0.5
    size, rng = min(len(matrix), count + count // 2 + 3), np.random.default_rng(42)
    block = rng.standard_normal((len(matrix), size))
    for tried in range(ROUNDS):
        values, vectors = ritz(matrix, orthonormal(project(matrix, middle - reach, middle + reach, block)))
        nearest = np.sort(np.argsort(np.abs(values - middle), kind="stable")[:count])
        own, pairs = values[nearest], vectors[:, nearest]
        residual = np.abs(matrix @ pairs - pairs * own).max(initial=0)
        if len(own) == count and residual <= EXACT * scale * len(matrix) and np.all(np.abs(own - middle) <= reach + EXACT * scale * len(matrix)):
            return own, pairs
        if len(own) < count or tried % 10 == 9:
            size = min(len(matrix), size * 2)
        block = np.hstack((vectors, rng.standard_normal((len(matrix), max(0, size - vectors.shape[1])))))
    raise ArithmeticError(f"the inertia counts {count} eigenvalues between {a} and {b}, which the projection does not give")


def largest(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Fewer if the matrix has fewer rows. Every interval gives as many pairs as inertia counts in it, so none is missed;
    equal eigenvalues have some orthonormal basis. The pairs of all intervals pass through one more Rayleigh-Ritz step,
    which makes close ones of neighbouring intervals orthogonal.
    """
    wanted = min(wanted, len(matrix))
    unit = np.abs(matrix).max(initial=0)
    if not unit:
        return np.zeros(wanted), np.eye(len(matrix), wanted)
    matrix = matrix / unit
    inertia = Inertia(matrix)
    scale = max(abs(x) for x in inertia.bounds())
    found = [in_interval(matrix, a, b, n, scale)[1] for a, b, n in intervals(inertia, wanted)]
    values, vectors = ritz(matrix, np.linalg.qr(np.hstack(found))[0])
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order] * unit, vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
