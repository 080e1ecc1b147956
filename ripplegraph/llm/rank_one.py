"""Eigenvalues and eigenvectors of a symmetric matrix, kept up to date as rank-one terms come in."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
MOST_STEPS = 200


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(z ** 2 / (d - root)), and d[i] - root[j] for all i and j.

    ``d`` rises strictly and no z is zero. Each root lies between two poles, the last one beyond
    all. It is found as its distance from the nearer pole, so that no difference cancels: what
    stands left and right of it is followed by one hyperbola each, with bisection as a safeguard.
    """
    k, z2 = len(d), z * z
    upper = np.append(d[1:], d[-1] + z2.sum())
    gap = upper - d
    middle = 1 + (z2[:, None] / (d[:, None] - (d + gap / 2)[None, :])).sum(axis=0)
    left = middle >= 0
    left[-1] = True
    origin = np.where(left, d, upper)
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    high[-1] = gap[-1]
    shifted, below = d[:, None] - origin[None, :], np.tri(k, k, dtype=bool).T
    to_left, to_right = d - origin, upper - origin
    tau = (low + high) / 2
    for _ in range(MOST_STEPS):
        apart = shifted - tau
        terms = z2[:, None] / apart
        slopes = terms / apart
        f = 1 + terms.sum(axis=0)
        slope_left = np.where(below, slopes, 0).sum(axis=0)
        slope = slopes.sum(axis=0)
        high, low = np.where(f > 0, tau, high), np.where(f <= 0, tau, low)
        done = (np.abs(f) <= EPS * (1 + np.abs(terms).sum(axis=0))) | (high - low <= EPS * np.abs(tau))
        if done.all():
            break
        one, two = to_left - tau, to_right - tau
        c = f - one * slope_left - two * (slope - slope_left)
        a = (one + two) * f - one * two * slope
        b = one * two * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        guess = tau + step
        inside = (guess > low) & (guess < high)
        tau = np.where(done, tau, np.where(inside, guess, (low + high) / 2))
    return origin + tau, shifted - tau


class Spectrum:
    """Eigenvalues, rising, and eigenvectors of a sum of outer products of vectors minus their mean."""

    def __init__(self, dims: int):
        self.n, self.mean = 0, np.zeros(dims)
        self.values, self.vectors = np.zeros(dims), np.eye(dims)

    def plus(self, v: np.ndarray) -> None:
        """Adds the outer product of a vector with itself.

        What the vector doesn't touch keeps its eigenpair (deflation): equal eigenvalues are first
        turned so that the vector touches one of them alone.
        """
        d, q = self.values, self.vectors
        z = v @ q
        size = float(z @ z)
        tolerance = 8 * EPS * max(abs(d[-1]), size)
        if not tolerance:
            return
        starts = np.flatnonzero(np.concatenate([[True], np.diff(d) > tolerance]))
        ends = np.append(starts[1:], len(d))
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            if length := np.sqrt(z[a:b] @ z[a:b]):
                mirror = z[a:b].copy()
                mirror[-1] += np.copysign(length, mirror[-1])
                q[:, a:b] -= np.outer(q[:, a:b] @ mirror, mirror * (2 / (mirror @ mirror)))
                z[a : b - 1], z[b - 1] = 0, -np.copysign(length, mirror[-1])
        live = np.flatnonzero(np.abs(z) * np.sqrt(size) > tolerance)
        if not len(live):
            return
        at, zs = d[live], z[live]
        roots, apart = secular_roots(at, zs)
        k = len(live)
        if k > 1:  # the z for which the roots are exact, so that the eigenvectors are orthogonal
            poles = at[None, :] - at[:, None]
            others = np.ones((k, k))
            others[:, :-1] = np.where(np.tri(k, k - 1, -1, dtype=bool), poles[:, :-1], poles[:, 1:])
            zs = np.copysign(np.sqrt(np.abs((-apart / others).prod(axis=1))), zs)
        turned = zs[:, None] / apart
        turned /= np.sqrt((turned * turned).sum(axis=0))
        q[:, live] = q[:, live] @ turned
        d[live] = roots
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], q[:, order]

    def add(self, x: np.ndarray) -> None:
        """Takes in a vector: the sum of squares about the mean grows by one centred term."""
        apart = x - self.mean
        self.n += 1
        self.mean = self.mean + apart / self.n
        if self.n > 1:
            self.plus(apart * np.sqrt((self.n - 1) / self.n))

    def merge(self, other: Spectrum) -> None:
        """Takes in another spectrum, one of its eigenpairs after the other, and what lies between the means."""
        if not other.n:
            return
        if self.n:
            apart, n = other.mean - self.mean, self.n + other.n
            self.plus(apart * np.sqrt(self.n * other.n / n))
            self.mean, self.n = self.mean + apart * (other.n / n), n
        else:
            self.mean, self.n = other.mean.copy(), other.n
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.plus(vector * np.sqrt(value))
