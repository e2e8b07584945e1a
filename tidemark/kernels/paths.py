"""Autoregressive paths as one linear system.

A path of a second-order recursion with fixed shocks satisfies (I - L) x = shocks, with L banded: the lag coefficients
may change from step to step, may be matrices, and one factorisation serves any number of paths.  Scalar and vector
surrogates, and all synthetic designs, are such systems; long paths are solved in blocks that hand over their last two
values."""

from __future__ import annotations

import numpy as np

BLOCK = 256


def recursion(lags: np.ndarray, shocks: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Paths (m, n + 2, k) from start (m, 2, k) and shocks (m, n, k).  lags is (2, k, k), or (n, 2, k, k) where the
    coefficients change with the step."""
    m, n, k = shocks.shape
    steady = lags.ndim == 3
    out = np.empty((m, n + 2, k))
    out[:, :2] = start
    system = None
    for lo in range(0, n, BLOCK):
        size = min(BLOCK, n - lo)
        own = np.broadcast_to(lags, (size, 2, k, k)) if steady else lags[lo : lo + size]
        if system is None or not steady or system.shape[0] != size * k:
            system = np.eye(size * k)
            for j in (1, 2):
                at = np.arange(j, size)
                system.reshape(size, k, size, k)[at, :, at - j, :] -= own[j:, j - 1]
        right = shocks[:, lo : lo + size].copy()
        right[:, 0] += out[:, lo + 1] @ own[0, 0].T + out[:, lo] @ own[0, 1].T
        if size > 1:
            right[:, 1] += out[:, lo + 1] @ own[1, 1].T
        out[:, lo + 2 : lo + 2 + size] = np.linalg.solve(system, right.reshape(m, -1).T).T.reshape(m, size, k)
    return out


def shocks(residuals: np.ndarray, rng: np.random.Generator, count: int, kind: str = "residual") -> np.ndarray:
    """(count, n, k) shocks from residual vectors (n, k): drawn with replacement, or with random signs."""
    n = len(residuals)
    if kind == "residual":
        return residuals[rng.integers(0, n, size=(count, n))]
    if kind == "wild":
        return residuals * (2.0 * rng.integers(0, 2, size=(count, n)) - 1.0)[..., None]
    raise ValueError("kind is residual or wild")


class Null:
    """A fitted, strictly stable second-order recursion: intercept (k), lags (2, k, k), centred residuals and start."""

    def __init__(self, x: np.ndarray, intercept, lags):
        x = np.asarray(x, float).reshape(len(x), -1)
        self.intercept, self.lags, self.start = np.asarray(intercept, float), np.asarray(lags, float), x[:2]
        left = x[2:] - self.intercept - sum(x[2 - j : len(x) - j] @ a.T for j, a in enumerate(self.lags, 1))
        self.residuals = left - left.mean(0)

    def draw(self, rng: np.random.Generator, count: int, kind: str = "residual") -> np.ndarray:
        """(count, n, k) surrogate paths."""
        e = shocks(self.residuals, rng, count, kind) + self.intercept
        return recursion(self.lags, e, np.broadcast_to(self.start, (count, *self.start.shape)))


def stationary(lags: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Covariance (2k, 2k) of two neighbouring values, the earlier first, of a stationary recursion: the fixed point
    C = F C F' + N of its companion form, by doubling."""
    k = noise.shape[0]
    f, c = np.zeros((2 * k, 2 * k)), np.zeros((2 * k, 2 * k))
    f[:k, k:], f[k:, k:], f[k:, :k] = np.eye(k), lags[0], lags[1]
    c[k:, k:] = noise
    while np.abs(f).max() > 1e-18:
        c = c + f @ c @ f.T
        f = f @ f
    return c


def design(rng: np.random.Generator, factor: np.ndarray, mean: np.ndarray, lags: np.ndarray, onsets, kappa: float, n: int, reach: int) -> np.ndarray:
    """One path (n, k) around its mean, from its stationary start; in the `reach` positions before each onset the lag
    of order j carries kappa**j.  Shocks are factor times standard normals, start first (fixed order of draws)."""
    k = len(mean)
    start = np.linalg.cholesky(stationary(lags, factor @ factor.T)) @ rng.standard_normal(2 * k)
    e = rng.standard_normal((n - 2, k)) @ factor.T
    planted = (np.arange(2, n)[:, None] - np.asarray(list(onsets) or [-n])[None, :])
    strength = np.where(((planted < 0) & (planted >= -reach)).any(1), kappa, 1.0)
    own = lags * np.stack([strength, strength**2], 1)[:, :, None, None]
    return mean + recursion(own, e[None], start.reshape(1, 2, k))[0]
