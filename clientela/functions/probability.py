"""Tail probabilities of test statistics: a handful of numbers per report."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


# Hart's rational function for the normal distribution, as given by West (2005).
NORMAL_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
NORMAL_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
NORMAL_FAR = 7.07106781186547  # from here on a continued fraction


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """The standard normal distribution function."""
    x = np.minimum(np.abs(z), 37.0)
    density = np.exp(-x * x / 2.0)
    near = density * np.polyval(NORMAL_TOP, x) / np.polyval(NORMAL_BOTTOM, x)
    fraction = x + 0.65
    for i in (4, 3, 2, 1):
        fraction = x + i / fraction
    tail = np.where(x < NORMAL_FAR, near, density / (fraction * math.sqrt(2 * math.pi)))
    return np.where(z > 0, 1.0 - tail, tail)


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals <= w)."""
    x, weight = np.polynomial.legendre.leggauss(96)
    z = 8.5 * x
    density = np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    inside = normal_cdf(z)[None, :] - normal_cdf(z[None, :] - np.asarray(w)[:, None])
    return 8.5 * k * (weight * density * np.clip(inside, 0.0, 1.0) ** (k - 1)).sum(axis=1)


def studentized_range_tails(q: np.ndarray, k: int, df: float) -> np.ndarray:
    """P(Q > q) of the studentized range of ``k`` means with ``df`` degrees of freedom."""
    spread = 1.0 / math.sqrt(2.0 * df)
    low, high = max(1e-9, 1.0 - 9.0 * spread), 1.0 + 9.0 * spread
    x, weight = np.polynomial.legendre.leggauss(48)
    s = (high - low) / 2.0 * x + (high + low) / 2.0
    log_density = (
        df / 2.0 * math.log(df) - math.lgamma(df / 2.0) - (df / 2.0 - 1.0) * math.log(2.0)
        + (df - 1.0) * np.log(s) - df * s * s / 2.0
    )
    density = np.exp(log_density) * (high - low) / 2.0 * weight
    found = np.empty(len(q))
    for start in range(0, len(q), 64):
        part = np.asarray(q[start : start + 64], dtype=float)
        inside = _range_cdf((part[:, None] * s[None, :]).ravel(), k).reshape(len(part), -1)
        found[start : start + 64] = 1.0 - inside @ density
    return np.where(np.isnan(q), np.nan, np.where(q <= 0, 1.0, np.clip(found, 0.0, 1.0)))


@lru_cache(maxsize=64)
def studentized_range_critical(alpha: float, k: int, df: float) -> float:
    """The q with P(Q > q) = alpha, by bisection."""
    low, high = 0.0, 100.0
    for _ in range(60):
        middle = (low + high) / 2.0
        if studentized_range_tails(np.array([middle]), k, df)[0] > alpha:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0
