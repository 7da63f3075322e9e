"""Shapiro-Wilk statistic and p-value of one sample of at most 5,000 values (Royston 1995)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

# Polynomial coefficients published by Royston (1995), constant term first.
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT_TO_LAST_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


def weights(n: int) -> np.ndarray:
    """What each of n ordered values counts in W; they are antisymmetric and depend on n alone."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    inverse = NormalDist().inv_cdf
    scores = np.array([inverse((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    square = float(scores @ scores)
    unit = scores / math.sqrt(square)
    u = 1.0 / math.sqrt(n)
    found = np.empty(n)
    last = unit[-1] + _poly(LAST_WEIGHT, u)
    if n > 5:
        before = unit[-2] + _poly(NEXT_TO_LAST_WEIGHT, u)
        phi = (square - 2 * scores[-1] ** 2 - 2 * scores[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
        found[2:-2] = scores[2:-2] / math.sqrt(phi)
        found[1], found[-2] = -before, before
    else:
        phi = (square - 2 * scores[-1] ** 2) / (1 - 2 * last**2)
        found[1:-1] = scores[1:-1] / math.sqrt(phi)
    found[0], found[-1] = -last, last
    return found


def statistic(product: float, spread: float, reach: float) -> float:
    """W from the sum of weight times centred value, the sum of squares and the range; 1 without spread."""
    if reach <= 1e-19 or spread <= 0.0:
        return 1.0
    return min(1.0, product**2 / spread)


def p_value(w: float, n: int) -> float:
    """Royston's approximation of the probability of a smaller W among n normal values."""
    if w >= 1.0:
        return 1.0
    if n == 3:
        return max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log1p(-w)
    if n <= 11:
        gamma = _poly(SMALL_GAMMA, n)
        if y >= gamma:
            return 1e-99
        y = -math.log(gamma - y)
        mean, sd = _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_LOG_SD, n))
    else:
        log_n = math.log(n)
        mean, sd = _poly(LARGE_MEAN, log_n), math.exp(_poly(LARGE_LOG_SD, log_n))
    return 0.5 * math.erfc((y - mean) / sd / math.sqrt(2.0))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """(W, p) of values at hand. A sample without spread has W = 1, p = 1."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3:
        raise ValueError("at least 3 values are needed")
    centred = x - np.median(x)
    spread = float(((centred - centred.mean()) ** 2).sum())
    w = statistic(float(weights(n) @ centred), spread, float(x[-1] - x[0]))
    return w, p_value(w, n)
