"""Tail probabilities of the normal, Student and chi-square laws for p x p result tables."""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300
_EPS = 1e-15


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _log_gamma_step(a: float) -> float:
    """log of Gamma(a + 1/2) / Gamma(a); from 60 on by its series, where the difference of two logarithms loses digits."""
    if a < 60.0:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    b = 1.0 / (a * a)
    return 0.5 * math.log(a) - (1.0 / 8.0 - b * (1.0 / 192.0 - b * (1.0 / 640.0 - b * 17.0 / 14336.0))) / a


def _double_exponential(n: int = 160, reach: float = 3.6) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on (0, 1) that crowd doubly exponentially at both ends."""
    s = np.linspace(-reach, reach, n)
    h = math.pi / 2 * np.sinh(s)
    weights = (s[1] - s[0]) * math.pi / 4 * np.cosh(s) / np.cosh(h) ** 2
    return 1.0 / (1.0 + np.exp(-2.0 * h)), weights


_NODES, _WEIGHTS = _double_exponential()
#: exp(-y * y) is nothing beyond here
_FAR = 9.0


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|), by one formula for all t and df.

    With tan(angle) = t / sqrt(df) the tail is an integral of a power of the cosine. Counting the fall of its logarithm
    as y * y / df leaves C * cos(angle)**df * integral of 2 y exp(-y * y) / sin(angle at y), whose integrand is smooth
    on (0, inf) and near t = 0 only close to the lower end, where the nodes crowd. Logarithms keep tiny tails exact.
    """
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    log_cos_squared = -math.log1p(t / df * t)
    y = _FAR * _NODES
    sine = np.sqrt(-np.expm1(log_cos_squared - 2.0 * y * y / df))
    integral = float(np.sum(_FAR * _WEIGHTS * 2.0 * y * np.exp(-y * y) / sine))
    log_front = _log_gamma_step(df / 2.0) - 0.5 * math.log(math.pi) + df / 2.0 * log_cos_squared - math.log(df)
    return min(1.0, 2.0 * math.exp(log_front) * integral)


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson or Spearman coefficient over n rows."""
    if math.isnan(r) or n < 3:
        return math.nan
    if abs(r) >= 1.0:
        return 0.0
    return student_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def chi_square_tail(x: float, df: float) -> float:
    """P(X >= x): series below the mean, continued fraction above it."""
    if math.isnan(x) or df <= 0:
        return math.nan
    if math.isinf(x):
        return 0.0
    if x <= 0.0:
        return 1.0
    a, y = df / 2.0, x / 2.0
    log_front = a * math.log(y) - y - math.lgamma(a)
    if y < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1.0
            term *= y / k
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    b = y + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1.0) < _EPS:
            break
    return math.exp(log_front) * h
