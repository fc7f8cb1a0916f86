"""Distribution functions for p-values: F, t and chi-square, from continued fractions.

They run on result rows, never on data rows.
"""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by the modified Lentz recurrence."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for coef in (even, odd):
            d = 1.0 + coef * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + coef / c
            c = c if abs(c) > _TINY else _TINY
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h * front


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """P(F > f)."""
    return np.array(
        [
            1.0 if not v > 0 else (0.0 if math.isinf(v) else beta_inc(b / 2.0, a / 2.0, b / (b + a * v)))
            for v, a, b in zip(f, d1, d2)
        ]
    )


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > |t|)."""
    return np.array(
        [
            float("nan") if math.isnan(v) else (0.0 if math.isinf(v) else beta_inc(n / 2.0, 0.5, n / (n + v * v)))
            for v, n in zip(t, df)
        ]
    )


def chi2_upper(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(chi-square > x)."""
    return np.array([gamma_upper(n / 2.0, v / 2.0) if n > 0 else 1.0 for v, n in zip(x, df)])


def t_quantile(p: float, df: float) -> float:
    """Upper quantile of t by bisection."""
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if 1.0 - 0.5 * beta_inc(df / 2.0, 0.5, df / (df + mid * mid)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0
