"""Tail probabilities for a handful of scalars on the driver."""

from __future__ import annotations

import math

import numpy as np


def gamma_q(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, dof: int) -> float:
    return gamma_q(dof / 2, x / 2) if dof > 0 else 1.0


def ks_sf(d: float, n: int, m: int) -> float:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic."""
    if not n or not m:
        return float("nan")
    x = d * math.sqrt(n * m / (n + m))
    if x < 1e-6:
        return 1.0
    total = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, total))


def ks_exact_sf(d: float, n: int, m: int) -> float:
    """Exact p-value of the two-sample Kolmogorov-Smirnov statistic: the share of the lattice paths from (0, 0) to (n, m), all alike under the null
    hypothesis, that somewhere reach the difference ``d``.

    The paths that stay below it are counted row by row; a row's counts are running sums of the last row's within the allowed band.
    """
    if not n or not m:
        return float("nan")
    g = math.gcd(n, m)
    a, b = m // g, n // g  # the difference at (i, j) is |i * a - j * b| / (a * n)
    least = round(d * a * n)
    if least <= 0:
        return 1.0
    lo, row, scale = 0, np.ones(min(m, (least - 1) // b) + 1), 0.0
    for i in range(1, n + 1):
        first, last = max(0, (i * a - least) // b + 1), min(m, -(-(i * a + least) // b) - 1)
        if first > last:
            return 1.0
        above = np.zeros(last - first + 1)
        above[: max(0, lo + len(row) - first)] = row[first - lo :]
        row, lo = np.cumsum(above), first
        if row[-1] == 0:
            return 1.0
        scale += math.log(row[-1])
        row /= row[-1]
    if lo + len(row) <= m:
        return 1.0
    inside = scale + math.log(row[m - lo]) - (math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1))
    return min(1.0, max(0.0, -math.expm1(min(0.0, inside))))
