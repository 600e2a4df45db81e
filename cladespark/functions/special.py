"""Special functions on the driver: gamma function family and quantiles."""

from __future__ import annotations

import math

import numpy as np


def incomplete_gamma(x: float, a: float) -> float:
    """The regularised lower incomplete gamma function: a power series near zero, a continued fraction beyond."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / ((k * d + b) or tiny)
        c = (b + k / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def gamma_quantile(p: float, a: float, rate: float = 1.0) -> float:
    """x with incomplete_gamma(rate * x, a) = p, by bisection on a logarithmic scale."""
    lo, hi = -745.0, math.log(a + 40 * math.sqrt(a) + 60)
    for _ in range(200):
        mid = (lo + hi) / 2
        if incomplete_gamma(math.exp(mid), a) < p:
            lo = mid
        else:
            hi = mid
    return math.exp((lo + hi) / 2) / rate


def chi2_quantile(p: float, df: float) -> float:
    return 2 * gamma_quantile(p, df / 2)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def gamma_rates(alpha: float, categories: int = 4, median: bool = False) -> np.ndarray:
    """Mean (or scaled median) rates of equal-weight categories of a gamma distribution with mean 1."""
    if median:
        x = np.array([gamma_quantile((2 * i + 1) / (2 * categories), alpha, alpha) for i in range(categories)])
        return x * categories / x.sum()
    cuts = [gamma_quantile(i / categories, alpha, alpha) for i in range(1, categories)]
    shares = np.array([0.0, *(incomplete_gamma(alpha * c, alpha + 1) for c in cuts), 1.0])
    return np.diff(shares) * categories
