"""Quantiles of the normal, Student's t and chi-squared distributions, without SciPy."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, tiny = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300), 1e-300
    value = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_cdf(t: float, nu: float) -> float:
    tail = 0.5 * incomplete_beta(nu / 2, 0.5, nu / (nu + t * t))
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, nu: float) -> float:
    """By bisection on the distribution function; above 1e7 degrees of freedom the normal one."""
    nu = max(nu, 1.0)
    if nu > 1e7:
        return normal_quantile(p)
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, nu)
    low, high = 0.0, 1.0
    while t_cdf(high, nu) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_cdf(middle, nu) < p else (low, middle)
    return (low + high) / 2


def chi_squared_quantile(p: float, nu: float) -> float:
    """Wilson and Hilferty's approximation."""
    k = 2 / (9 * nu)
    return nu * (1 - k + normal_quantile(p) * math.sqrt(k)) ** 3
