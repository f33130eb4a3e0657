"""Distribution functions for driver-side results, in plain Python and numpy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

_TINY = 1e-300


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    out = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + num / c
            c = c if abs(c) > _TINY else _TINY
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * out


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_pdf(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def t_cdf(x: float, df: float) -> float:
    if math.isinf(df):
        return norm_cdf(x)
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + x * x))
    return 1 - tail if x > 0 else tail


def f_cdf(x: float, d1: float, d2: float) -> float:
    return betainc(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def chi2_cdf(x: float, df: float) -> float:
    return gammainc(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    return 1 - chi2_cdf(x, df)


def t_two(x: float, df: float) -> float:
    """Two-sided p value."""
    return betainc(df / 2, 0.5, df / (df + x * x)) if not math.isinf(df) else math.erfc(abs(x) / math.sqrt(2))


def norm_two(x: float) -> float:
    return math.erfc(abs(x) / math.sqrt(2))


def invert(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    """x with cdf(x) = p, by bisection; the bracket grows as needed."""
    while cdf(high) < p and high < 1e12:
        high *= 2
    while low < 0 and cdf(low) > p and low > -1e12:
        low *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


def norm_ppf(p: float) -> float:
    return invert(norm_cdf, p, -10, 10)


def t_ppf(p: float, df: float) -> float:
    return invert(lambda x: t_cdf(x, df), p, -50, 50)


def chi2_ppf(p: float, df: float) -> float:
    return invert(lambda x: chi2_cdf(x, df), p, 0, 10 * df + 10)


def f_ppf(p: float, d1: float, d2: float) -> float:
    return invert(lambda x: f_cdf(x, d1, d2), p, 0, 10)


def noncentral_f_cdf(x: float, d1: float, d2: float, nc: float) -> float:
    """A Poisson mixture of beta functions."""
    y, total, weight = d1 * x / (d1 * x + d2), 0.0, math.exp(-nc / 2)
    for j in range(2000):
        total += weight * betainc(d1 / 2 + j, d2 / 2, y)
        weight *= nc / 2 / (j + 1)
        if j > nc / 2 and weight < 1e-16:
            break
    return total


def studentized_range_cdf(q: float, k: int, df: float) -> float:
    """P(range of k normals / s <= q), by Gauss-Legendre rules over s and the least normal."""
    if q <= 0:
        return 0.0
    z, wz = np.polynomial.legendre.leggauss(96)
    z, wz = z * 8, wz * 8
    phi, big = np.exp(-z * z / 2) / math.sqrt(2 * math.pi), np.vectorize(norm_cdf)
    cdf_z = big(z)

    def inner(w: float) -> float:
        return float((k * phi * wz * np.maximum(cdf_z - big(z - w), 0) ** (k - 1)).sum())

    if math.isinf(df) or df > 5000:
        return inner(q)
    spread = 8 / math.sqrt(2 * df)
    low, high = max(1e-6, 1 - spread), 1 + spread
    s, ws = np.polynomial.legendre.leggauss(48)
    s, ws = (high - low) / 2 * s + (high + low) / 2, ws * (high - low) / 2
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return min(1.0, sum(w * math.exp(d) * inner(q * x) for x, w, d in zip(s, ws, log_density, strict=True)))


def hypergeom_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact p value of a 2 x 2 table: all tables at most as likely."""
    r1, r2, c1 = a + b, c + d, a + c
    n = r1 + r2

    def logp(x: int) -> float:
        choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
        return choose(r1, x) + choose(r2, c1 - x) - choose(n, c1)

    low, high = max(0, c1 - r2), min(r1, c1)
    own = logp(a)
    return min(1.0, sum(math.exp(p) for x in range(low, high + 1) if (p := logp(x)) <= own + 1e-7))
