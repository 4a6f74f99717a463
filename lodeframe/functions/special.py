"""Tail probabilities of the usual test distributions; called once per test result, on the driver."""

from __future__ import annotations

import math

from statistics import NormalDist

_NORMAL = NormalDist()


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    value = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        value *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return scale * value


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    if f <= 0.0:
        return 1.0
    return beta_cdf(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2.0, x / 2.0)


def kolmogorov_tail(x: float) -> float:
    """Limit law of sqrt(n) times the largest distance."""
    if x <= 0.0:
        return 1.0
    if x < 1.18:
        y = math.exp(-math.pi**2 / (8.0 * x * x))
        return 1.0 - math.sqrt(2.0 * math.pi) / x * (y + y**9 + y**25 + y**49)
    y = math.exp(-2.0 * x * x)
    return 2.0 * (y - y**4 + y**9)


def correlation_p(r: float | None, n: int) -> float | None:
    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)
