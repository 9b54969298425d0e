"""Two-sided tests computed on the driver from a handful of per-arm moments."""

from __future__ import annotations

import math

CONFIDENCE = 0.95


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 100_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return result


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(level: float, df: float) -> float:
    """Value exceeded in absolute terms with probability 1 - level."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 1 - level:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_two_sided(middle, df) > 1 - level else (low, middle)
    return (low + high) / 2


def welch(control: tuple, treatment: tuple) -> dict:
    """Unequal-variance t test from (n, mean, sample variance) per arm; treatment minus control."""
    (n0, mean0, var0), (n1, mean1, var1) = control, treatment
    difference = mean1 - mean0 if n0 and n1 else None
    result = {"control_users": n0, "treatment_users": n1, "difference": difference,
              "ci_low": None, "ci_high": None, "p_value": None}
    if min(n0, n1) < 2:
        return {**result, "status": "insufficient_users"}
    if var0 + var1 == 0:
        return {**result, "status": "no_observed_variation"}
    part0, part1 = var0 / n0, var1 / n1
    error = math.sqrt(part0 + part1)
    freedom = (part0 + part1) ** 2 / (part0 ** 2 / (n0 - 1) + part1 ** 2 / (n1 - 1))
    margin = t_quantile(CONFIDENCE, freedom) * error
    return {**result, "status": "estimated", "ci_low": difference - margin, "ci_high": difference + margin,
            "p_value": t_two_sided(difference / error, freedom)}


def balance_p_value(treated: int, total: int) -> float | None:
    """Exact two-sided binomial test of a fair split."""
    if not total:
        return None
    smaller = min(treated, total - treated)
    if 2 * smaller == total:
        return 1.0
    return min(1.0, 2 * incomplete_beta(total - smaller, smaller + 1, 0.5))
