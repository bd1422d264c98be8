"""Tail probabilities on the driver: normal, chi-square, t, F and the studentized range, in plain Python and numpy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return -math.inf if p <= 0 else math.inf if p >= 1 else _NORMAL.inv_cdf(p)


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def _beta_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction, on the side where that converges."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_reg(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if x <= 0 or df <= 0 else _gamma_upper(df / 2, x / 2)


def t_sf(x: float, df: float) -> float:
    if math.isinf(df):
        return norm_sf(x)
    half = 0.5 * _beta_reg(df / 2, 0.5, df / (df + x * x))
    return half if x >= 0 else 1 - half


def t_two_sided(x: float, df: float) -> float:
    return min(1.0, 2 * t_sf(abs(x), df))


def f_sf(x: float, df1: float, df2: float) -> float:
    if x <= 0:
        return 1.0
    return chi2_sf(x * df1, df1) if math.isinf(df2) else _beta_reg(df2 / 2, df1 / 2, df2 / (df2 + df1 * x))


def t_ppf(p: float, df: float) -> float:
    """Quantile by bisection on the tail."""
    if math.isinf(df):
        return norm_ppf(p)
    if p < 0.5:
        return -t_ppf(1 - p, df)
    lo, hi = 0.0, 2.0
    while t_sf(hi, df) > 1 - p and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf(mid, df) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def studentized_range_sf(q: float, groups: int, df: float) -> float:
    """P(range / s > q): Gauss-Legendre over the normal range probability, then over the chi density of s."""
    if q <= 0:
        return 1.0
    x, w = np.polynomial.legendre.leggauss(96)
    erf = np.vectorize(math.erf)

    def below(width: float) -> float:
        z, wz = 8.5 * x, 8.5 * w
        cdf = 0.5 * (erf(z / math.sqrt(2)) - erf((z - width) / math.sqrt(2)))
        return float(groups * np.sum(wz * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * np.clip(cdf, 0, 1) ** (groups - 1)))

    if math.isinf(df):
        return max(0.0, 1 - below(q))
    spread = 9 / math.sqrt(2 * df)
    lo, hi = max(1e-8, 1 - spread), 1 + spread + 2 / df
    s, ws = (hi - lo) / 2 * x + (hi + lo) / 2, (hi - lo) / 2 * w
    log_density = df / 2 * math.log(df / 2) + math.log(2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    density = np.exp(log_density) * ws
    return float(min(1.0, max(0.0, 1 - np.sum(density * np.array([below(q * v) for v in s])) / density.sum())))


def adjust(p: list[float], method: str = "none") -> list[float]:
    """Multiple-testing adjustment: none, bonferroni, holm or fdr (also "bh")."""
    m = len(p)
    order = sorted(range(m), key=lambda i: p[i])
    out = list(p)
    if method == "bonferroni":
        out = [min(1.0, m * x) for x in p]
    elif method == "holm":
        worst = 0.0
        for rank, i in enumerate(order):
            worst = max(worst, min(1.0, (m - rank) * p[i]))
            out[i] = worst
    elif method in ("fdr", "bh"):
        best = 1.0
        for rank in range(m, 0, -1):
            i = order[rank - 1]
            best = min(best, m * p[i] / rank)
            out[i] = best
    elif method != "none":
        raise ValueError(f"unknown adjustment {method!r}")
    return out


def wilson(successes: int, trials: int, level: float = 0.95) -> tuple[float, float]:
    """Score interval of a proportion."""
    if trials <= 0:
        return math.nan, math.nan
    z = norm_ppf(0.5 + level / 2)
    p, shrink = successes / trials, 1 + z * z / trials
    middle = (p + z * z / (2 * trials)) / shrink
    half = z / shrink * math.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    return max(0.0, middle - half), min(1.0, middle + half)
