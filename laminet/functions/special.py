"""Special functions in plain Python and NumPy, and Arrow functions over columns."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Tables of a probability within this factor of the observed one's count as as extreme.
FISHER_SLACK = 1 + 1e-7


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_exact(a: int, b: int, c: int, d: int, alternative: str = "two-sided") -> float:
    """p-value of the table [[a, b], [c, d]]. Tables of the same margins grow likelier up to the mode and less likely after it, so the sums
    run from where they are largest outwards, until what is left is below the precision."""
    row, col, n = a + b, a + c, a + b + c + d
    low, high = max(0, row + col - n), min(row, col)
    mode = max(low, min(high, (row + 1) * (col + 1) // (n + 2)))

    def log_p(x: int) -> float:
        return log_choose(col, x) + log_choose(n - col, row - x) - log_choose(n, row)

    def down(x: int) -> float:
        """All up to x, which is at most the mode."""
        total = p = math.exp(log_p(x)) if x >= low else 0.0
        while x > low and p > total * 1e-18:
            p *= x * (n - row - col + x) / ((row - x + 1) * (col - x + 1))
            total += p
            x -= 1
        return total

    def up(x: int) -> float:
        """All from x on, which is at least the mode."""
        total = p = math.exp(log_p(x)) if x <= high else 0.0
        while x < high and p > total * 1e-18:
            p *= (row - x) * (col - x) / ((x + 1) * (n - row - col + x + 1))
            total += p
            x += 1
        return total

    if alternative == "greater":
        return min(1.0, up(a) if a > mode else 1 - down(a - 1))
    if alternative == "less":
        return min(1.0, down(a) if a < mode else 1 - up(a + 1))
    most = log_p(a) + math.log(FISHER_SLACK)
    # The last at the left and the first at the right that count; a table lies between them unless all count.
    left, right = low - 1, mode
    while left < right - 1:
        x = (left + right) // 2
        left, right = (x, right) if log_p(x) <= most else (left, x)
    first, last = mode, high + 1
    if log_p(mode) <= most:
        return 1.0
    while first < last - 1:
        x = (first + last) // 2
        first, last = (x, last) if log_p(x) > most else (first, x)
    return min(1.0, down(left) + up(last))


@lru_cache(1 << 16)
def _fisher(a: int, b: int, c: int, d: int, alternative: str) -> float:
    """Rare terms share few tables."""
    return fisher_exact(a, b, c, d, alternative)


def fisher_column(alternative: str = "two-sided"):
    """An Arrow function of four count columns."""

    @F.pandas_udf("double")
    def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_fisher(w, x, y, z, alternative) for w, x, y, z in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())], dtype="float64")

    return fisher


def zeta(s: float, q: float = 1.0, terms: int = 20) -> float:
    """Hurwitz zeta by the Euler-Maclaurin sum."""
    total = sum((q + k) ** -s for k in range(terms))
    x = q + terms
    total += x ** (1 - s) / (s - 1) + 0.5 * x**-s
    bernoulli = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)
    rising, factorial = s, 2.0
    power = x ** (-s - 1)
    for k, b in enumerate(bernoulli, 1):
        total += b / factorial * rising * power
        rising *= (s + 2 * k - 1) * (s + 2 * k)
        factorial *= (2 * k + 1) * (2 * k + 2)
        power /= x * x
    return total


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_sf(x: float, k: float = 1) -> float:
    return gamma_q(k / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def nelder_mead(f, start: list[float], step: float = 0.1, rounds: int = 400, tolerance: float = 1e-10) -> list[float]:
    """Least point of f found by a simplex."""
    n = len(start)
    points = [list(start)] + [[v + (step * abs(v) + step) * (i == j) for j, v in enumerate(start)] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = sorted(range(n + 1), key=values.__getitem__)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance):
            break
        centre = np.mean(points[:-1], axis=0)
        at = lambda t, worst=np.array(points[-1]), c=centre: list(c + t * (worst - c))
        reflected = at(-1.0)
        fr = f(reflected)
        if fr < values[0]:
            wide = at(-2.0)
            fw = f(wide)
            points[-1], values[-1] = (wide, fw) if fw < fr else (reflected, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = reflected, fr
        else:
            near = at(0.5 if fr >= values[-1] else -0.5)
            fn = f(near)
            if fn < min(fr, values[-1]):
                points[-1], values[-1] = near, fn
            else:
                points = [points[0]] + [list((np.array(p) + points[0]) / 2) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]
