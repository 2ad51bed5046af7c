"""Confidence intervals of a binomial proportion: as columns, and for the beta quantiles as an Arrow UDF over whole batches of cells."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence_level(deviation: float) -> float:
    """Two-sided confidence level of a number of standard deviations."""
    if not deviation > 0:
        raise ValueError("a deviation is positive")
    return math.erf(deviation / math.sqrt(2))


def deviation(level: float) -> float:
    if not 0 < level < 1:
        raise ValueError("a confidence level lies between 0 and 1")
    return NormalDist().inv_cdf((1 + level) / 2)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def erf_inv(x: float) -> float:
    return NormalDist().inv_cdf((x + 1) / 2) / math.sqrt(2)


def _guard(n: Column, value: Column) -> Column:
    return F.when(n > 0, value).otherwise(F.lit(float("nan")))


def wilson(successes: Column, failures: Column, z: float = 1.0) -> tuple[Column, Column]:
    s, f = successes.cast("double"), failures.cast("double")
    n = s + f
    half = F.lit(0.5 * z * z)
    a = (s + half) / (n + 2 * half)
    b = F.lit(z) / (n + 2 * half) * F.sqrt(F.when(n > 0, s * f / F.when(n > 0, n)).otherwise(0.0) + 0.5 * half)
    return _guard(n, a - b), _guard(n, a + b)


def wald(successes: Column, failures: Column, z: float = 1.0) -> tuple[Column, Column]:
    s, f = successes.cast("double"), failures.cast("double")
    n = F.when(s + f > 0, s + f)
    a, b = s / n, F.lit(z) / n * F.sqrt(s * f / n)
    return _guard(s + f, a - b), _guard(s + f, a + b)


# --- the beta distribution, for arguments of any size, over whole arrays

_LGAMMA = np.frompyfunc(math.lgamma, 1, 1)
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)
LARGE = 2000.0  # from here on for both arguments the density is integrated; below, the continued fraction ends soon
STEPS = 20_000


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """lgamma(n) less Stirling's formula for it."""
    out = np.empty_like(n)
    small = n < 20
    x = n[small]
    out[small] = _LGAMMA(x).astype(float) - ((x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi))
    x = n[~small]
    y = 1 / (x * x)
    out[~small] = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x
    return out


def _log1p_less(x: np.ndarray) -> np.ndarray:
    """log(1 + x) - x, also near 0."""
    with np.errstate(divide="ignore"):
        out = np.log1p(x) - x
    near = np.abs(x) < 0.05
    y, total, power = x[near], 0.0, x[near]
    for k in range(2, 14):
        power = power * -y
        total = total + power / k
    out[near] = total
    return out


def _log_density(x: np.ndarray, rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of x**a rest**b / B(a, b), rest = 1 - x, without differences of large logarithms."""
    d = np.where(x < 0.5, a - (a + b) * x, (a + b) * rest - b)
    far = a * _log1p_less(-d / a) + b * _log1p_less(d / b)
    return far + _stirling_error(a + b) - _stirling_error(a) - _stirling_error(b) + 0.5 * (np.log(a) + np.log(b / (a + b)) - math.log(2 * math.pi))


def _fraction_tail(x: np.ndarray, rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lower tail below the mean by Lentz's continued fraction; it goes on until every element has converged."""
    tiny = 1e-300
    c, d, out = np.ones_like(x), np.zeros_like(x), np.ones_like(x)
    todo = np.arange(len(x))
    for i in range(STEPS):
        m = i // 2
        u, v, w = x[todo], a[todo], b[todo]
        term = 1.0 if i == 0 else m * (w - m) * u / ((v + 2 * m - 1) * (v + 2 * m)) if i % 2 == 0 else -(v + m) * (v + w + m) * u / ((v + 2 * m) * (v + 2 * m + 1))
        under, over = 1 + term * d[todo], 1 + term / c[todo]
        d[todo] = 1 / np.where(under == 0, tiny, under)
        c[todo] = np.where(over == 0, tiny, over)
        change = c[todo] * d[todo]
        out[todo] *= change
        if i > 1:
            todo = todo[np.abs(change - 1) > 4e-16]
        if not len(todo):
            return np.exp(_log_density(x, rest, a, b)) / a * (out - 1)
    raise ArithmeticError("the incomplete beta function did not converge")


def _integrated_tail(x: np.ndarray, rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lower tail of a beta distribution of large arguments, panel by panel from x downwards."""
    deviation = np.sqrt(a / (a + b) * (b / (a + b)) / (a + b))
    total = np.zeros_like(x)
    for panel in range(24):
        back = (panel * 0.5 * deviation)[:, None] + (0.25 * deviation)[:, None] * (1 - _NODES)
        back = np.where(back < x[:, None], back, 0.0)
        t, u = x[:, None] - back, rest[:, None] + back
        wide = lambda v: np.broadcast_to(v[:, None], t.shape).ravel()
        f = np.exp(_log_density(t.ravel(), u.ravel(), wide(a), wide(b)).reshape(t.shape)) / (t * u)
        total += 0.25 * deviation * (np.where(back > 0, f, 0.0) @ _WEIGHTS)
    return total


def _lower_tail(x: np.ndarray, rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of one distribution per element."""
    out, large = np.empty_like(x), np.minimum(a, b) >= LARGE
    for part, tail in ((large, _integrated_tail), (~large, _fraction_tail)):
        if part.any():
            out[part] = tail(x[part], rest[part], a[part], b[part])
    return out


def _tails(x: np.ndarray, rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper tail; x and rest = 1 - x lie between 0 and 1.

    The smaller tail is computed, but beside an end the tail there: the fraction loses what 1 - x has lost where x is almost 1.
    """
    small = 1e-3
    below = np.where(np.minimum(a, b) >= LARGE, x <= a / (a + b), np.where(x < small, True, np.where(rest < small, False, x <= (a + 0.5) / (a + b + 1))))
    tail = np.empty_like(x)
    for part, of in ((below, (x, rest, a, b)), (~below, (rest, x, b, a))):
        if part.any():
            tail[part] = _lower_tail(*(v[part] for v in of))
    return np.where(below, tail, 1 - tail), np.where(below, 1 - tail, tail)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    return float(x >= 1) if x <= 0 or x >= 1 else float(_tails(*(np.array([float(v)]) for v in (x, 1 - x, a, b)))[0][0])


def beta_quantiles(p, a, b) -> np.ndarray:
    """Newton's steps in the log odds, halving where a step leaves what is known to hold the quantile; until a step changes the odds by less than 1e-12 of them (the next would by far less)."""
    p, a, b = (np.array(v, float, ndmin=1) for v in np.broadcast_arrays(p, a, b))
    low, high = np.full_like(p, -740.0), np.full_like(p, 740.0)
    y = np.clip(np.log(a / b), -700, 700)
    todo = np.arange(len(p))
    for _ in range(400):
        u, v, w, q = y[todo], a[todo], b[todo], p[todo]
        x, rest = 1 / (1 + np.exp(-u)), 1 / (1 + np.exp(u))
        lower, upper = _tails(x, rest, v, w)
        error = np.where(q < 0.5, lower - q, (1 - q) - upper)
        low[todo], high[todo] = np.where(error < 0, u, low[todo]), np.where(error < 0, high[todo], u)
        with np.errstate(all="ignore"):
            step = error / np.exp(_log_density(x, rest, v, w))
            new = u - step
        good = np.isfinite(new) & (new >= low[todo]) & (new <= high[todo])
        new = np.where(good, new, 0.5 * (low[todo] + high[todo]))
        y[todo] = new
        todo = todo[(np.abs(new - u) > 1e-12) & (error != 0)]
        if not len(todo):
            return 1 / (1 + np.exp(-y))
    raise ArithmeticError("a quantile did not converge")


def beta_quantile(p: float, a: float, b: float) -> float:
    return float(beta_quantiles(p, a, b)[0])


def _ends(s, f, z: float, low: tuple, high: tuple, low_ok, high_ok) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of beta(*low) and beta(*high) where they are wanted; the exact ends where there are no successes or no failures."""
    s, f = (np.array(v, float, ndmin=1) for v in (s, f))
    tail = 0.5 * (1 - confidence_level(z))
    lower, upper = np.full_like(s, np.nan), np.full_like(s, np.nan)
    some = (s >= 0) & (f >= 0) & (s + f > 0) & np.isfinite(s + f)
    none, all_ = some & (s == 0), some & (f == 0)
    lower[none], upper[none] = 0.0, -np.expm1(math.log(tail) / f[none])
    lower[all_], upper[all_] = np.exp(math.log(tail) / s[all_]), 1.0
    both = some & (s > 0) & (f > 0)
    lower[both], upper[both] = 0.0, 1.0
    for out, p, add, wanted in ((lower, tail, low, both & low_ok(s)), (upper, 1 - tail, high, both & high_ok(f))):
        if wanted.any():
            out[wanted] = beta_quantiles(p, s[wanted] + add[0], f[wanted] + add[1])
    return lower, upper


def clopper_pearson_arrays(s, f, z: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    always = lambda v: v > 0
    return _ends(s, f, z, (0, 1), (1, 0), always, always)


def jeffreys_arrays(s, f, z: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Modified at the ends, where the plain interval covers badly."""
    return _ends(s, f, z, (0.5, 0.5), (0.5, 0.5), lambda v: v != 1, lambda v: v != 1)


def clopper_pearson_of(s: float, f: float, z: float = 1.0) -> tuple[float, float]:
    return tuple(float(v[0]) for v in clopper_pearson_arrays(s, f, z))


def jeffreys_of(s: float, f: float, z: float = 1.0) -> tuple[float, float]:
    return tuple(float(v[0]) for v in jeffreys_arrays(s, f, z))


def _udf(of):
    def columns(successes: Column, failures: Column, z: float = 1.0) -> tuple[Column, Column]:
        @F.pandas_udf("lower double, upper double")
        def run(s: pd.Series, f: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(dict(zip(("lower", "upper"), of(s.to_numpy(float), f.to_numpy(float), z))))

        both = run(successes.cast("double"), failures.cast("double"))
        return both["lower"], both["upper"]

    columns.__doc__ = of.__doc__
    return columns


clopper_pearson = _udf(clopper_pearson_arrays)
jeffreys = _udf(jeffreys_arrays)
