"""Beta quantiles at large counts, beside sums of binomial terms."""

import math
from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from binweave.functions import intervals

TAIL = 0.5 * math.erfc(math.sqrt(0.5))


def binomial_upper_tail(s: int, n: int, p: float) -> float:
    """P(at least s of n), term by term from s on, downwards if the mean lies above."""
    k = np.arange(0, int(12 * math.sqrt(n * p * (1 - p))) + 200, dtype=float)
    first = s * math.log(p) + (n - s) * math.log1p(-p) + math.lgamma(n + 1) - math.lgamma(s + 1) - math.lgamma(n - s + 1)
    ratio = np.where(s + k < n, (n - s - k) / (s + k + 1) * p / (1 - p), 0.0)
    return math.exp(first) * (1 + np.cumprod(ratio).sum())


def test_against_exact_binomials():
    getcontext().prec = 60
    for s, f in ((3000, 7000), (1, 9999), (9990, 10), (5000, 5000)):
        n = s + f
        low, high = intervals.clopper_pearson_of(s, f)
        for p, count, want in ((low, s, TAIL), (high, s + 1, 1 - TAIL)):
            q = Decimal(p)
            term = Decimal(math.comb(n, count)) * q**count * (1 - q) ** (n - count)
            total, k = Decimal(0), count
            while k <= n and (term > total * Decimal(10) ** -45 or k < n * p):
                total += term
                term *= Decimal(n - k) / Decimal(k + 1) * q / (1 - q)
                k += 1
            deviation = math.sqrt(p * (1 - p) / n)
            assert float(total) == pytest.approx(want, rel=1e-9 * p / deviation + 1e-11)


def test_large_counts():
    """The ends stand z deviations from the mean; corrections are Edgeworth's, whose next terms are below 1e-9 of the value here."""
    z = 1.0
    for n in (10**8, 10**10, 10**12):
        for share in (0.5, 0.2, 0.97):
            s = round(n * share)
            f = n - s
            a, b = s + 0.5, f + 0.5
            m, v = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
            skew = 2 * (b - a) * math.sqrt(a + b + 1) / ((a + b + 2) * math.sqrt(a * b))
            low, high = intervals.jeffreys_of(s, f, z)
            for got, u in ((low, -z), (high, z)):
                assert got == pytest.approx(m + math.sqrt(v) * (u + (u * u - 1) * skew / 6), rel=1e-9)
    assert intervals.jeffreys_of(1e10, 1e10)[0] == pytest.approx(0.5 - 0.5 / math.sqrt(2e10), rel=1e-9)
    assert binomial_upper_tail(30_000, 100_000, intervals.clopper_pearson_of(30_000, 70_000)[0]) == pytest.approx(TAIL, rel=1e-7)


def test_few_among_very_many():
    """As n grows, n times the ends tends to the ends for a Poisson count: gamma quantiles."""
    for s in (1, 3, 40):
        low, high = intervals.clopper_pearson_of(s, 10**12 - s)
        below = lambda k, x: math.fsum(math.exp(-x + j * math.log(x) - math.lgamma(j + 1)) for j in range(k))
        assert 1 - below(s, low * 1e12) == pytest.approx(TAIL, rel=1e-8)
        assert below(s + 1, high * 1e12) == pytest.approx(TAIL, rel=1e-8)
        other = intervals.clopper_pearson_of(10**12 - s, s)
        assert other[1] == pytest.approx(1 - low, abs=2e-16) and other[0] == pytest.approx(1 - high, abs=2e-16)


def test_methods_meet():
    """The continued fraction and the integral give the same tails where one takes over from the other."""
    rng = np.random.default_rng(1)
    a, b = rng.uniform(2000, 4000, 200), rng.uniform(2000, 40000, 200)
    x = a / (a + b) - rng.uniform(0, 4, 200) * np.sqrt(a * b / (a + b) ** 3)
    assert intervals._integrated_tail(x, 1 - x, a, b) == pytest.approx(intervals._fraction_tail(x, 1 - x, a, b), rel=1e-10)


def test_whole_batches(spark):
    rows = spark.range(3000).select((F.col("id") * F.col("id") * 1000).cast("double").alias("s"), (F.col("id") % 11).cast("double").alias("f"))
    got = rows.select("s", "f", *(c.alias(n) for c, n in zip(intervals.clopper_pearson(F.col("s"), F.col("f")), ("low", "high")))).toPandas()
    ok = got[(got.s > 0) | (got.f > 0)]
    assert ((ok.low <= ok.s / (ok.s + ok.f)) & (ok.s / (ok.s + ok.f) <= ok.high) & (ok.low >= 0) & (ok.high <= 1)).all()
    assert got[(got.s == 0) & (got.f == 0)].low.isna().all()
