"""Tail probabilities as column expressions: normal, Student's t, Kolmogorov, signed ranks.

Series and continued fractions run as folds over short sequences, so they suit
tables of test results, not rows of a panel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(first: int | Column, last: int | Column, start: Column, step, finish=None) -> Column:
    numbers = F.sequence(F.lit(first) if isinstance(first, int) else first, F.lit(last) if isinstance(last, int) else last)
    return F.aggregate(numbers, start, step, finish) if finish else F.aggregate(numbers, start, step)


def normal_two_sided(z: Column, terms: int = 80) -> Column:
    """P(|Z| >= |z|): the power series of the integral up to 3, the continued fraction of the tail beyond."""
    z = F.abs(z.cast("double"))
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    state = F.struct(z.alias("term"), z.alias("sum"))
    term = lambda s, k: s["term"] * z * z / (2 * k + 1)
    inside = _fold(1, terms, state, lambda s, k: F.struct(term(s, k).alias("term"), (s["sum"] + term(s, k)).alias("sum")), lambda s: s["sum"])
    below = _fold(1, terms, z, lambda f, k: z + (terms + 1 - k) / f)
    return F.when(z < 3, 1 - 2 * density * inside).otherwise(2 * density / below)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series after moving up by eight."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    moved = F.ln(x)
    for k in range(1, 8):
        moved = moved + F.ln(x + k)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - moved


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 400) -> Column:
    """The regularised incomplete beta function for 0 <= x <= 1, by its continued fraction on the side where that converges fast."""
    tiny = 1e-300
    kept = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def one_side(x: Column, a: Column, b: Column) -> Column:
        # the fraction from its inmost level out: f = 1 + c_k x / f
        def level(f: Column, k: Column) -> Column:
            m = (F.lit(2 * terms) - k).cast("double")
            half = F.floor(m / 2)
            even = half * (b - half) / ((a + 2 * half - 1) * (a + 2 * half))
            odd = -(a + half) * (a + b + half) / ((a + 2 * half) * (a + 2 * half + 1))
            return kept(1 + F.when(m % 2 == 0, even).otherwise(odd) * x / f)

        fraction = _fold(0, 2 * terms - 1, F.lit(1.0), level)
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x)) / a
        return front / fraction

    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    low = x < (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(low, one_side(x, a, b)).otherwise(1 - one_side(1 - x, b, a))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) with df degrees of freedom; from 100,000 on the normal tail, which differs by less than 1e-5."""
    exact = incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))
    return F.when(df >= 100_000, normal_two_sided(t)).when(df > 0, exact)


def kolmogorov_tail(x: Column, terms: int = 60) -> Column:
    """P(K >= x) of Kolmogorov's limit distribution; below 1 by the theta series that converges there."""
    x = x.cast("double")
    far = _fold(1, terms, F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    near = _fold(1, terms, F.lit(0.0), lambda s, k: s + F.exp(-(2 * k - 1) * (2 * k - 1) * (math.pi**2 / 8) / (x * x)))
    return F.when(x <= 0, 1.0).when(x < 1, 1 - math.sqrt(2 * math.pi) / x * near).otherwise(far)


def ks_two_sided(statistic: Column, n_a: Column, n_b: Column) -> Column:
    return kolmogorov_tail(statistic * F.sqrt(n_a * n_b / (n_a + n_b)))


def signed_rank_two_sided(w: Column, n: Column, most: int = 50) -> Column:
    """Exact P of a signed-rank sum at least as far from its mean as w, for n up to `most` without ties: subsets of 1 to n are counted by their sum."""
    size = most * (most + 1) // 2 + 1
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size - 1))
    ways = _fold(F.lit(1), n.cast("int"), start, lambda f, k: F.transform(f, lambda v, s: v + F.when(s >= k, F.get(f, s - k)).otherwise(0.0)))
    end = F.least(w, n * (n + 1) / 2 - w)
    tail = F.aggregate(F.slice(ways, 1, F.floor(end).cast("int") + 1), F.lit(0.0), lambda s, v: s + v) / F.pow(F.lit(2.0), n)
    return F.when((n > 0) & (n <= most), F.least(F.lit(1.0), 2 * tail))
