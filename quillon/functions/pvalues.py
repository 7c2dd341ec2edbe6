"""Tail probabilities of test statistics as column expressions, a value for each row; null where a statistic is null or has too few values.

Continued fractions and series are folds over a sequence as long as they need to converge.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' coefficients of the gamma function, for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
HALF_LOG_2_PI = 0.91893853320467274178


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of 0.5 or more."""
    z = x - 1.0
    series = reduce(lambda s, i: s + F.lit(LANCZOS[i]) / (z + float(i)), range(1, len(LANCZOS)), F.lit(LANCZOS[0]))
    t = z + 7.5
    return HALF_LOG_2_PI + (z + 0.5) * F.log(t) - t + F.log(series)


def _kept(x: Column) -> Column:
    """x, or a very small number in place of 0."""
    return F.when(F.abs(x) < 1e-300, 1e-300).otherwise(x)


def _fold(steps: Column, c: Column, d: Column, terms: Callable[[Column], list[tuple[Column, Column]]]) -> Column:
    """A continued fraction by Lentz's method from (c, d): for each step its (numerator, denominator) terms, one after the other."""

    def step(state: Column, i: Column) -> Column:
        up, down, out = state["c"], state["d"], state["out"]
        for numerator, denominator in terms(i.cast("double")):
            down = 1.0 / _kept(denominator + numerator * down)
            up = _kept(denominator + numerator / up)
            out = out * up * down
        return F.struct(up.alias("c"), down.alias("d"), out.alias("out"))

    start = F.struct(c.cast("double").alias("c"), d.cast("double").alias("d"), d.cast("double").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), steps.cast("int")), start, step, lambda s: s["out"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function of a, b of 0.5 or more; 0 and 1 outside of (0, 1)."""
    a, b, x = (c.cast("double") for c in (a, b, x))

    def fraction(a: Column, b: Column, x: Column) -> Column:
        def terms(m: Column) -> list[tuple[Column, Column]]:
            one = F.lit(1.0)
            return [(m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), one), (-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), one)]

        steps = F.least(F.lit(60) + F.ceil(6 * F.sqrt(F.greatest(a, b))), F.lit(100_000))
        return _fold(steps, F.lit(1.0), 1.0 / _kept(1 - (a + b) * x / (a + 1)), terms)

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    inside = F.when(x < (a + 1) / (a + b + 2), front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def normal_tails(z: Column) -> Column:
    """Probability that a standard normal variable is at least as far from 0 as z: the upper incomplete gamma function of 1/2 and z squared over 2."""
    x = z * z / 2.0
    front = F.exp(-x) * F.sqrt(x) / 1.7724538509055160273
    term = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(2.0).alias("term"), F.lit(2.0).alias("out")),
        lambda s, i: F.struct((s["term"] * x / (0.5 + i)).alias("term"), (s["out"] + s["term"] * x / (0.5 + i)).alias("out")), lambda s: s["out"],
    )
    start = x + 0.5
    far = _fold(F.lit(120), F.lit(1e300), 1.0 / start, lambda i: [(-i * (i - 0.5), start + 2 * i)])
    return F.when(x < 1.5, 1 - front * term).otherwise(front * far)


def of_correlation(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs, from Student's t with n - 2 degrees of freedom; null below three pairs."""
    df = (n - 2).cast("double")
    t2 = r * r * df / (1 - r * r)
    inside = incomplete_beta(df / 2, F.lit(0.5), df / (df + t2))
    return F.when((n < 3) | r.isNull() | F.isnan(r), F.lit(None)).when(F.abs(r) >= 1, 0.0).otherwise(inside)


def of_rank_sum(u: Column, n1: Column, n2: Column, ties: Column) -> Column:
    """Two-sided p of a Mann-Whitney U by the normal approximation, corrected for continuity and ties (ties: sum of t**3 - t); null for an empty side, 1 where all values are equal."""
    a, b = n1.cast("double"), n2.cast("double")
    n = a + b
    spread = F.sqrt(a * b / 12 * (n + 1 - ties.cast("double") / (n * (n - 1))))
    z = (F.abs(u - a * b / 2) - 0.5) / F.nullif(spread, F.lit(0.0))
    return F.when((a == 0) | (b == 0), F.lit(None)).otherwise(F.coalesce(F.least(F.lit(1.0), F.when(z <= 0, 1.0).otherwise(normal_tails(z))), F.lit(1.0)))
