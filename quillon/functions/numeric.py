"""Column expressions for numbers: coercion, dose curves, tuning classes, moments that skip what is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of excess kurtosis for each tuning class, broadest last; least number of responses.
TUNING_CLASSES = ((40.0, "very_narrow"), (20.0, "narrow"), (0.0, "moderate"), (-10.0, "broad"))
LEAST_RESPONSES = 4


def number(c: Column) -> Column:
    """A number, or null for what is none: text, NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def tuning_kurtosis(x: Column) -> Column:
    """Excess kurtosis of at least four responses; null for fewer, and for equal ones."""
    return F.when(F.count(x) >= LEAST_RESPONSES, F.kurtosis(x))


def tuning_class(kurtosis: Column) -> Column:
    """Class of an excess kurtosis; a missing one is very broad."""
    out = F.lit("very_broad")
    for bound, name in reversed(TUNING_CLASSES):
        out = F.when(kurtosis > bound, name).otherwise(out)
    return out


def hill(c: Column, r_max: Column | float, ec50: Column | float, n: Column | float, base: Column | float = 0.0) -> Column:
    """Hill curve: base + r_max * c**n / (ec50**n + c**n)."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    top = F.pow(c, lit(n))
    return lit(base) + lit(r_max) * top / (F.pow(lit(ec50), lit(n)) + top)


def logspace(low: float, high: float, n: int) -> Column:
    """n numbers from low to high at equal steps of their logarithm."""
    step = 0.0 if n < 2 else 1.0 / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pow(F.lit(10.0), F.log10(F.lit(low)) + (F.log10(F.lit(high)) - F.log10(F.lit(low))) * i * F.lit(step)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows with both; null for fewer than two, or for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count(a) > 1, F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def edge_width(w: Column) -> Column:
    """Width of a drawn edge."""
    return F.log1p(w) * 0.5


def subnetwork_edge_width(w: Column) -> Column:
    return F.lit(0.5) + F.lit(3.0) * F.log10(w + 1)
