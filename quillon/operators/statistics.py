"""Two-sample and correlation statistics as Spark aggregates, with their p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import correlation, ratio
from ..functions.pvalues import of_correlation, of_rank_sum
from .ranges import cumulated, quantile


def average_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the rank of each value of a column, tied ones sharing their mean rank. Rows without a value are left out."""
    ranks = cumulated(rows, column).select(column, (F.col("below") + (F.col("ties") + 1) / 2.0).alias(name))
    return rows.join(ranks, column)


def pearson(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(r, n, p) of the pairs with both values."""
    own = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(correlation(F.col(x), F.col(y)).alias("r"), F.count("*").alias("n"))
    return own.withColumn("p", of_correlation(F.col("r"), F.col("n")))


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, n, p) of the pairs with both values."""
    both = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_rank(average_rank(both, x, "rank_x"), y, "rank_y")
    own = ranked.agg(correlation(F.col("rank_x"), F.col("rank_y")).alias("rho"), F.count("*").alias("n"))
    return own.withColumn("p", of_correlation(F.col("rho"), F.col("n")))


def linear_fit(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept) of least squares; null when x is constant."""
    slope = F.regr_slope(F.col(y), F.col(x))
    return pairs.agg(slope.alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def median_split(pairs: DataFrame, by: str) -> DataFrame:
    """pairs with `upper`: whether a row's value is above the median of `by`."""
    return pairs.withColumn("upper", F.col(by) > F.lit(quantile(pairs, by, 0.5)).cast("double"))


def mann_whitney(rows: DataFrame, value: str, group: Column) -> DataFrame:
    """(n1, n2, u, ties, p): U of the rows where group is true against the others, and the sum of t**3 - t over ties, as a decimal, which no long holds from some ten million rows on."""
    own = rows.filter(F.col(value).isNotNull() & group.isNotNull()).select(F.col(value).alias("v"), group.alias("g"))
    ranks = average_rank(own, "v", "rank")
    t = F.col("t")
    ties = own.groupBy("v").agg(F.count("*").cast("decimal(12,0)").alias("t")).agg(F.coalesce(F.sum(t * t * t - t), F.lit(0)).cast("decimal(38,0)").alias("ties"))
    n1, n2 = F.count_if("g"), F.count_if(~F.col("g"))
    stats = ranks.agg(n1.alias("n1"), n2.alias("n2"), F.sum(F.when(F.col("g"), F.col("rank"))).alias("r1"))
    own = stats.join(F.broadcast(ties)).select("n1", "n2", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0).alias("u"), "ties")
    return own.withColumn("p", of_rank_sum(F.col("u"), F.col("n1"), F.col("n2"), F.col("ties")))


def cohen_d(rows: DataFrame, value: str, group: Column) -> DataFrame:
    """(d): difference of the means of the two groups by the root of the mean of their population variances."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    return rows.agg(ratio(F.avg(a) - F.avg(b), F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)).alias("d"))


def specialists(pairs: DataFrame, tuning: DataFrame) -> DataFrame:
    """Pairs (c1, c2, ...) with whether either channel is a specialist (kurtosis above 20) or a generalist (below 0); a pair may be both."""
    first = tuning.select(F.col("channel").alias("c1"), F.col("kurtosis").alias("k1"))
    second = tuning.select(F.col("channel").alias("c2"), F.col("kurtosis").alias("k2"))
    both = pairs.join(first, "c1", "left").join(second, "c2", "left")
    either = lambda test: F.coalesce(test("k1"), F.lit(False)) | F.coalesce(test("k2"), F.lit(False))
    return both.withColumn("specialist", either(lambda k: F.col(k) > 20)).withColumn("generalist", either(lambda k: F.col(k) < 0))
