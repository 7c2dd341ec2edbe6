"""Work in the order of a key, in ranges of about equal size: what has to be known of all rows is one bound a range."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def bounds(df: DataFrame, *keys: str, n: int | None = None) -> list:
    """The least key of each range, ascending, as rows of the keys: n ranges or as many as shuffle partitions, fewer for few rows.

    Keys of any orderable type, nulls first. Rows of one key stay in one range.
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(*keys).repartitionByRange(n, *keys).groupBy(F.spark_partition_id().alias("at")).agg(F.min(F.struct(*keys)).alias("least"))
    return [r.least for r in dealt.select("least").orderBy("least").collect()]


def as_array(df: DataFrame, found: list, *keys: str) -> Column:
    """The bounds as one constant array of structs of the keys."""
    kind = ", ".join(f"`{k}`: {df.schema[k].dataType.simpleString()}" for k in keys)
    if not found:
        return F.array().cast(f"array<struct<{kind}>>")
    return F.array(*[F.struct(*[F.lit(b[k]).cast(df.schema[k].dataType).alias(k) for k in keys]) for b in found])


def number(key: Column, array: Column, n: int) -> Column:
    """How many of the array's n ascending bounds are at most key, by binary search."""
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    if not steps:
        return F.lit(0)
    take = lambda at, step: F.when((at + step <= n) & (F.get(array, at + step - 1) <= key), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), take)


def in_ranges(df: DataFrame, *keys: str, name: str = "part", n: int | None = None) -> tuple[DataFrame, int]:
    """df with the number of each row's range, and how many ranges there are."""
    found = bounds(df, *keys, n=n)
    inner = found[1:]
    return df.withColumn(name, number(F.struct(*keys), as_array(df, inner, *keys), len(inner))), len(inner) + 1


def same_range(a: str, b: str) -> Column:
    """Whether two columns have one range's number. Not by ==, from which Spark infers that what makes the number holds for the other side too, and so has put a filter on the keys there, which that side lacks."""
    return F.col(a).eqNullSafe(F.col(b))


def cumulated(rows: DataFrame, column: str) -> DataFrame:
    """(column, ties, below) of each value that is not null: its rows, and those of all lesser values.

    Values are counted, and cut into ranges; each range is summed in its own task, from the sum of the ranges before.
    """
    counts = written(rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("ties")), "counts")
    counts, _ = in_ranges(counts, column)
    totals = counts.groupBy("part").agg(F.sum("ties").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    ahead = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    below = Window.partitionBy("part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("below", F.coalesce(F.sum("ties").over(below), F.lit(0)))
    return inside.join(F.broadcast(ahead.withColumnRenamed("part", "_p")), same_range("part", "_p")).select(column, "ties", (F.col("ahead") + F.col("below")).alias("below"))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "ahead") -> DataFrame:
    """df with the sum of value over the earlier rows of the same group, in the order (ascending, which tells a group's rows apart).

    Rows are dealt in ranges of group and order, so a hot group is summed by as many tasks as it has ranges; what passes
    between the ranges of a group is one sum each.
    """
    df, _ = in_ranges(written(df, "rows"), *by, *order, name="_part")
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    between = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("_part", *by).agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(between), F.lit(0)))
    same = reduce(and_, [same_range("_part", "_p"), *[F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]])
    sums = sums.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], "_before")
    own = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(sums, same).withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_p", "_before", "_inside", *[f"_b{i}" for i in range(len(by))])


def quantiles(rows: DataFrame, by: Sequence[str], column: str, share: float = 0.5, name: str = "quantile") -> DataFrame:
    """(by, name): the linearly interpolated quantile of each group, exact; null for groups without values.

    Equal values are counted first; the counts are summed in ranges of group and value, so no task holds all of a
    group's values.
    """
    counts = rows.groupBy(*by, column).agg(F.count("*").alias("_ties"))
    placed = running(counts.filter(F.col(column).isNotNull()), by, [column], "_ties", "_below")
    groups = rows.groupBy(*by).agg((F.lit(share) * (F.count(column) - 1)).alias("_at"))
    names = [f"_g{i}" for i in range(len(by))]
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(by, names)], F.lit(True))
    holds = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col("_ties"))
    at, low = F.col("_at"), F.floor(F.col("_at"))
    found = groups.select(*[F.col(c).alias(g) for c, g in zip(by, names)], "_at").join(placed, same, "left")
    value = lambda k: F.max(F.when(holds(k), F.col(column).cast("double")))
    ends = found.groupBy(*names, "_at").agg(value(low).alias("_a"), value(F.ceil(at)).alias("_b"))
    return ends.select(*[F.col(g).alias(c) for c, g in zip(by, names)], (F.col("_a") + (F.col("_b") - F.col("_a")) * (at - low)).alias(name))


def quantile(rows: DataFrame, column: str, share: float) -> float | None:
    """The linearly interpolated quantile of a numeric column, exact; None without values. Two values come to the driver."""
    found = written(cumulated(rows, column), "cumulated")
    n = found.agg(F.sum("ties")).first()[0]
    if not n:
        return None
    at = share * (n - 1)
    low = int(at)
    holds = lambda k: (F.col("below") <= k) & (F.lit(k) < F.col("below") + F.col("ties"))
    own = found.filter(holds(low) | holds(min(low + 1, n - 1))).select(column).orderBy(column).collect()
    a, b = float(own[0][0]), float(own[-1][0])
    return a + (b - a) * (at - low)


def median(rows: DataFrame, column: str) -> Column:
    """The median of all rows, exact, as a constant; null without values."""
    return F.lit(quantile(rows, column, 0.5)).cast("double")
