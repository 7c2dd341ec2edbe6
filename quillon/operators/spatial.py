"""Points with intensities: centroids, overlaps, heat maps, clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..sources.tables import written
from .linkage import ward


def summary(points: DataFrame) -> DataFrame:
    """(map_id, n, bounds, mean and greatest intensity, centroid): weighted by intensity, or plain where the weights sum to 0."""
    i = F.col("intensity")
    center = lambda c: F.coalesce(ratio(F.sum(F.col(c) * i), F.sum(i)), F.avg(c)).alias(f"center_{c}")
    bounds = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return points.groupBy("map_id").agg(F.count("*").alias("n"), F.avg(i).alias("mean_intensity"), F.max(i).alias("max_intensity"), *bounds, *[center(c) for c in "xyz"])


def above(points: DataFrame, threshold: float) -> DataFrame:
    return points.filter(F.col("intensity") >= threshold)


#: Pairs of places in a pair of cells that are compared one by one.
COMPARED = 4096


def _at(level: int, side: float, prefix: str = "") -> Column:
    """The cell of a place at a level, each of which halves the sides."""
    return F.struct(*[F.floor(F.col(prefix + c) / (side / 2**level)).cast("long").alias(c) for c in "xyz"])


def cell_pairs(points: DataFrame, others: DataFrame, radius: float, compared: int = COMPARED) -> tuple[DataFrame, DataFrame]:
    """Of two tables of distinct places: (level, cell) of cells whose points all have one of the others nearer than the radius, and (level, cell, other) of pairs of cells whose places have to be compared, at most `compared` in each.

    Cells have a diagonal under the radius. A pair of cells is decided as a whole when even its farthest corners are
    near, or its nearest ones are not; if it holds too many places, both cells are cut in eight, and so on.
    """
    side, level = radius / 1.7320509, 0
    count = lambda df, n: df.groupBy(_at(level, side).alias("cell")).agg(F.count("*").alias(n))
    a, b = written(count(points, "n"), "cells"), written(count(others, "m").withColumnRenamed("cell", "other"), "cells")
    around = a
    for c in "xyz":
        around = around.withColumn(f"s{c}", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    pairs = around.withColumn("other", F.struct(*[(F.col(f"cell.{c}") + F.col(f"s{c}")).alias(c) for c in "xyz"])).select("cell", "other", "n").join(b, "other")
    near, leaves = [], []
    while True:
        unit = side / 2**level
        gap = [F.abs(F.col(f"cell.{c}") - F.col(f"other.{c}")) for c in "xyz"]
        farthest, nearest = (F.sqrt(sum(F.pow(F.greatest(g + s, F.lit(0)) * unit, F.lit(2.0)) for g in gap)) for s in (1, -1))
        # a margin for rounding: what is within it is compared
        pairs = written(pairs.withColumn("whole", farthest < radius * (1 - 1e-9)).filter(nearest < radius * (1 + 1e-9)), "pairs")
        own = pairs.filter("whole").select("cell").distinct()
        near.append(own.withColumn("level", F.lit(level)))
        open_ = pairs.filter("not whole").join(own, "cell", "left_anti")
        few = F.col("n") * F.col("m") <= compared
        leaves.append(open_.filter(few).select("cell", "other", F.lit(level).alias("level")))
        large = open_.filter(~few).select("cell", "other")
        if large.isEmpty():
            break
        level += 1
        up = lambda c: F.struct(*[F.floor(F.col(f"{c}.{x}") / 2).cast("long").alias(x) for x in "xyz"])
        a, b = count(points, "n").withColumn("up", up("cell")), count(others, "m").withColumnRenamed("cell", "other").withColumn("uo", up("other"))
        pairs = large.toDF("up", "uo").join(a, "up").join(b, "uo").select("cell", "other", "n", "m")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return written(union(near), "near"), written(union(leaves), "leaves")


def overlap(points: DataFrame, others: DataFrame, radius: float = 1000.0, compared: int = COMPARED) -> DataFrame:
    """One row: points, those with one of the others nearer than the radius, and their share (0 for no points)."""
    place = lambda df: df.select(*[F.col(c).cast("double").alias(c) for c in "xyz"])
    own = written(place(points).groupBy("x", "y", "z").agg(F.count("*").alias("times")), "places")
    far = written(place(others).distinct(), "places")
    near, leaves = cell_pairs(own, far, radius, compared)
    levels = [r.level for r in leaves.select("level").union(near.select("level")).distinct().collect()]
    side = radius / 1.7320509
    met = []
    for k in levels:
        at = own.withColumn("cell", _at(k, side))
        met.append(at.join(near.filter(F.col("level") == k), "cell", "left_semi").select("x", "y", "z"))
        theirs = far.select(_at(k, side).alias("other"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
        d2 = sum(F.pow(F.col(c) - F.col(f"o{c}"), F.lit(2.0)) for c in "xyz")
        met.append(at.join(leaves.filter(F.col("level") == k).drop("level"), "cell").join(theirs, "other").filter(d2 < radius * radius).select("x", "y", "z"))
    found = reduce(DataFrame.union, met).distinct() if met else own.select("x", "y", "z").limit(0)
    n_near = own.join(found, ["x", "y", "z"], "left_semi").agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n_near"))
    counts = points.agg(F.count("*").alias("n")).join(F.broadcast(n_near))
    return counts.select("n", "n_near", F.coalesce(ratio(F.col("n_near") * 1.0, F.col("n")), F.lit(0.0)).alias("overlap"))


PLANES = (("x", "y"), ("x", "z"), ("y", "z"))


def projections(points: DataFrame, bins: int = 50) -> DataFrame:
    """(plane, bin_a, bin_b, mean_intensity, n): the heat maps of all three planes, with every cell; 0 where there are no points."""
    parts = [heat_map(points, a, b, bins, whole=True).select(F.lit(a + b).alias("plane"), "*") for a, b in PLANES]
    return reduce(DataFrame.unionByName, parts)


def heat_map(points: DataFrame, a: str = "x", b: str = "y", bins: int = 50, whole: bool = False) -> DataFrame:
    """(bin_a, bin_b, mean_intensity, n) of the cells with points, or with whole of all cells, 0 where there are none; equal bins over the data's range, the last closed on the right."""
    range_ = points.agg(*[f(c).alias(f"{n}_{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))])

    def bin_(c):
        at = F.floor((F.col(c) - F.col(f"lo_{c}")) * bins / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)))
        return F.least(F.coalesce(at, F.lit(bins // 2)), F.lit(bins - 1)).cast("int").alias(f"bin_{c}")

    own = points.join(F.broadcast(range_)).select(bin_(a), bin_(b), "intensity")
    found = own.groupBy(F.col(f"bin_{a}").alias("bin_a"), F.col(f"bin_{b}").alias("bin_b")).agg(F.avg("intensity").alias("mean_intensity"), F.count("*").alias("n"))
    if not whole:
        return found
    i = F.col("id")
    every = points.sparkSession.range(bins * bins).select((i % bins).cast("int").alias("bin_a"), F.floor(i / bins).cast("int").alias("bin_b"))
    return every.join(found, ["bin_a", "bin_b"], "left").select("bin_a", "bin_b", F.coalesce("mean_intensity", F.lit(0.0)).alias("mean_intensity"), F.coalesce("n", F.lit(0)).alias("n"))


METHODS = ("kmeans", "hierarchical")


def clusters(points: DataFrame, k: int, method: str = "kmeans", seed: int = 42) -> DataFrame:
    """points with their cluster: by k-means, or by merging bottom up with Ward's linkage."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    if method == "hierarchical":
        return ward(points, k)
    if points.isEmpty():
        return points.withColumn("cluster", F.lit(None).cast("int"))
    placed = VectorAssembler(inputCols=["x", "y", "z"], outputCol="at").transform(points)
    return KMeans(k=k, seed=seed, featuresCol="at", predictionCol="cluster").fit(placed).transform(placed).drop("at")
