"""Agglomerative clusters of points by Ward's linkage, in rounds over written tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .graph import components

#: Clusters that merge in one task, and clusters in a grid cell when the grid begins.
SMALL, CROWD = 1000, 64
AXES = ("x", "y", "z")


def _cells(side: Column) -> list[Column]:
    return [F.floor(F.col(c) / side).cast("long").alias(f"c{c}") for c in AXES]


def _first_side(clusters: DataFrame, crowd: int) -> float:
    """A grid's side with which no cell holds more than `crowd` of the clusters."""
    box = clusters.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in AXES]).first()
    side = max(box.x, box.y, box.z) / max(1.0, box.n ** (1 / 3)) or 1.0
    while clusters.groupBy(*_cells(F.lit(side))).count().agg(F.max("count")).first()[0] > crowd:
        side /= 2
    return side


def near(clusters: DataFrame, limit: float) -> DataFrame:
    """(id, other, height): pairs of clusters whose merge costs at most limit, in both orders.

    The cost is n m / (n + m) times the squared distance of the centres. So the smaller of two, of 2**s to 2**(s + 1)
    points, has its partner within the root of 2 limit / 2**s, and looks around itself in a grid of that side, in which
    all clusters of at least its size are.
    """
    sized = clusters.withColumn("s", F.floor(F.log2("n")).cast("int"))
    side = F.sqrt(2 * F.lit(limit) / F.pow(F.lit(2.0), F.col("level")))
    on = ["level", *(f"c{c}" for c in AXES)]
    own = sized.withColumn("level", F.col("s")).select("*", *_cells(side))
    for c in AXES:
        own = own.withColumn("step", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"c{c}", F.col(f"c{c}") + F.col("step")).drop("step")
    others = sized.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("s")))).select("*", *_cells(side))
    a = own.select(*on, "id", "n", *AXES)
    b = others.select(*on, F.col("id").alias("other"), F.col("n").alias("m"), *[F.col(c).alias(f"o{c}") for c in AXES])
    d2 = reduce(lambda s, c: s + (F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")), AXES, F.lit(0.0))
    pairs = a.join(b.hint("merge"), on).filter("id != other").withColumn("height", F.col("n") * F.col("m") / (F.col("n") + F.col("m")) * d2)
    pairs = pairs.filter(F.col("height") <= limit).select("id", "other", "height")
    return pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"), "height")).distinct()


def last_merges(clusters: DataFrame) -> DataFrame:
    """(keep, gone, height) of all merges of a bounded number of clusters, in one task: the cheapest first, the costs of a new cluster by those of its parts."""
    names = [f"{c}{k}" for k in (1, 2) for c in AXES]
    ddl = ", ".join(f"{c} double" for c in [*names, "height"])

    def run(table: pa.Table) -> pa.Table:
        rows = np.array([table.column(c).to_numpy() for c in (*AXES, *("i" + c for c in AXES), "n")], float).T
        rows = rows[np.lexsort(rows[:, 5:2:-1].T)]  # in the order of their names
        n, ids = rows[:, 6].copy(), rows[:, 3:6]
        d2 = ((rows[:, None, :3] - rows[None, :, :3]) ** 2).sum(axis=2)
        cost = n[:, None] * n[None, :] / (n[:, None] + n[None, :]) * d2
        np.fill_diagonal(cost, np.inf)
        out = []
        for _ in range(len(n) - 1):
            a, b = divmod(int(cost.argmin()), len(n))
            out.append([*ids[a], *ids[b], cost[a, b]])
            new = ((n[a] + n) * cost[a] + (n[b] + n) * cost[b] - n * cost[a, b]) / (n[a] + n[b] + n)
            n[a] += n[b]
            cost[a], cost[:, a], cost[b], cost[:, b] = new, new, np.inf, np.inf
            cost[a, [a, b]] = cost[[a, b], a] = np.inf
        return pa.table([pa.array(c, pa.float64()) for c in np.array(out, float).reshape(-1, 7).T], names=[*names, "height"])

    own = clusters.select(F.lit(0).alias("all"), *AXES, *[F.col(f"id.{c}").alias(f"i{c}") for c in AXES], "n")
    named = lambda k: F.struct(*[F.col(f"{c}{k}").alias(c) for c in AXES])
    return own.groupBy("all").applyInArrow(run, ddl).select(named(1).alias("keep"), named(2).alias("gone"), "height")


def merges(clusters: DataFrame, k: int, small: int = SMALL, crowd: int = CROWD) -> tuple[DataFrame | None, int]:
    """(keep, gone, height) of all merges up to a height at which at most k clusters are left, and how many are left.

    Ward's cost never falls when others merge, so pairs that are each other's best partner may merge at once, in any
    order, and give the same tree. Only merges below a limit are looked for, which grows fourfold when there are none.
    The last `small` clusters merge in one task. Joins are of sides that grow with the clusters, and shuffle both: what
    is broadcast goes over the driver, each round anew.
    """
    left, done, limit = clusters.count(), None, None
    while left > 1:
        if left <= small:
            new = written(last_merges(clusters), "merges")
            return new if done is None else done.unionByName(new), 1
        limit = _first_side(clusters, crowd) ** 2 / 2 if limit is None else limit
        order = F.struct("height", F.least("id", "other"), F.greatest("id", "other"))
        best = written(near(clusters, limit).groupBy("id").agg(F.min_by(F.struct("other", "height"), order).alias("best")).select("id", "best.*"), "best")
        both = best.join(best.select(F.col("other").alias("id"), F.col("id").alias("other")).hint("merge"), ["id", "other"], "left_semi").filter("id < other")
        new = written(both.select(F.col("id").alias("keep"), F.col("other").alias("gone"), "height"), "merges")
        n = new.count()
        if not n:
            if left <= k:
                break
            limit *= 4
            continue
        done = new if done is None else done.unionByName(new)
        named = clusters.join(new.select(F.col("gone").alias("id"), "keep").hint("merge"), "id", "left").withColumn("id", F.coalesce("keep", "id")).drop("keep")
        mean = [(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in AXES]
        clusters, left = written(named.groupBy("id").agg(F.sum("n").alias("m"), *mean).withColumnRenamed("m", "n"), "clusters"), left - n
    return done, left


def ward(points: DataFrame, k: int, small: int = SMALL, crowd: int = CROWD) -> DataFrame:
    """points with their cluster, 0 to k - 1 by each one's first place; fewer where there are fewer places, null without a place."""
    placed = points.filter(" and ".join(f"{c} is not null" for c in AXES))
    places = written(placed.groupBy(*[F.col(c).cast("double").alias(c) for c in AXES]).agg(F.count("*").cast("double").alias("n")).withColumn("id", F.struct(*AXES)), "places")
    done, left = merges(places, k, small, crowd)
    if done is not None:
        done = written(done, "merges")
        if left < k:  # the highest merges are taken back
            done = done.join(done.orderBy(F.desc("height"), "keep").limit(k - left).select("gone"), "gone", "left_anti")
        named = components(done.select(F.col("keep").alias("src"), F.col("gone").alias("dst")), places.select("id"))
    else:
        named = places.select("id", F.col("id").alias("component"))
    named = written(named, "named")
    number = named.select("component").distinct().withColumn("cluster", (F.row_number().over(Window.orderBy("component")) - 1).cast("int"))  # k rows
    of = written(named.join(number, "component").select(*[F.col(f"id.{c}").alias(f"_{c}") for c in AXES], "cluster"), "clusters")
    return points.join(of.hint("merge"), [F.col(c).cast("double") == F.col(f"_{c}") for c in AXES], "left").drop(*[f"_{c}" for c in AXES])
