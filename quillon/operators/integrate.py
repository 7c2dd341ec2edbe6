"""Responses against connections: matrices by channel, pair tables, subnetworks and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..sources.tables import written
from .graph import components
from .network import INHIBITORY, RELAY
from .ranges import median

# Middle classes of each kind of connection.
KINDS = {"inhibitory": INHIBITORY, "excitatory": RELAY, "all": None}


def connectivity(paths: DataFrame, kind: str = "all") -> DataFrame:
    """(src_region, dst_region, weight): second steps of two-hop paths summed, over middles of one kind."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; one of {', '.join(KINDS)}")
    own = paths if KINDS[kind] is None else paths.filter(F.col("middle_class") == KINDS[kind])
    return own.filter("target_region is not null").groupBy(F.col("source_region").alias("src_region"), F.col("target_region").alias("dst_region")).agg(F.sum("step2").cast("long").alias("weight"))


def by_channel(matrix: DataFrame, mapping: DataFrame, last_only: bool = False) -> DataFrame:
    """(c1, c2, weight): a region matrix in the names of channels (channel, region[, row_ord]); of several weights of a pair the greatest.

    Every channel of a region gets its weights; with last_only, the region's last channel alone.
    """
    if mapping.isEmpty():
        raise ValueError("the mapping is empty")
    if last_only:
        mapping = mapping.groupBy("region").agg(F.max_by("channel", "row_ord").alias("channel"))
    one = mapping.select(F.col("channel").alias("c1"), F.col("region").alias("src_region"))
    two = mapping.select(F.col("channel").alias("c2"), F.col("region").alias("dst_region"))
    return matrix.join(one, "src_region").join(two, "dst_region").groupBy("c1", "c2").agg(F.max("weight").alias("weight"))


def dense(matrix: DataFrame, names: list, a: str = "c1", b: str = "c2") -> DataFrame:
    """Every pair of the names with its weight, 0 where there is none."""
    spine = matrix.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias(a)).withColumn(b, F.explode(F.array(*map(F.lit, names))))
    return spine.join(matrix, [a, b], "left").select(a, b, F.coalesce("weight", F.lit(0)).alias("weight"))


def mapped_channels(response: DataFrame, mapping: DataFrame, regions: DataFrame) -> DataFrame:
    """(channel): channels with responses whose region is known."""
    return response.select("channel").intersect(mapping.join(regions, "region", "left_semi").select("channel"))


def tuning_and_connection(correlations: DataFrame, matrix: DataFrame) -> DataFrame:
    """(c1, c2, r, weight): pairs c1 < c2 of channels that are connected and whose correlation is known."""
    return correlations.join(matrix, ["c1", "c2"]).filter("c1 < c2 and weight > 0 and r is not null").select("c1", "c2", "r", "weight")


def path_class(has_inhibitory: Column, has_relay: Column) -> Column:
    return F.when(has_inhibitory & has_relay, "mixed").when(has_inhibitory, "inhibitory").when(has_relay, "excitatory").otherwise("other")


def subnetwork(activated: DataFrame, matrix: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(c1, c2, weight, r1, r2[, path_class]): connected pairs c1 < c2 of an item's activated channels (channel, response)."""
    one = activated.select(F.col("channel").alias("c1"), F.col("response").alias("r1"))
    two = activated.select(F.col("channel").alias("c2"), F.col("response").alias("r2"))
    own = matrix.filter("c1 < c2 and weight > 0").join(one, "c1").join(two, "c2")
    return own if classes is None else own.join(classes, ["c1", "c2"], "left")


def subnetwork_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, undirected density, mean and greatest degree, hub (the first of the greatest), weights."""
    ends = edges.select(F.col("c1").alias("channel")).unionByName(edges.select(F.col("c2").alias("channel"))).groupBy("channel").agg(F.count("*").alias("degree"))
    d = nodes.select("channel").join(ends, "channel", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    d = d.agg(F.count("*").alias("n_nodes"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"), F.min_by("channel", F.struct(-F.col("degree"), "channel")).alias("hub"))
    edges = written(edges, "edges")
    w = edges.agg(F.count("*").alias("n_edges"), F.avg("weight").alias("mean_weight"), median(edges, "weight").alias("median_weight"), F.max("weight").alias("max_weight"))
    parts = components(edges.select(F.col("c1").alias("src"), F.col("c2").alias("dst")), nodes.select(F.col("channel").alias("id"))).agg(F.count_distinct("component").alias("n_components"))
    n = F.col("n_nodes")
    return d.join(F.broadcast(w)).join(F.broadcast(parts)).withColumn("density", ratio(F.col("n_edges") * 2.0, n * (n - 1)))


def recommended(matrix: DataFrame, response: DataFrame, least: int = 10, threshold: float = 0.3) -> DataFrame:
    """(item, c1, c2, weight, score): items active in both channels of a connected pair; score: the lesser response."""
    pairs = matrix.filter((F.col("c1") < F.col("c2")) & (F.col("weight") >= least))
    active = response.filter(F.col("response") > threshold)
    one = active.select("item", F.col("channel").alias("c1"), F.col("response").alias("r1"))
    two = active.select("item", F.col("channel").alias("c2"), F.col("response").alias("r2"))
    return one.join(pairs, "c1").join(two, ["item", "c2"]).select("item", "c1", "c2", "weight", F.least("r1", "r2").alias("score"))


def recommendation_totals(rows: DataFrame) -> DataFrame:
    """(item, n_pairs, total_weight, max_weight, mean_weight, mean_score)"""
    return rows.groupBy("item").agg(F.count("*").alias("n_pairs"), F.sum("weight").cast("long").alias("total_weight"), F.max("weight").alias("max_weight"), F.avg("weight").alias("mean_weight"), F.avg("score").alias("mean_score"))


def pair_diagnostics(matrix: DataFrame, n_channels: int, cuts: tuple[int, int, int] = (10, 50, 100)) -> DataFrame:
    """One row on the connected pairs c1 < c2: their number and share of all pairs, extremes, mean, median, and four strength classes."""
    w = F.col("weight")
    own = written(matrix.filter("c1 < c2 and weight > 0"), "pairs")
    total = n_channels * (n_channels - 1) // 2
    a, b, c = cuts
    return own.agg(
        F.count("*").alias("n_connected"), F.lit(total).cast("long").alias("n_pairs"), (F.count("*") * (100.0 / max(total, 1))).alias("rate_pct"), F.min(w).alias("min_weight"), median(own, "weight").alias("median_weight"), F.avg(w).alias("mean_weight"),
        F.max(w).alias("max_weight"), F.count_if(w < a).alias("n_weak"), F.count_if((w >= a) & (w < b)).alias("n_medium"), F.count_if((w >= b) & (w < c)).alias("n_strong"), F.count_if(w >= c).alias("n_very_strong"),
    )


def map_coverage(channels: DataFrame, mapping: DataFrame) -> DataFrame:
    """(channel, mapped, priority): priority HIGH for an unmapped channel with responses, else LOW; null for mapped ones. channels: (channel, n_tested)."""
    known = mapping.select("channel").distinct().withColumn("mapped", F.lit(True))
    own = channels.join(known, "channel", "left").withColumn("mapped", F.coalesce("mapped", F.lit(False)))
    return own.select("channel", "mapped", F.when(~F.col("mapped"), F.when(F.col("n_tested") > 0, "HIGH").otherwise("LOW")).alias("priority"))
