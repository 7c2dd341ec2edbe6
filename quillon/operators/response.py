"""Queries on a response table in long form: item, channel, response.

One row a measured cell; a cell without a row, or with a null response, was not measured.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import resolved
from ..functions.numeric import ratio, tuning_class, tuning_kurtosis

#: A response above it is active: in a coverage table; in a list of activated channels.
ACTIVE, ACTIVATED = 0.1, 0.3


def channel_coverage(response: DataFrame) -> DataFrame:
    """(channel, n_tested, pct): measured items of each channel, and their share of all items."""
    every = response.select("item").distinct().agg(F.count("*").alias("n_items"))
    counts = response.groupBy("channel").agg(F.count("response").alias("n_tested"))
    return counts.join(F.broadcast(every)).select("channel", "n_tested", (F.col("n_tested") * 100.0 / F.col("n_items")).alias("pct"))


def item_coverage(response: DataFrame, active: float = ACTIVE) -> DataFrame:
    """Measured and active channels of each item, its greatest and its mean response."""
    r = F.col("response")
    return response.groupBy("item").agg(F.count(r).alias("n_tested"), F.count_if(r > active).alias("n_active"), F.max(r).alias("max_response"), F.avg(r).alias("mean_response"))


def profile(response: DataFrame) -> DataFrame:
    """One row: items, channels, measured cells, share of cells not measured, least and greatest response."""
    r = F.col("response")
    sizes = response.agg(F.countDistinct("item").alias("n_items"), F.countDistinct("channel").alias("n_channels"), F.count(r).alias("n_cells"), F.min(r).alias("min_response"), F.max(r).alias("max_response"))
    return sizes.withColumn("sparsity_pct", 100.0 - ratio(F.col("n_cells") * 100.0, F.col("n_items") * F.col("n_channels")))


def tuning(response: DataFrame) -> DataFrame:
    """(channel, kurtosis, tuning): excess kurtosis of each channel's responses, and its class."""
    return response.groupBy("channel").agg(tuning_kurtosis(F.col("response")).alias("kurtosis")).withColumn("tuning", tuning_class(F.col("kurtosis")))


def activated(response: DataFrame, threshold: float = ACTIVATED, use_abs: bool = False) -> DataFrame:
    """Cells above the threshold, or as far below its negative with use_abs."""
    r = F.col("response")
    return response.filter((F.abs(r) if use_abs else r) > threshold).select("item", "channel", "response")


def ranked(response: DataFrame, by: str, then: str, n: int, descending: bool = True, name: str = "rank") -> DataFrame:
    """The n greatest (or least) responses of each `by`, ties by `then`."""
    r = F.col("response")
    order = Window.partitionBy(by).orderBy(r.desc() if descending else r.asc(), F.asc(then))
    return response.filter(r.isNotNull()).withColumn(name, F.row_number().over(order)).filter(F.col(name) <= n)


def best_items(response: DataFrame, n: int = 10) -> DataFrame:
    """(channel, item, response, rank) of each channel's n greatest responses."""
    return ranked(response, "channel", "item", n).select("channel", "item", "response", "rank")


def top_and_bottom(response: DataFrame, n: int = 5) -> DataFrame:
    """(item, side, rank, channel, response): the n greatest and the n least responses of each item."""
    both = [ranked(response, "item", "channel", n, side == "top").withColumn("side", F.lit(side)) for side in ("top", "bottom")]
    return both[0].unionByName(both[1]).select("item", "side", "rank", "channel", "response")


def head_and_tail(response: DataFrame, limit: int) -> DataFrame:
    """(channel, item, response): each channel's `limit` greatest and least responses, a cell once; limit 0: all."""
    r = response.filter("response is not null").select("channel", "item", "response")
    if not limit:
        return r
    down = Window.partitionBy("channel").orderBy(F.desc("response"), F.asc("item"))
    up = Window.partitionBy("channel").orderBy(F.asc("response"), F.desc("item"))
    return r.withColumn("head", F.row_number().over(down)).withColumn("tail", F.row_number().over(up)).filter(f"head <= {limit} or tail <= {limit}").drop("head", "tail")


def spread(response: DataFrame, items: Sequence) -> DataFrame:
    """(channel, max, min, spread) over the given items."""
    r = F.col("response")
    return response.filter(F.col("item").isin(list(items)) & r.isNotNull()).groupBy("channel").agg(F.max(r).alias("max_response"), F.min(r).alias("min_response"), (F.max(r) - F.min(r)).alias("spread"))


def subset(response: DataFrame, wanted: DataFrame, channels: Sequence | None = None) -> DataFrame:
    """Cells of the wanted items (item, ord), in that order, and channels; unknown items are left out, unknown channels are an error."""
    if channels is not None:
        known = {r.channel for r in response.filter(F.col("channel").isin(list(channels))).select("channel").distinct().collect()}
        if missing := [c for c in channels if c not in known]:
            raise KeyError(f"unknown channels: {missing}")
        response = response.filter(F.col("channel").isin(list(channels)))
    return response.join(wanted, "item").select("ord", "item", "channel", "response")


def search(items: DataFrame, name: str, pattern: str) -> DataFrame:
    """Rows whose name has the pattern in it, in either case, ordered by name."""
    return items.filter(F.lower(name).contains(pattern.lower())).orderBy(name)


def encode(response: DataFrame, channels: Sequence, fill: float = 0.0) -> DataFrame:
    """(item, vector): responses of each item in the order of channels, `fill` where not measured."""
    cells = response.filter("response is not null").groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("channel", "response"))).alias("cells"))
    order = F.array(*[F.lit(c) for c in channels])
    every = response.select("item").distinct().join(cells, "item", "left")
    return every.select("item", F.transform(order, lambda c: F.coalesce(F.try_element_at(F.col("cells"), c), F.lit(float(fill)))).alias("vector"))


def encode_named(response: DataFrame, wanted: DataFrame, aliases: DataFrame, channels: Sequence, fill: float = 0.0, name: str = "name") -> DataFrame:
    """(name, item, vector) of the wanted names, resolved by aliases (alias, key); an unknown name is an error with suggestions."""
    own = resolved(wanted.select(name).distinct(), aliases, name).withColumnRenamed("key", "item")
    vectors = encode(response.join(own.select("item").distinct(), "item", "left_semi"), channels, fill)
    return own.join(vectors, "item").select(name, "item", "vector")


def importance(response: DataFrame) -> DataFrame:
    """(channel, importance): population variance times mean magnitude, as shares of their sum."""
    r = F.col("response")
    raw = response.groupBy("channel").agg((F.var_pop(r) * F.avg(F.abs(r))).alias("raw"))
    return raw.join(F.broadcast(raw.agg(F.sum("raw").alias("total")))).select("channel", ratio(F.col("raw"), F.col("total")).alias("importance"))


def contributions(response: DataFrame) -> DataFrame:
    """(channel, contribution): mean magnitude, as shares of their sum."""
    raw = response.groupBy("channel").agg(F.avg(F.abs("response")).alias("raw"))
    return raw.join(F.broadcast(raw.agg(F.sum("raw").alias("total")))).select("channel", ratio(F.col("raw"), F.col("total")).alias("contribution"))


def critical(shares: DataFrame, least: float = 0.1) -> DataFrame:
    """Channels whose contribution is at least `least`."""
    return shares.filter(F.col("contribution") >= least)


def pathway_strength(response: DataFrame, pathways: DataFrame) -> DataFrame:
    """(pathway, strength, n_pairs) of pathways (pathway, channel, item): mean response of their pairs, 0 if none is measured."""
    cells = pathways.join(response, ["channel", "item"], "left")
    return cells.groupBy("pathway").agg(F.coalesce(F.avg("response"), F.lit(0.0)).alias("strength"), F.count("response").alias("n_pairs"))


def bucket(x: Column) -> Column:
    """Strength class of a response."""
    return F.when(x >= 0.5, "strong").when(x >= 0.2, "moderate").otherwise("weak")


def strength_buckets(response: DataFrame) -> DataFrame:
    """(channel, bucket, n, pct) of positive responses."""
    r = F.col("response")
    counts = response.filter(r > 0).groupBy("channel", bucket(r).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("channel")))


def dataset_statistics(response: DataFrame, n_channels: int, active: float = ACTIVATED) -> DataFrame:
    """One row over all cells, those not measured counting 0: items, mean, population deviation, active share, extremes, share measured."""
    r = F.col("response")
    s = response.agg(F.countDistinct("item").alias("n_items"), F.count(r).alias("n_cells"), F.sum(r).alias("s1"), F.sum(r * r).alias("s2"), F.count_if(r > active).alias("n_active"), F.max(r).alias("hi"), F.min(r).alias("lo"))
    n = F.col("n_items") * F.lit(float(n_channels))
    mean = ratio(F.col("s1"), n)
    edge = lambda c, f: F.when(F.col("n_cells") < n, f(F.col(c), F.lit(0.0))).otherwise(F.col(c))
    return s.select(
        "n_items", mean.alias("mean_response"), F.sqrt(F.greatest(ratio(F.col("s2"), n) - mean * mean, F.lit(0.0))).alias("std_response"), ratio(F.col("n_cells") * 1.0, n).alias("coverage"),
        ratio(F.col("n_active") * 1.0, n).alias("active_share"), edge("hi", F.greatest).alias("max_response"), edge("lo", F.least).alias("min_response"),
    )


def compare_pathways(strengths: DataFrame) -> DataFrame:
    """(pathway, strength, place): named pathways (a dimension) from the strongest on, ties by name."""
    own = strengths.select("pathway", F.round("strength", 8).alias("strength"))
    return own.withColumn("place", F.rank().over(Window.orderBy(F.desc("strength"), "pathway")))


def first_rows(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by their order."""
    return rows.orderBy(order).limit(n)
