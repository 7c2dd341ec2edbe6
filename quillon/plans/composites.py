"""Whole analyses in one call: a training set, and responses against connections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sinks
from ..operators import encoding, response, statistics
from ..operators.similarity import channel_correlations
from ..operators import integrate
from ..sources.tables import written


def training_set(table: DataFrame, folder: str, units: int = encoding.UNITS, sparsity: float = encoding.SPARSITY, copies: int = 5, level: float = 0.1, share: float = 0.8, seed: int = 42, metadata: DataFrame | None = None, format: str = "parquet") -> dict:
    """A training set of a response table (item, channel, response), written in a folder; its facts are returned.

    * inputs: (sample, item, copy, train, vector): the responses by channel, 0 where not measured, as they are (copy 0)
      and with noise on the inputs; with format npy also as shards.
    * codes: (sample, unit, activation): the sparse code of each sample, of its noisy inputs.
    * metadata, if given: its rows of the items. facts: a JSON text.

    All samples of an item are on one side of the split. Channels are a dimension: their names come to the driver.
    """
    own = table.filter("response is not null").select("item", F.col("channel").alias("unit"), F.col("response").alias("activation"))
    noisy = written(encoding.augmented(own, copies, level=level, seed=seed), "noisy")
    sample = F.concat_ws("#", F.col("item").cast("string"), "copy")
    cells = noisy.select(sample.alias("sample"), "item", "copy", F.col("unit").alias("channel"), F.col("activation").alias("response"))
    channels = [r.channel for r in table.select("channel").distinct().orderBy("channel").collect()]
    samples = encoding.split(cells.select("sample", "item", "copy").distinct(), share, seed)
    vectors = response.encode(cells.select(F.col("sample").alias("item"), "channel", "response"), channels).withColumnRenamed("item", "sample")
    inputs = written(samples.join(vectors, "sample").select("sample", "item", "copy", "train", "vector"), "inputs")
    inputs.write.mode("overwrite").parquet(f"{folder}/inputs")
    codes = encoding.sparse_code(cells.select(F.col("sample").alias("item"), "channel", "response"), table.select("channel").distinct(), units, sparsity, seed)
    codes.select(F.col("item").alias("sample"), "unit", "activation").write.mode("overwrite").parquet(f"{folder}/codes")
    if format == "npy":
        sinks.write_training(inputs.select(F.col("sample").alias("item"), "vector", "train"), f"{folder}/inputs_npy", "npy")
    if metadata is not None:
        metadata.join(samples.select("item").distinct(), "item", "left_semi").write.mode("overwrite").parquet(f"{folder}/metadata")
    counts = inputs.agg(F.count("*").alias("n_samples"), F.count_distinct("item").alias("n_items"), F.count_if("train").alias("n_train")).first()
    facts = counts.asDict() | {"n_channels": len(channels), "channels": [str(c) for c in channels], "units": units, "sparsity": sparsity, "copies": copies, "level": level, "share": share, "seed": seed}
    facts |= response.dataset_statistics(table, len(channels)).first().asDict()
    table.sparkSession.createDataFrame([(json.dumps(facts, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/facts")
    return facts


def structure_function(table: DataFrame, matrix: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row on whether channels that respond alike are connected: over connected pairs of mapped channels, the correlation of responses r against the weight of the connection.

    (n, r, r_p, rho, rho_p, slope, intercept, n_strong, u, u_p, d): Pearson and Spearman with p-values, least squares of
    the weight, and strong pairs (above the median weight) against the others: Mann-Whitney and Cohen's d of r.
    matrix: (src_region, dst_region, weight); mapping: (channel, region, row_ord).
    """
    own = table.join(mapping.select("channel").distinct(), "channel", "left_semi")
    pairs = written(integrate.tuning_and_connection(channel_correlations(own), integrate.by_channel(matrix, mapping)), "pairs")
    split = written(statistics.median_split(pairs, "weight"), "split")
    one = statistics.pearson(pairs, "r", "weight").select("n", "r", F.col("p").alias("r_p"))
    two = statistics.spearman(pairs, "r", "weight").select("rho", F.col("p").alias("rho_p"))
    line = statistics.linear_fit(pairs, "r", "weight")
    test = statistics.mann_whitney(split, "r", F.col("upper")).select(F.col("n1").alias("n_strong"), "u", F.col("p").alias("u_p"))
    out = one
    for part in (two, line, test, statistics.cohen_d(split, "r", F.col("upper"))):  # one row each
        out = out.join(F.broadcast(part))
    return out


def structure_report(row) -> str:
    """A Markdown report on a row of structure_function."""
    shown = lambda x: "-" if x is None else f"{x:.4g}"
    sure = lambda p: "" if p is None else f" (p = {p:.3g}{', significant' if p < 0.05 else ''})"
    return "\n".join([
        "# Responses and connections", "", f"- connected pairs: {row.n}, strong ones: {row.n_strong}", f"- Pearson r: {shown(row.r)}{sure(row.r_p)}", f"- Spearman rho: {shown(row.rho)}{sure(row.rho_p)}",
        f"- weight = {shown(row.slope)} r + {shown(row.intercept)}", f"- strong against weak pairs: U = {shown(row.u)}{sure(row.u_p)}, d = {shown(row.d)}",
    ]) + "\n"
