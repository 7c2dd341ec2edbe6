"""Rule-based outcomes of items from the responses of weighted channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Weights of the channels behind each outcome; named pathways.
ATTRACTIVE = {"Or42b": 0.9, "Or47b": 0.9, "Or59b": 0.7, "Or22a": 0.7, "Or42a": 0.6}
AVERSIVE = {"Or92a": 0.9, "Or7a": 0.7, "Or56a": 0.6, "Or69a": 0.6}
FEEDING = {"Or47b": 0.9, "Or42b": 0.7, "Or59b": 0.6}
PATHWAYS = {
    "or47b_feeding": (("Or47b",), ("hexanol", "1-hexanol", "hexan-1-ol")),
    "or42b": (("Or42b",), ("ethyl butyrate", "ethyl acetate")),
    "or92a_avoidance": (("Or92a",), ("geosmin",)),
}

#: Least magnitude that counts.
THRESHOLD = 0.3


def weights(spark, attractive: dict | None = None, aversive: dict | None = None, feeding: dict | None = None) -> DataFrame:
    """(channel, attractive, aversive, feeding)"""
    tables = [ATTRACTIVE if attractive is None else attractive, AVERSIVE if aversive is None else aversive, FEEDING if feeding is None else feeding]
    names = sorted({c for t in tables for c in t})
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), *[F.lit(float(t.get(c, 0.0))).alias(k) for k, t in zip(("attractive", "aversive", "feeding"), tables)]) for c in names])
    return spark.range(1).select(F.inline(rows))


def outcomes(response: DataFrame, weights: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, attractive, aversive, feeding, outcome, confidence) of every item with a response.

    Scores are sums of magnitude times weight over channels of at least the threshold.
    """
    r = F.abs("response")
    own = response.join(weights, "channel", "left").filter("response is not null")
    score = lambda k: F.coalesce(F.sum(F.when(r >= threshold, r * F.col(k))), F.lit(0.0)).alias(k)
    s = own.groupBy("item").agg(score("attractive"), score("aversive"), score("feeding"))
    good, bad = F.col("attractive"), F.col("aversive")
    total = good + bad
    share = lambda x: F.least(x / (total + 1e-6), F.lit(1.0))
    kind = F.when(total == 0, "neutral").when(good > bad, F.when(F.col("feeding") > 0.5, "attractive (feeding)").otherwise("attractive")).when(bad > good, "aversive").otherwise("neutral")
    sure = F.when(total == 0, 0.3).when(good > bad, share(good)).when(bad > good, share(bad)).otherwise(0.5)
    return s.select("item", "attractive", "aversive", "feeding", kind.alias("outcome"), sure.alias("confidence"))


def top_contributors(response: DataFrame, k: int = 5) -> DataFrame:
    """(item, rank, channel, response) of the k greatest magnitudes."""
    order = Window.partitionBy("item").orderBy(F.desc(F.abs("response")), F.asc("channel"))
    return response.filter("response is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item", "rank", "channel", "response")


def valence(outcome: str):
    """attractive, aversive or neutral, without what stands behind."""
    return F.split_part(F.col(outcome), F.lit(" "), F.lit(1))


def validation(predicted: DataFrame, known: DataFrame) -> DataFrame:
    """One row: known outcomes (item, known) met by a prediction's valence, their share and number."""
    both = known.join(predicted, "item").withColumn("ok", (valence("outcome") == F.col("known")).cast("int"))
    n, ok = F.count("*"), F.coalesce(F.sum("ok"), F.lit(0)).cast("long")
    return both.agg(n.alias("n"), ok.alias("n_correct"), (ok * 1.0 / F.nullif(n, F.lit(0))).alias("accuracy"), (1.0 - ok * 1.0 / F.nullif(n, F.lit(0))).alias("error_rate"))


def pathway_table(spark, pathways: dict | None = None) -> DataFrame:
    """(pathway, channel, item) of named pathways."""
    rows = [(k, c, i) for k, (channels, items) in (PATHWAYS if pathways is None else pathways).items() for c in channels for i in items]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("pathway"), F.lit(c).alias("channel"), F.lit(i).alias("item")) for k, c, i in rows])))


def compared(predicted: DataFrame, items: list) -> DataFrame:
    """The predictions of the given items with their place: by attractive less aversive score, ties by item."""
    own = predicted.filter(F.col("item").isin(items))
    return own.withColumn("place", F.rank().over(Window.orderBy(F.desc(F.round(F.col("attractive") - F.col("aversive"), 8)), "item")))  # over the items asked for
