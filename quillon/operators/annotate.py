"""Free-text labels of cells: search, classes, and the cells of each channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .matching import contained

# Patterns of the receptor families and of the sensillum types in labels.
FAMILIES = {"or": r"\bOr\d+[a-z]*\b", "ir": r"\bIr\d+[a-z]*\b", "gr": r"\bGr\d+[a-z]*\b"}
CLASSES = FAMILIES | {"sensillum_ab": r"\bab\d+[a-zA-Z]*\b", "sensillum_ac": r"\bac\d+[a-zA-Z]*\b", "sensillum_pb": r"\bpb\d+[a-zA-Z]*\b"}


def _pattern(p: str, case_sensitive: bool) -> str:
    return p if case_sensitive else f"(?i){p}"


def _is_pattern(spark: SparkSession, p: str) -> bool:
    """Whether Spark's regular expressions, Java's, know the pattern."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(p)
        return True
    except IllegalArgumentException:
        return False


def search(labels: DataFrame, patterns: Sequence[str], case_sensitive: bool = False) -> DataFrame:
    """labels with the pattern that they match, a row for each; a pattern that is no regular expression matches nothing. Null labels match nothing."""
    good = [p for p in patterns if _is_pattern(labels.sparkSession, p)]
    hits = F.array_compact(F.array(*[F.when(F.col("label").rlike(_pattern(p, case_sensitive)), F.lit(p)) for p in good])) if good else F.array().cast("array<string>")
    return labels.withColumn("pattern", F.explode(hits))


def classes(labels: DataFrame, wanted: Sequence[str] = ("or", "ir", "gr"), patterns: dict[str, str] | None = None) -> DataFrame:
    """labels with the class that they name, a row for each; unknown classes are left out."""
    patterns = patterns or CLASSES
    known = [k for k in wanted if k in patterns]
    hits = F.array_compact(F.array(*[F.when(F.col("label").rlike(_pattern(patterns[k], False)), F.lit(k)) for k in known])) if known else F.array().cast("array<string>")
    return labels.withColumn("class", F.explode(hits))


def names_in(labels: DataFrame, patterns: Sequence[str] = tuple(FAMILIES.values())) -> DataFrame:
    """(name, n): first name of each class in each label, counted as written."""
    first = F.array(*[F.regexp_extract("label", f"((?i){p})", 1) for p in patterns])
    return labels.select(F.explode(first).alias("name")).filter("name != ''").groupBy("name").agg(F.count("*").alias("n"))


def by_root(labels: DataFrame, roots: Sequence) -> DataFrame:
    return labels.filter(F.col("root_id").cast("string").isin([str(r) for r in roots]))


def positioned() -> Column:
    return F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()


def cells_of(labels: DataFrame, channels: DataFrame, whole_words: bool = False) -> DataFrame:
    """(channel, root_id, x, y, z): labels that name a channel, in either case; whole_words: not inside longer words. Names are plain text, any number of them."""
    own = labels.select("label", "root_id", "x", "y", "z")
    return contained(own, "label", channels, "channel", whole_words).select(F.col("name").alias("channel"), "root_id", "x", "y", "z")


def channel_cells(cells: DataFrame) -> DataFrame:
    """(channel, n_cells, n_positioned, mean_x, mean_y, mean_z); means over cells with all coordinates."""
    at = lambda c: F.avg(F.when(positioned(), F.col(c)))
    return cells.groupBy("channel").agg(F.count("*").alias("n_cells"), F.count_if(positioned()).alias("n_positioned"), at("x").alias("mean_x"), at("y").alias("mean_y"), at("z").alias("mean_z"))


def mapping_statistics(of: DataFrame, channels: DataFrame) -> DataFrame:
    """One row: channels, those with cells, their share, cells, mean cells a channel, channels with positions."""
    every = channels.select("channel").distinct().agg(F.count("*").alias("n_channels"))
    own = of.agg(F.count("*").alias("n_mapped"), F.sum("n_cells").alias("n_cells"), F.avg("n_cells").alias("mean_cells"), F.count_if(F.col("n_positioned") > 0).alias("n_positioned"))
    return every.join(F.broadcast(own)).withColumn("rate", F.col("n_mapped") * 1.0 / F.nullif(F.col("n_channels"), F.lit(0)))


def activation_map(cells: DataFrame, response: DataFrame, item) -> DataFrame:
    """(x, y, z, channel, intensity): positioned cells of the channels where the item's response is known and not 0."""
    own = response.filter((F.col("item") == item) & (F.col("response") != 0)).select("channel", F.col("response").alias("intensity"))
    return cells.filter(positioned()).join(own, "channel").select("x", "y", "z", "channel", "intensity")


def distinct_names(table: DataFrame, parts: Sequence[str] = ("glom", "receptor")) -> DataFrame:
    """(name): distinct trimmed values of every column whose own name has one of the parts."""
    own = [c for c in table.columns if any(p in c.lower() for p in parts)]
    values = F.explode(F.array(*[F.trim(F.col(c).cast("string")) for c in own]) if own else F.array().cast("array<string>"))
    return table.select(values.alias("name")).filter("name != ''").distinct()
