"""Names and their keys: normal forms, alias tables, resolution and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.matching import alike


def variants(name: Column) -> Column:
    """Normal forms under which a name is looked up, in this order, without repeats or empty ones."""
    x = F.trim(F.lower(name))
    forms = F.array(x, F.replace(x, F.lit(" "), F.lit("-")), F.replace(x, F.lit(" "), F.lit("")), F.replace(x, F.lit("-"), F.lit(" ")), F.replace(x, F.lit("-"), F.lit("")), F.regexp_replace(x, "[ -]", ""))
    return F.array_distinct(F.filter(forms, lambda v: v != ""))


def is_structure_key(x: Column) -> Column:
    """Whether a trimmed text has a structure key's 27 characters and two hyphens."""
    t = F.trim(x)
    return (F.length(t) == 27) & (F.length(t) - F.length(F.replace(t, F.lit("-"), F.lit(""))) >= 2)


def region_name(x: Column, prefix: str = "ORN_") -> Column:
    """A region's name with its prefix; sensillum names (ac.., ab..) stay; null if empty."""
    t = F.nullif(F.trim(x), F.lit(""))
    return F.when(F.lower(t).rlike("^a[bc]") | t.startswith(prefix), t).otherwise(F.concat(F.lit(prefix), t))


def alias_table(items: DataFrame, key: str, name: str, synonyms: str | None, order: str, separators: str = ";") -> DataFrame:
    """(alias, key): lower-cased names and synonyms, one key each. A name beats a synonym; the last name wins, and the first synonym."""
    names = items.select(F.lower(F.trim(name)).alias("alias"), F.col(key).alias("key"), F.lit(1).alias("is_name"), F.col(order).cast("long").alias("rank"), F.lit(0).alias("place"))
    if synonyms:
        parts = F.posexplode(F.split(F.coalesce(synonyms, F.lit("")), f"[{separators}]")).alias("place", "alias")
        other = items.select(F.col(key).alias("key"), F.col(order).cast("long").alias("rank"), parts)
        names = names.unionByName(other.select(F.lower(F.trim("alias")).alias("alias"), "key", F.lit(0).alias("is_name"), (-F.col("rank")).alias("rank"), "place"))
    best = Window.partitionBy("alias").orderBy(F.desc("is_name"), F.desc("rank"), F.asc("place"))
    return names.filter("alias != ''").withColumn("nth", F.row_number().over(best)).filter("nth = 1").select("alias", "key")


def resolve(wanted: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """wanted with the key of each name: by its first normal form that some alias has among its own normal forms; null if none."""
    known = aliases.select("key", F.posexplode(variants(F.col("alias"))).alias("known_place", "form"))
    asked = wanted.select(name, F.posexplode(variants(F.col(name))).alias("place", "form")).distinct()
    best = asked.join(known, "form").groupBy(name).agg(F.min(F.struct("place", "known_place", "key")).alias("best")).select(F.col(name).alias("found"), F.col("best.key").alias("key"))
    return wanted.join(best, F.col(name) == F.col("found"), "left").drop("found")


def resolved(wanted: DataFrame, aliases: DataFrame, name: str = "name", shown: int = 10, n: int = 3) -> DataFrame:
    """wanted with the key of each name, as `resolve`; a name without one is an error, which tells the first `shown` of them with their closest aliases."""
    found = resolve(wanted, aliases, name)
    unknown = found.filter(F.col("key").isNull() & F.col(name).isNotNull()).select(name).distinct().orderBy(name).limit(shown)
    if rows := unknown.collect():
        near = suggestions(unknown, aliases.select(F.lower("alias").alias("alias")).distinct(), name, n).orderBy(F.desc("similarity"), "alias").collect()
        told = [f"{r[0]!r}" + (f" (did you mean {', '.join(own)}?)" if (own := [x.alias for x in near if x[name] == r[0]]) else "") for r in rows]
        raise KeyError(f"unknown names: {'; '.join(told)}")
    return found


def matching(aliases: DataFrame, pattern: str) -> DataFrame:
    """(key): keys with an alias, name or synonym, that has the pattern in it, in either case."""
    return aliases.filter(F.contains(F.lower("alias"), F.lit(pattern.lower()))).select("key").distinct()


def suggestions(wanted: DataFrame, aliases: DataFrame, name: str = "name", n: int = 5, cutoff: float = 0.6) -> DataFrame:
    """(name, alias, similarity): the n aliases most like each wanted name in lower case, by the ratio of matching sequences; of equal ones the greater alias."""
    asked = wanted.filter(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct().withColumn("low", F.lower("name"))
    return alike(asked, aliases.select("alias"), n, cutoff).select(F.col("name").alias(name), "alias", "similarity")


def translated(wanted: DataFrame, mapping: DataFrame, name: str = "name", key: str = "channel", value: str = "region") -> DataFrame:
    """wanted with `found`: the mapping's first value of each name, null for a name that it lacks."""
    own = first_of(mapping, key, value).select(F.col(key).alias("known"), F.col(value).alias("found"))
    return wanted.join(own, F.col(name) == F.col("known"), "left").drop("known")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both by key; a new row replaces an old one of its key, and the last of several in the new table (by row_ord) counts."""
    both = old.withColumn("prio", F.lit(0)).unionByName(new.withColumn("prio", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc("prio"), F.desc("row_ord"))
    return both.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth", "prio")


def last_of(mapping: DataFrame, key: str, value: str, order: str = "row_ord") -> DataFrame:
    """(key, value): the last value of each key."""
    return mapping.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(value))


def first_of(mapping: DataFrame, key: str, value: str, order: str = "row_ord") -> DataFrame:
    return mapping.groupBy(key).agg(F.min_by(value, F.struct(order, value)).alias(value))
