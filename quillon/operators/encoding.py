"""Sparse random-projection codes of response vectors, noise, augmentation and splits.

Random numbers come from hashes of the row's own keys and a seed, so they do not depend on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import cumulated, quantile

#: Output units, share kept, share of connections, deviation of weights.
UNITS, SPARSITY, CONNECTED, DEVIATION = 2000, 0.05, 0.5, 0.1


def uniform(*keys: Column | str, seed: int = 42) -> Column:
    """A number in (0, 1) that only depends on the keys and the seed."""
    digest = F.md5(F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal(*keys: Column | str, seed: int = 42) -> Column:
    """A standard normal number that only depends on the keys and the seed."""
    return F.sqrt(-2 * F.log(uniform(*keys, seed=seed))) * F.cos(2 * F.pi() * uniform(*keys, seed=seed + 7919))


#: Mean up to which Poisson counts are drawn exactly; above, the normal approximation has more than enough digits.
POISSON = 600.0


def poisson(mean: Column, *keys: Column | str, seed: int = 42) -> Column:
    """A Poisson count that only depends on the mean, the keys and the seed: by inversion of the distribution, one number a count."""
    u, low = uniform(*keys, seed=seed), F.least(mean, F.lit(POISSON))
    upto = F.sequence(F.lit(1), F.ceil(low + 10 * F.sqrt(low) + 20).cast("int"))
    start = F.struct(F.exp(-low).alias("p"), F.exp(-low).alias("sum"), F.lit(0).alias("k"))

    def step(a, i):
        p = a["p"] * low / i
        more = a["sum"] < u
        return F.struct(p.alias("p"), F.when(more, a["sum"] + p).otherwise(a["sum"]).alias("sum"), F.when(more, i).otherwise(a["k"]).alias("k"))

    exact = F.aggregate(upto, start, step, lambda a: a["k"].cast("double"))
    return F.when(mean > POISSON, F.greatest(F.round(mean + normal(*keys, seed=seed) * F.sqrt(mean)), F.lit(0.0))).when(mean > 0, exact).otherwise(0.0)


def random_weights(channels: DataFrame, units: int = UNITS, connected: float = CONNECTED, deviation: float = DEVIATION, seed: int = 42) -> DataFrame:
    """(channel, unit, weight) of the connections there are; channels is a dimension (channel)."""
    every = channels.select("channel", F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"))
    return every.filter(uniform("channel", "unit", seed=seed) < connected).withColumn("weight", normal("channel", "unit", seed=seed + 1) * deviation)


def project(response: DataFrame, weights: DataFrame) -> DataFrame:
    """(item, unit, activation): weighted sums of an item's responses; cells not measured add nothing."""
    r = response.filter("response is not null and response != 0")
    return r.join(weights, "channel").groupBy("item", "unit").agg(F.sum(F.col("response") * F.col("weight")).alias("activation"))


def winners(activation: DataFrame, k: int) -> DataFrame:
    """The k greatest activations of each item, ties by unit; none for k = 0. The sign is not considered."""
    order = Window.partitionBy("item").orderBy(F.desc("activation"), F.asc("unit"))
    return activation.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).drop("nth")


def above(activation: DataFrame, threshold: float | None = None, sparsity: float = SPARSITY) -> DataFrame:
    """Activations above the threshold; by default the percentile over all items that leaves a share of `sparsity`."""
    if threshold is not None:
        return activation.filter(F.col("activation") > threshold)
    return activation.filter(F.col("activation") > F.lit(quantile(activation, "activation", 1 - sparsity)).cast("double"))


def sparse_code(response: DataFrame, channels: DataFrame, units: int = UNITS, sparsity: float = SPARSITY, seed: int = 42) -> DataFrame:
    """(item, unit, activation): projection, then winners take all."""
    return winners(project(response, random_weights(channels, units, seed=seed)), int(units * sparsity))


def sparsity_statistics(code: DataFrame, units: int) -> DataFrame:
    """One row: items, share above 0 of all units, mean and deviation of active units an item, of active values."""
    a = F.col("activation")
    per = code.groupBy("item").agg(F.count_if(a > 0).alias("n"), F.sum(F.when(a > 0, a)).alias("s1"), F.sum(F.when(a > 0, a * a)).alias("s2"))
    s = per.agg(F.count("*").alias("n_items"), F.avg("n").alias("mean_active"), F.stddev_pop("n").alias("std_active"), F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    mean = F.col("s1") / F.nullif(F.col("n"), F.lit(0))
    return s.select("n_items", (F.col("mean_active") / units).alias("active_share"), "mean_active", "std_active", mean.alias("mean_value"), F.sqrt(F.greatest(F.col("s2") / F.nullif(F.col("n"), F.lit(0)) - mean * mean, F.lit(0.0))).alias("std_value"))


NOISES = ("gaussian", "dropout", "poisson")


def noisy(code: DataFrame, kind: str | Column, level: float = 0.1, keys: tuple[str, ...] = ("item", "unit"), seed: int = 42) -> DataFrame:
    """Active values with noise, none below 0. Poisson noise is a count of mean 100 a unit, by 100."""
    a = F.col("activation")
    if isinstance(kind, str) and kind not in NOISES:
        raise ValueError(f"unknown noise {kind!r}; one of {', '.join(NOISES)}")
    of = F.lit(kind) if isinstance(kind, str) else kind
    z, u = normal(*keys, seed=seed), uniform(*keys, seed=seed)
    counts = poisson(a * 100, *keys, seed=seed) / 100
    new = F.when(of == "gaussian", a + z * level).when(of == "dropout", F.when(u < level, 0.0).otherwise(a)).otherwise(counts)
    return code.withColumn("activation", F.when(a > 0, F.greatest(new, F.lit(0.0))).otherwise(a))


def augmented(code: DataFrame, copies: int = 5, kinds: tuple[str, ...] = NOISES, level: float = 0.1, seed: int = 42) -> DataFrame:
    """code with a column `copy`: 0 as it is, 1 to `copies` with noise of each kind in turn."""
    every = code.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.greatest(F.col("copy") - 1, F.lit(0)) % len(kinds) + 1).cast("int"))
    changed = noisy(every.filter("copy > 0"), kind, level, ("item", "unit", "copy"), seed)
    return every.filter("copy = 0").unionByName(changed)


def split(items: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """items (item, ...) with `train`: exactly int(n * share) of the distinct ids, in the order of a hash, then of the id.

    Hashes are ranked in ranges, so no task sees more than its part of the ids.
    """
    ids = items.select("item").distinct().withColumn("h", uniform("item", seed=seed))
    ahead = cumulated(ids, "h").select("h", "below")
    within = F.row_number().over(Window.partitionBy("h").orderBy("item"))  # over the ids of one hash
    n = int(ids.count() * share)
    cut = ids.join(ahead, "h").select("item", (F.col("below") + within <= n).alias("train"))
    return items.join(cut, "item", "left").withColumn("train", F.coalesce("train", F.lit(False)))
