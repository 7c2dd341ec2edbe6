"""Similarity of items and of channels on a long response table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import correlation, ratio
from ..functions.pvalues import of_correlation
from ..sources.tables import written
from .ranges import running


def _against(response: DataFrame, target) -> DataFrame:
    """(item, a, b): responses of each other item and of the target by channel. The target has at most one row a channel."""
    own = response.filter((F.col("item") == target) & F.col("response").isNotNull()).select("channel", F.col("response").alias("b"))
    return response.filter((F.col("item") != target) & F.col("response").isNotNull()).join(own, "channel").select("item", F.col("response").alias("a"), "b")


def _best(scores: DataFrame, k: int | None) -> DataFrame:
    return scores if k is None else scores.orderBy(F.desc_nulls_last("similarity"), F.asc("item")).limit(k)


def by_correlation(response: DataFrame, target, k: int | None = 10) -> DataFrame:
    """(item, similarity, n_shared): items most correlated with the target over the channels that both have."""
    scores = _against(response, target).groupBy("item").agg(correlation(F.col("a"), F.col("b")).alias("similarity"), F.count("*").alias("n_shared"))
    return _best(scores.filter("similarity is not null"), k)


def by_distance(response: DataFrame, target, k: int | None = 10) -> DataFrame:
    """(item, similarity): negative Euclidean distance; channels that one side lacks add nothing."""
    scores = _against(response, target).groupBy("item").agg((-F.sqrt(F.sum(F.pow(F.col("a") - F.col("b"), F.lit(2.0))))).alias("similarity"))
    return _best(scores, k)


def channel_correlations(response: DataFrame) -> DataFrame:
    """(c1, c2, r, n, p) for c1 < c2: correlation over the n items that both channels have, and its two-sided p-value.

    Rows meet by item, so an item adds its channels' pairs (as many as the channels' number squared, not the items'),
    which are summed before they are shuffled again.
    """
    r = response.filter("response is not null")
    a, b = r.select("item", F.col("channel").alias("c1"), F.col("response").alias("x")), r.select("item", F.col("channel").alias("c2"), F.col("response").alias("y"))
    own = a.join(b, "item").filter("c1 < c2").groupBy("c1", "c2").agg(correlation(F.col("x"), F.col("y")).alias("r"), F.count("*").alias("n"))
    return own.withColumn("p", of_correlation(F.col("r"), F.col("n")))


def mirrored(pairs: DataFrame) -> DataFrame:
    """(c1, c2, r): pairs in both orders, and 1 for each channel with itself."""
    pairs = pairs.select("c1", "c2", "r")
    back = pairs.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), "r")
    own = pairs.select("c1").union(pairs.select("c2")).distinct().select("c1", F.col("c1").alias("c2"), F.lit(1.0).alias("r"))
    return pairs.unionByName(back).unionByName(own)


def by_pattern(response: DataFrame, target, threshold: float = 0.0, least: float = 0.3, k: int | None = 10) -> DataFrame:
    """(item, similarity): cosine of the responses whose magnitude reaches the threshold, of at least `least`; 0 when either side has none."""
    kept = response.filter(F.abs("response") >= threshold)
    norms = kept.groupBy("item").agg(F.sqrt(F.sum(F.col("response") * F.col("response"))).alias("norm"))
    own = norms.filter(F.col("item") == target).select(F.col("norm").alias("own"))
    dots = _against(kept, target).groupBy("item").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    scores = dots.join(norms, "item").join(F.broadcast(own)).select("item", F.coalesce(ratio(F.col("dot"), F.col("norm") * F.col("own")), F.lit(0.0)).alias("similarity"))
    return _best(scores.filter(F.col("similarity") >= least), k)


#: How far a block's scores may be from the exact ones: products of doubles against one pass over the pairs.
SLACK = 1e-9


def _vectors(response: DataFrame) -> tuple[DataFrame, int]:
    """(item, at, x): each item's responses in the order of the numbers of their channels; and how many channels there are."""
    r = response.filter("response is not null and channel is not null and item is not null")
    channels = r.select("channel").distinct().withColumn("one", F.lit(1))
    channels = written(running(channels, [], ["channel"], "one", "at").select("channel", F.col("at").cast("int").alias("at")), "channels")
    own = r.join(channels, "channel").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", F.col("response").cast("double").alias("x")))).alias("own"))
    return written(own.select("item", "own.at", "own.x"), "vectors"), channels.count()


def _matrix(rows: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Responses, 0 where there is none; and which there are."""
    if len(rows) and set(map(len, rows["x"])) == {width}:
        return np.concatenate(rows["x"].to_numpy()).reshape(-1, width), np.ones((len(rows), width), bool)
    x, has = np.zeros((len(rows), width)), np.zeros((len(rows), width), bool)
    for i, (at, values) in enumerate(zip(rows["at"], rows["x"])):
        x[i, at], has[i, at] = values, True
    return x, has


def _shifted(x: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Rows less their first responses, so that a constant row is exactly 0."""
    first = np.take_along_axis(x, has.argmax(axis=1)[:, None], axis=1)
    return np.where(has, x - first, 0.0)


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows without gaps less their means and of length 1; which are constant; and whose length is sure."""
    x = x - x[:, :1]
    size = (x * x).sum(axis=1)
    x -= x.mean(axis=1, keepdims=True)
    own = (x * x).sum(axis=1)
    return x / np.sqrt(own)[:, None], size == 0, np.isfinite(own) & (own > 1e-4 * size)


def _correlated(x: np.ndarray, y: np.ndarray, has: np.ndarray) -> np.ndarray:
    """The correlation of each row of x with that of y over what both have; nan below two, and where a side is constant."""
    n = has.sum(axis=1, keepdims=True)
    x, y = (np.where(has, v - v.sum(axis=1, keepdims=True) / n, 0.0) for v in (_shifted(x, has), _shifted(y, has)))
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    return np.where((n[:, 0] > 1) & (xx > 0) & (yy > 0), (x * y).sum(axis=1) / np.sqrt(xx * yy), np.nan)


def _close(width: int, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best of a block of items for each of a block of queries: those of products of matrices within SLACK of the k best, and those that rounding leaves unsure, are correlated exactly."""

    def of(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": queries["item"][:0], "item": items["item"][:0], "similarity": np.empty(0)})]
        (a, has_a), (q, has_q) = _matrix(items, width), _matrix(queries, width)
        names, full, place = items["item"].to_numpy(), bool(has_a.all() and has_q.all()), pd.Index(items["item"])
        step = max(1, (1 << 20) // max(len(items), 1))
        with np.errstate(all="ignore"):
            if full:
                (ua, same_a, sure_a), (uq, same_q, sure_q) = _units(a), _units(q)
            else:
                ca, cq, one_a, one_q = _shifted(a, has_a), _shifted(q, has_q), has_a.astype(float), has_q.astype(float)
            for start in range(0, len(queries) if len(items) else 0, step):
                own = slice(start, start + step)
                if full:
                    score, unsure = uq[own] @ ua.T, np.flatnonzero(~sure_a & ~same_a)
                    none = same_q[own][:, None] | same_a[None, :] if same_q[own].any() or same_a.any() else None
                    sure = None if sure_q[own].all() and not len(unsure) else sure_q[own][:, None] & sure_a[None, :]
                else:
                    n, sa, sq = one_q[own] @ one_a.T, one_q[own] @ ca.T, cq[own] @ one_a.T
                    aa, qq = one_q[own] @ (ca * ca).T, (cq[own] * cq[own]) @ one_a.T
                    va, vq = n * aa - sa * sa, n * qq - sq * sq
                    score = (n * (cq[own] @ ca.T) - sa * sq) / np.sqrt(va * vq)
                    none = (n < 2) | (aa == 0) | (qq == 0)
                    sure = np.isfinite(score) & (va > 1e-4 * n * aa) & (vq > 1e-4 * n * qq)
                if sure is not None:
                    score = np.where(sure, score, np.inf)
                if none is not None:
                    score[none] = -np.inf
                there = place.get_indexer(queries["item"].iloc[own])
                score[np.flatnonzero(there >= 0), there[there >= 0]] = -np.inf  # itself
                # what is unsure may not raise the bar
                bar = score if sure is None else np.where(np.isposinf(score), -np.inf, score)
                last = np.partition(bar, -k, axis=1)[:, -k] if len(items) >= k else np.full(len(bar), -np.inf)
                i, j = np.nonzero((score >= last[:, None] - SLACK) & (score > -np.inf))
                piece = max(1, (1 << 20) // max(width, 1))
                exact = np.empty(len(i))
                for p in range(0, len(i), piece):
                    x, y = j[p : p + piece], i[p : p + piece] + start
                    exact[p : p + piece] = _correlated(a[x], q[y], has_a[x] & has_q[y])
                found = pd.DataFrame({"at": i, "item": names[j], "similarity": exact}).dropna(subset=["similarity"])
                found = found.sort_values(["at", "similarity", "item"], ascending=[True, False, True]).groupby("at").head(k)
                out.append(pd.DataFrame({"query": queries["item"].to_numpy()[found["at"] + start], "item": found["item"], "similarity": found["similarity"]}))
        return pd.concat(out)

    return of


def nearest_of_each(response: DataFrame, queries: DataFrame | None = None, k: int = 5, block: int = 8192) -> DataFrame:
    """(query, item, similarity): for each item (or only those of `queries`) its k most correlated items. A response has one row an item and channel.

    Blocks of items meet blocks of queries as matrices in tasks, and only a query's k best leave a block. So what is
    shuffled are the vectors, once for each block of the other side; all pairs are compared, in memory of one pair of blocks.
    """
    vectors, width = _vectors(response)
    asked = vectors if queries is None else vectors.join(queries.select("item").distinct(), "item", "left_semi")
    size = max(16, min(block, (1 << 22) // max(width, 1)))
    n_items, n_asked = (max(1, -(-df.count() // size)) for df in (vectors, asked))
    at = lambda n: F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(at(n_items).alias("i"), every(n_asked).alias("q"), "item", "at", "x")
    right = asked.select(every(n_items).alias("i"), at(n_asked).alias("q"), "item", "at", "x")
    right = right.toDF("i", "q", "item", "at", "x")  # columns of its own, as both sides come from one table
    kind = vectors.schema["item"].dataType.simpleString()
    found = left.groupBy("i", "q").cogroup(right.groupBy("i", "q")).applyInPandas(_close(width, k), f"query {kind}, item {kind}, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), F.asc("item"))
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).drop("nth")
