"""Dose-response curves: series, mixtures, noise and fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hill, logspace
from .encoding import normal, poisson

# Parameters used for too few points.
DEFAULT_EC50, DEFAULT_N = 0.1, 1.0


def evaluate(doses: DataFrame) -> DataFrame:
    """doses (..., concentration, r_max, ec50, n, base) with the curve's response."""
    return doses.withColumn("response", hill(*[F.col(c) for c in ("concentration", "r_max", "ec50", "n", "base")]))


def series(items: DataFrame, low: float = 1e-3, high: float = 1.0, points: int = 10) -> DataFrame:
    """items (item, r_max, ec50, n, base) at `points` concentrations."""
    return evaluate(items.withColumn("concentration", F.explode(logspace(low, high, points))))


def mixture(parts: DataFrame, kind: str = "additive") -> DataFrame:
    """(mix, response) of components (mix, component, concentration, r_max, ec50, n, base): their sum, their greatest, or the sum times 1 + 0.5 for each component. A null concentration is 0."""
    r = evaluate(parts.withColumn("concentration", F.coalesce("concentration", F.lit(0.0)))).groupBy("mix")
    if kind == "additive":
        return r.agg(F.sum("response").alias("response"))
    if kind == "competitive":
        return r.agg(F.max("response").alias("response"))
    if kind == "synergistic":
        return r.agg((F.sum("response") * (1 + 0.5 * F.count("*"))).alias("response"))
    raise ValueError(f"unknown kind of mixture: {kind!r}")


def noisy(doses: DataFrame, kind: str = "gaussian", level: float = 0.1, keys: tuple[str, ...] = ("item", "concentration"), seed: int = 42) -> DataFrame:
    """Responses with noise, none below 0."""
    r, z = F.col("response"), normal(*keys, seed=seed)
    if kind == "gaussian":
        new = r + z * level
    elif kind == "poisson":
        new = poisson(r * 100, *keys, seed=seed) / 100
    elif kind == "lognormal":
        new = r * F.exp(z * level)
    else:
        raise ValueError(f"unknown noise {kind!r}")
    return doses.withColumn("response", F.greatest(new, F.lit(0.0)))


def fit_curve(c: np.ndarray, r: np.ndarray, rounds: int = 200) -> tuple[float, float, float, float]:
    """(r_max, ec50, n, base) of the least squares by damped Gauss-Newton steps inside a box; the first guess where that fails."""
    ok = np.isfinite(c) & np.isfinite(r) & (c > 0)
    c, r = c[ok], r[ok]
    if len(c) < 3:
        return (float(r.max()) if len(r) else 1.0, DEFAULT_EC50, DEFAULT_N, 0.0)
    low = np.array([0.0, 0.1 * c.min(), 0.1, -1.0])
    high = np.array([max(2 * r.max(), 1e-9), 10 * c.max(), 10.0, max(r.max(), -1 + 1e-9)])
    guess = np.clip([r.max(), np.median(c), 1.0, r.min()], low, high)

    def curve(p):
        x = (c / p[1]) ** p[2]
        return p[3] + p[0] * x / (1 + x)

    def slopes(p):
        step = 1e-6 * np.maximum(np.abs(p), 1e-3)
        return np.stack([(curve(p + d) - curve(p - d)) / (2 * s) for d, s in zip(np.diag(step), step)], 1)

    p, damp = guess.copy(), 1e-3
    error = ((r - curve(p)) ** 2).sum()
    for _ in range(rounds):
        j = slopes(p)
        h = j.T @ j
        try:
            new = np.clip(p + np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), j.T @ (r - curve(p))), low, high)
        except np.linalg.LinAlgError:
            return tuple(map(float, guess))
        now = ((r - curve(new)) ** 2).sum()
        if now < error:
            done = error - now < 1e-12 * max(error, 1e-300)
            p, error, damp = new, now, damp / 4
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return tuple(map(float, p)) if np.isfinite(p).all() else tuple(map(float, guess))


def fit(doses: DataFrame) -> DataFrame:
    """(item, r_max, ec50, n, base, n_points): a curve for each item's (concentration, response) rows.

    Points are brought together as two lists an item (a dose series is short), and fitted in Arrow batches of items.
    """
    points = doses.filter("concentration is not null and response is not null").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("concentration", "response"))).alias("points"))
    own = points.select("item", F.col("points.concentration").alias("c"), F.col("points.response").alias("r"))
    kind = own.schema["item"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fits = [fit_curve(np.asarray(c, float), np.asarray(r, float)) for c, r in zip(f.c, f.r)]
            out = pd.DataFrame(fits, columns=["r_max", "ec50", "n", "base"])
            out.insert(0, "item", f.item.values if not callable(f.item) else f["item"].values)
            out["n_points"] = [len(c) for c in f.c]
            yield out

    return own.mapInPandas(run, f"item {kind}, r_max double, ec50 double, n double, base double, n_points int")
