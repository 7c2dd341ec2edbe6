"""Running counts over streams; the batch operators need no stream, these keep their tables fresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(stream: DataFrame) -> DataFrame:
    """(channel, n_tested, n_active, total) of a stream of (item, channel, response), to be written in update mode."""
    r = F.col("response")
    return stream.groupBy("channel").agg(F.count(r).alias("n_tested"), F.count_if(r > 0.1).alias("n_active"), F.sum(r).alias("total"))


def windowed(stream: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(start, key, n, mean) by event time; a window is final once the stream is `late` past it, and later rows are dropped."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width), key)
    return rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")
