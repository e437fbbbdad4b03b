"""Streams of edges and events: running fan-in, and windowed activity with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_fan_in(edges: DataFrame) -> DataFrame:
    """(dst, fan_in) of a stream of edges; edges are told apart by state, so that a repeated one doesn't count again."""
    return edges.select("src", "dst").dropDuplicates(["src", "dst"]).groupBy("dst").agg(F.count(F.lit(1)).alias("fan_in"))


def activity(events: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and value by type and window; rows later than the watermark don't count."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "value")
