"""Stateless queries over a stream, and event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import Engine


def query_stream(stream: DataFrame, text: str, name: str = "stream") -> DataFrame:
    """A query over ``$.<name>`` as a streaming DataFrame. Filters, projections
    and groups work; what needs an order or a join with itself does not."""
    return Engine(stream.sparkSession).table(name, stream).query(text)


def windowed(stream: DataFrame, time: str, size: str, late: str, keys: list[str], aggs: dict[str, object], slide: str | None = None) -> DataFrame:
    """Aggregates by event-time window and keys; rows later than ``late`` after
    the newest time are dropped, and so is the state of windows that far back."""
    span = F.window(time, size, slide) if slide else F.window(time, size)
    got = stream.withWatermark(time, late).groupBy(span.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggs)


def sessions(stream: DataFrame, time: str, gap: str, late: str, keys: list[str], aggs: dict[str, object]) -> DataFrame:
    """As windowed, by sessions that end after ``gap`` without a row."""
    got = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggs)
