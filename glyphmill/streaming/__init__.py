"""Streams: all column functions are stateless and run on a stream as they do on a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def apply_to_stream(stream: DataFrame, functions: dict[str, Callable[[Column], Column]], column: str = "text") -> DataFrame:
    """The stream with a further column for each function of `column`."""
    return stream.select("*", *[f(F.col(column)).alias(name) for name, f in functions.items()])


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and key; windows close when the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), F.col(key)).agg(F.count("*").alias("n"))


def write_stream(stream: DataFrame, path: str, checkpoint: str, kind: str = "json") -> StreamingQuery:
    """Write what has arrived and stop; a restart goes on from the checkpoint."""
    return stream.writeStream.format(kind).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
