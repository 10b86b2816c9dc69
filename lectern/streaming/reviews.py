"""Streaming forms of two batch operators; an extension of our own.

``latest_state`` keeps each key's last committed event; ``first_seen_stream``
lets only the first row of a key through, as far back as its watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_state(events: DataFrame, *, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """An updating table of each key's last event; one state row a key."""
    last = F.max(F.struct(*order, *[F.col(p).alias(f"_{p}") for p in payload])).alias("last")
    return events.groupBy(key).agg(last).select(key, *[F.col(f"last._{p}").alias(p) for p in payload])


def first_seen_stream(rows: DataFrame, *, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key didn't come before within ``delay``; state is dropped behind the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, *, time: str, kind: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """All that has arrived, into a table in memory; for tests and small reports."""
    query = (
        stream.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
