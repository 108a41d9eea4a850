"""Stateful streams: the first arrival of every key within a delay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def first_arrivals(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """The row of every key that arrives first; later ones go as long as their event times lie within ``delay``.

    A row whose event time lies more than ``delay`` behind the greatest one of
    earlier batches comes too late and goes as well: its key may be forgotten
    by then.  State is one entry for each key of the last ``delay``, kept by a
    hash of the keys, so neither a common user nor a long stream makes it grow.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_once(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a folder of Parquet files and stop; the checkpoint goes on from there."""
    return (
        stream.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
