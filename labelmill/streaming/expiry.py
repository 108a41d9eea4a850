"""A keyed snapshot whose rows expire, as a stream of changes from state with a time to live."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

_STATE = "at long, tie long, body string"


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    names = [f"_key{i}" for i in range(len(key))] + ["at", "tie", "body", "live"]
    if state.hasTimedOut:
        yield pd.DataFrame([(*key, *state.get, False)], columns=names)
        state.remove()
        return
    held = before = tuple(state.get) if state.exists else None
    for batch in batches:
        last = batch.sort_values(["at", "tie"]).iloc[-1]
        found = (int(last["at"]), int(last["tie"]), last["body"])
        held = found if held is None or found[:2] > held[:2] else held
    if held != before:
        state.update(held)
        yield pd.DataFrame([(*key, *held, True)], columns=names)
    # any time after its own is beyond the watermark, which runs a life behind the stream
    state.setTimeoutTimestamp(max(held[0] // 1000, state.getCurrentWatermarkMs()) + 1)


def live_changes(stream: DataFrame, keys: Sequence[str], written: str, tie: str, hours: int, lag_hours: int = 0) -> DataFrame:
    """Changes of the last row per key: with ``live`` true when it is replaced, with false when it expires.

    A row lives for ``hours`` after its ``written`` time; the stream's clock is the greatest time so far less
    ``lag_hours``.  The watermark runs a whole life behind that clock: a row older than it has expired and is passed
    over, any other counts however late it comes, and a key whose last row falls behind it leaves the state.  So the
    state holds the keys of one life.  Ties in time go to the greater ``tie``.  A key's rows of one batch are folded in
    its own order, some at a time, and keep one row.
    """
    rest = [c for c in stream.columns if c not in (*keys, written, tie)]
    rows = stream.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        F.col(written).cast("timestamp").alias("_written"),
        F.unix_micros(F.col(written).cast("timestamp")).alias("at"),
        F.col(tie).cast("long").alias("tie"),
        F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("body"),
    )
    by = [f"_key{i}" for i in range(len(keys))]
    own = [rows.schema[k] for k in by]
    schema = StructType([*own, *StructType.fromDDL(f"{_STATE}, live boolean").fields])
    rows = rows.withWatermark("_written", f"{hours + lag_hours} hours")
    changes = rows.groupBy(*by).applyInPandasWithState(_newest, schema, StructType.fromDDL(_STATE), "update", GroupStateTimeout.EventTimeTimeout)
    body = F.from_json("body", StructType([stream.schema[c] for c in rest])).alias("body")
    changes = changes.select(*by, F.timestamp_micros("at").alias(written), F.col("tie").alias(tie), body, "live")
    return changes.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], written, tie, *[F.col("body")[c].alias(c) for c in rest], "live")
