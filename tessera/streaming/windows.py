"""Windowed views of an event stream. Every function takes a batch or a streaming DataFrame.

On a stream give ``watermark``: late rows beyond it are dropped and state behind it is freed; on a batch it has no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def _marked(events: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    return events.withWatermark(ts, watermark) if watermark and events.isStreaming else events


def tumbling(events: DataFrame, width: str, keys: list[str], *, ts: str = "ts", value: str = "value", watermark: str | None = None) -> DataFrame:
    e = _marked(events, ts, watermark)
    g = e.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(38,6)")).cast("double").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, step: str, keys: list[str], *, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    e = _marked(events, ts, watermark)
    g = e.groupBy(F.window(ts, width, step), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str, *, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    e = _marked(events, ts, watermark)
    g = e.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def distinct_events(events: DataFrame, key: str, *, ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """First row of each key; on a stream within the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


class _RunningState(StatefulProcessor):
    """Keyed state: events seen and last known type of a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("n", T.LongType()), T.StructField("last_type", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.seen.get() if self.seen.exists() else (0, None)
        for part in rows:
            part = part.sort_values("ts", kind="stable")
            n += len(part)
            known = part["event_type"].dropna()
            last = known.iloc[-1] if len(known) else last
        self.seen.update((n, last))
        yield pd.DataFrame({"key": [key[0]], "n_seen": [n], "last_type": [last]})

    def close(self) -> None:
        pass


def running_state(events: DataFrame, key: str) -> DataFrame:
    """(key, n_seen, last_type) after each batch of a stream: a custom stateful operator. events: key, ts, event_type."""
    schema = T.StructType([T.StructField("key", events.schema[key].dataType), T.StructField("n_seen", T.LongType()), T.StructField("last_type", T.StringType())])
    return events.groupBy(key).transformWithStateInPandas(statefulProcessor=_RunningState(), outputStructType=schema, outputMode="Update", timeMode="None")
