"""The request analytics as streams: the same groups, kept up with an event log that grows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 4, glob: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream, a few in each step."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Count, errors and total of each window and type. State of a window ends when the watermark has passed it."""
    rows = stream.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type")
    rows = rows.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "errors", F.round("total", 4).alias("total"))


def deduplicated(stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Each event once, as long as its repeats come within the lateness."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


_LATEST = "n long, last_ts timestamp, last_event long, last_type string"
_SHOWN = "user_id long, n long, last_event long, last_type string, expired boolean"


def _row(user: Any, n: int, last_event: int, last_type: str, expired: bool) -> pd.DataFrame:
    return pd.DataFrame({"user_id": [user], "n": [n], "last_event": [last_event], "last_type": [last_type], "expired": [expired]})


def _state_of(idle_ms: int | None):
    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last_ts, last_event, last_type = state.get if state.exists else (0, pd.Timestamp(0), -1, "")
        if state.hasTimedOut:
            state.remove()
            yield _row(key[0], n, last_event, last_type, True)
            return
        for pdf in batches:
            n += len(pdf)
            top = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            if (top.ts, top.event_id) > (last_ts, last_event):
                last_ts, last_event, last_type = top.ts, int(top.event_id), top.event_type
        state.update((n, last_ts, last_event, last_type))
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(int(last_ts.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield _row(key[0], n, last_event, last_type, False)

    return run


def keyed_state(stream: DataFrame, idle_minutes: int | None = None, lateness: str = "2 hours") -> DataFrame:
    """The running state of each user: events so far and the last of them. A few values a key are kept, never its events.

    With ``idle_minutes`` the state of a user is dropped, and put out once more as expired, when the watermark is that far past the last event of the user;
    a user that comes back begins anew.
    """
    if idle_minutes is not None:
        stream = stream.withWatermark("ts", lateness)
    wait = GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.EventTimeTimeout
    rows = stream.select("user_id", "ts", "event_id", "event_type").groupBy("user_id")
    return rows.applyInPandasWithState(_state_of(None if idle_minutes is None else idle_minutes * 60_000), _SHOWN, _LATEST, "update", wait)


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into files of a shared folder, and read them."""
    if mode == "append":
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    else:

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/step={number}")

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/rows")
