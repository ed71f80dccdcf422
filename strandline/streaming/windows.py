"""Structured Streaming forms: tumbling fusion, first-row windows, time buffers, idle timers, first-seen rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fusion import FUSED_SOURCES, aggregate_windows, correlated


def fused(stream: DataFrame, seconds: int = 1, delay: str = "5 seconds", ts: str = "ts") -> DataFrame:
    """Tumbling windows of events (`ts` timestamp, and the columns of the batch form) with the aggregates and correlations of the
    batch form, of all events. Rows later than the watermark are dropped; a window is emitted once, when it has passed."""
    known = stream.where(F.col("source").isin(*FUSED_SOURCES))
    out = aggregate_windows(known.withWatermark(ts, delay).groupBy(F.window(ts, f"{seconds} seconds")))
    key = F.floor(F.unix_micros("window.start") / (seconds * 1_000_000)).alias("window_key")
    return correlated(out.select(key, *[c for c in out.columns if c != "window"]))


def first_seen(stream: DataFrame, key: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def first_row_windows(stream: DataFrame, key: str, span_us: int = 1_000_000) -> DataFrame:
    """(key, start_us, n): windows that open with a row and close with the first row span_us or more after it, which opens the
    next one; rows (key string, ts_us long) in time order."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        out = []
        for t in sorted(x for b in batches for x in b["ts_us"].tolist()):
            if start is not None and t - start >= span_us:
                out.append((k[0], start, n))
                start, n = None, 0
            start, n = (t if start is None else start), n + 1
        state.update((start, n))
        yield pd.DataFrame(out, columns=["key", "start_us", "n"])

    return stream.select(F.col(key).cast("string").alias("key"), "ts_us").groupBy("key").applyInPandasWithState(step, "key string, start_us long, n long", "start long, n long", "append", GroupStateTimeout.NoTimeout)


def idle_alerts(stream: DataFrame, key: str, idle: int = 50, stalled: int = 100) -> DataFrame:
    """(key, poll, state): idle and stalled, once each, at so many polls (key, poll long, size long) without growth."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, quiet = state.get if state.exists else (None, 0)
        out = []
        for _, r in pd.concat(list(batches)).sort_values("poll").iterrows():
            grew = size is None or r["size"] > size
            quiet, size = (0 if grew else quiet + 1), int(r["size"])
            if quiet in (idle, stalled):
                out.append((k[0], int(r["poll"]), "idle" if quiet == idle else "stalled"))
        state.update((size, quiet))
        yield pd.DataFrame(out, columns=["key", "poll", "state"])

    return stream.select(F.col(key).cast("string").alias("key"), "poll", "size").groupBy("key").applyInPandasWithState(step, "key string, poll long, state string", "size long, quiet long", "append", GroupStateTimeout.NoTimeout)


def pulses(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends every micro-batch as one pulse: Parquet files with pulse_id, exactly once by the batch's number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("pulse_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/pulse={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def time_buffer(df: DataFrame, seconds: float, ts: str = "ts_us") -> DataFrame:
    """Rows not older than `seconds` before the newest, in time order."""
    newest = df.agg(F.max(ts).alias("_new"))
    return df.crossJoin(F.broadcast(newest)).where(F.col(ts) >= F.col("_new") - int(seconds * 1_000_000)).drop("_new").orderBy(ts)  # one row
