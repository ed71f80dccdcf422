"""Pulses on disk: appended tables, checkpoints that never move back, truncation, and what is told after each pulse."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def append_batch(df: DataFrame, path: str) -> None:
    """Appends rows: all of them are there, or none."""
    df.write.mode("append").parquet(path)


def pulse_ids(spark: SparkSession, path: str) -> list[int]:
    """The pulses that streaming.windows.pulses has written to a folder."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[6:]) for n in names if n.startswith("pulse=") and n[6:].isdigit())


def checkpointed(spark: SparkSession, path: str) -> int:
    """The last pulse that a checkpoint covers; -1: none."""
    p, fs = _folder(spark, f"{path}/_checkpoint")
    return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=-1) if fs.exists(p) else -1


def write_checkpoint(spark: SparkSession, path: str, pulse_id: int) -> int:
    """Covers the pulses up to one; a checkpoint never moves back. Gives the one that holds."""
    now = checkpointed(spark, path)
    if pulse_id > now:
        p, fs = _folder(spark, f"{path}/_checkpoint/{pulse_id}")
        fs.create(p, True).close()
    return max(now, pulse_id)


def truncate(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Deletes the pulses before `keep`, which stays with all after it. Gives those that went."""
    gone = [k for k in pulse_ids(spark, path) if k < keep]
    for k in gone:
        p, fs = _folder(spark, f"{path}/pulse={k}")
        fs.delete(p, True)
    return gone


class PulseListener(StreamingQueryListener):
    """Calls `done(batch_id, rows, bytes_per_second)` after each batch of the queries; what it raises is logged and goes no further."""

    def __init__(self, done: Callable[[int, int, float], None]):
        self.done = done

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        try:
            self.done(event.progress.batchId, event.progress.numInputRows, event.progress.processedRowsPerSecond)
        except Exception:
            log.exception("pulse callback failed")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@dataclass
class SensorAdapter:
    """A sensor as a source of events: its modality, the time, source and tags of a parsed line, and the columns that it keeps."""

    modality: str
    ts_us: Column
    tags: Column
    keep: tuple[str, ...] = ()

    def events(self, rows: DataFrame) -> DataFrame:
        """(ts_us, source_id, tags, metadata) of rows, batch or stream; rows without a time are no events."""
        pairs = [x for c in self.keep for x in (F.lit(c), F.col(c).cast("string"))]
        metadata = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        return rows.select(self.ts_us.alias("ts_us"), F.lit(self.modality).alias("source_id"), self.tags.alias("tags"), metadata.alias("metadata")).where("ts_us is not null")


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, topic: str = "topic"):
    """Publishes each micro-batch to the sinks by topic; a batch is read once. Rows of other topics go nowhere."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for name, sink in sinks.items():
                sink(held.where(F.col(topic) == name), batch_id)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
