"""Events as they are recorded: numbers, records, clocks, bounds and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a stream and the whole timeline keep, and names in the record of an event.
STREAM_ROWS, TIMELINE_ROWS = 10_000, 50_000
ENGINE, TRANSFORM = "event_pipeline_v1", "sensor_event"


def numbered(df: DataFrame, order: list[str], name: str = "n", bucket_us: int = 3_600_000_000, ts: str = "ts_us") -> DataFrame:
    """Adds `name`: the place of each row in the order (by `ts` first), from 1. Rows are ordered within buckets of time; only a row a bucket is
    ordered in one task."""
    d = df.withColumn("_bucket", F.floor(F.col(ts) / bucket_us))
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy("_bucket").orderBy(ts, *[c for c in order if c != ts])))
    sizes = d.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("_bucket").alias("_at"), before.alias("_before"))
    return d.join(sizes, F.col("_bucket").eqNullSafe(F.col("_at"))).withColumn(name, F.col("_rn") + F.col("_before")).drop("_bucket", "_rn", "_at", "_before")


def created(df: DataFrame, order: list[str]) -> DataFrame:
    """Events as they are created from sensor rows (ts_us, source_id, tags, metadata): an id by their number, never null tags and metadata."""
    d = numbered(df, order, "counter")
    return d.select(
        F.format_string("evt_%08d", F.col("counter")).alias("event_id"), "counter", "ts_us", "source_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata")
    )


def as_records(events: DataFrame) -> DataFrame:
    """Created events as records: the counter is pulse and sequence number, the worker a hash of the source, tags are parameters."""
    worker = F.pmod(F.crc32("source_id"), F.lit(256)).cast("int")
    return events.select(
        F.col("counter").alias("pulse_id"), worker.alias("worker_id"), F.col("counter").alias("seq"), (F.col("ts_us") / 1e6).alias("timestamp"), F.lit(True).alias("success"), F.col("source_id").alias("task_id"), F.lit(ENGINE).alias("engine_id"),
        F.lit(TRANSFORM).alias("transform_id"), F.lit(None).cast("string").alias("failure_reason"), F.array(F.lit(0), F.lit(0)).alias("grid_shape_in"), F.array(F.lit(0), F.lit(0)).alias("grid_shape_out"), F.lit(0).alias("color_count"),
        F.array().cast("array<int>").alias("train_pair_indices"), F.create_map().cast("map<string,double>").alias("error_metrics"), F.to_json(F.struct("tags")).alias("params"), F.to_json("metadata").alias("context"),
    )


def retained(df: DataFrame, stream: str, order: list[str], per_stream: int = STREAM_ROWS, whole: int = TIMELINE_ROWS) -> DataFrame:
    """The events that bounded streams keep: the newest of each stream, and of all of them the newest."""
    newest = Window.partitionBy(stream).orderBy(*[F.desc(c) for c in order])
    kept = df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= per_stream).drop("_rn")
    return kept.orderBy(*[F.desc(c) for c in order]).limit(whole)


def monotone_guard(df: DataFrame, stream: str, order: list[str], ts: str = "ts_us") -> DataFrame:
    """Adds `late`: the row's time is before that of the row before it in its stream."""
    w = Window.partitionBy(stream).orderBy(*order)
    return df.withColumn("late", F.coalesce(F.col(ts) < F.lag(ts).over(w), F.lit(False)))


def synchronised(df: DataFrame, sessions: DataFrame, session: str = "session_id", ts: str = "ts_us") -> DataFrame:
    """Adds to every event its session's start (session_id, session_us), its own epoch, the milliseconds between, and the ISO text."""
    d = df.join(sessions.select(session, "session_us"), session)
    return d.withColumns({"session_epoch": F.col("session_us") / 1e6, "event_epoch": F.col(ts) / 1e6, "event_offset_ms": F.round((F.col(ts) - F.col("session_us")) / 1000.0, 3), "timestamp_iso": F.date_format(F.timestamp_micros(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")}).drop("session_us")


def sampled(df: DataFrame, sensor: str, hz: float, ts: str = "ts_us") -> DataFrame:
    """The polls that a scheduler takes at most `hz` times a second: the first of each step of time; none at 0."""
    if hz <= 0:
        return df.limit(0)
    step = F.floor(F.col(ts) / int(1_000_000 / hz))
    return df.withColumn("_step", step).withColumn("_rn", F.row_number().over(Window.partitionBy(sensor, "_step").orderBy(ts))).where("_rn = 1").drop("_step", "_rn")


def produced(df: DataFrame, session_id: str, source: str) -> DataFrame:
    """A producer's rows with session, time and source filled in where the caller has not set them."""
    out = df
    for name, value in (("session_id", F.lit(session_id)), ("source", F.lit(source)), ("timestamp", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))):
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return out


def drop_oldest(df: DataFrame, topic: str, order: list[str], size: int = 1024) -> DataFrame:
    """(topic, published, dropped, kept): what a topic's queue of `size` rows holds of all that were published without a reader."""
    n = F.count(F.lit(1))
    return df.groupBy(topic).agg(n.alias("published"), F.greatest(F.lit(0), n - size).alias("dropped"), F.least(F.lit(size), n).alias("kept"))
