"""Filters, counts and statistics over stored windows (columns score, success, flags, session_id, pulse_id, ts_us)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score(c: str = "score") -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def where(df: DataFrame, predicate: Column | str | Callable) -> DataFrame:
    """A Column or SQL string; a callable is taken as a function of the DataFrame that gives one."""
    return df.filter(predicate(df) if callable(predicate) and not isinstance(predicate, Column) else predicate)


def where_flag(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), flag))


def time_range(df: DataFrame, start: Column | int, end: Column | int, ts: str = "ts_us") -> DataFrame:
    """Both ends inclusive."""
    return df.filter(F.col(ts).between(start, end))


def score_above(df: DataFrame, t: float) -> DataFrame:
    return df.filter(score() > t)


def score_below(df: DataFrame, t: float) -> DataFrame:
    return df.filter(score() <= t)


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    """None: no limit; 0 or less: no rows."""
    return df if limit is None else df.limit(max(0, limit))


def windows_with_flag(df: DataFrame, flag: str, threshold: float | None = None, limit: int | None = None) -> DataFrame:
    out = where_flag(df, flag)
    return limited(out if threshold is None else score_above(out, threshold), limit)


def last_n_minutes(df: DataFrame, now_us: Column | int, minutes: float, threshold: float | None = None) -> DataFrame:
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    out = time_range(df, now - int(minutes * 60_000_000), now)
    return out if threshold is None else score_above(out, threshold)


def manipulation_since(df: DataFrame, now_us: Column | int, minutes: float) -> DataFrame:
    """Rows over 0.5 of the last minutes, with no bound above: rows of the future count."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    return score_above(df.filter(F.col("ts_us") >= now - int(minutes * 60_000_000)), 0.5)


def success_only(df: DataFrame) -> DataFrame:
    return df.filter("success")


def failures_only(df: DataFrame) -> DataFrame:
    return df.filter("not success")


def events_in_range(df: DataFrame, start: Column | int, end: Column | int, source: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Events from start to end, both inclusive, of a source, with all of the tags, in order of time, then of insertion."""
    out = time_range(df, start, end)
    out = out if source is None else out.filter(F.col("operator") == source)
    out = with_all_tags(out, tags) if tags else out
    return out.orderBy("ts_us", "seq")


def event_by_id(df: DataFrame, event_id: int, key: str = "seq") -> DataFrame:
    return df.filter(F.col(key) == event_id)


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def time_series(df: DataFrame) -> DataFrame:
    return df.select("ts_us", score().alias("score"))


def with_all_tags(df: DataFrame, tags: list[str], column: str = "flags") -> DataFrame:
    return df.filter(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.col(column))) == 0)


def flag_frequency(df: DataFrame) -> DataFrame:
    return df.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def score_stats(df: DataFrame) -> DataFrame:
    s = score()
    return df.agg(*[F.coalesce(f(s), F.lit(0.0)).alias(n) for f, n in ((F.min, "min_score"), (F.max, "max_score"))], F.round(F.coalesce(F.avg(s), F.lit(0.0)), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def session_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("session_id", F.lit("unknown")).alias("session_id")).agg(F.count(F.lit(1)).alias("n"))


def success_split(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.round(F.try_divide(100.0 * F.count_if("success"), n), 6).alias("ok_pct"))


def session_summaries(df: DataFrame) -> DataFrame:
    """A row for each session that has a name, with its most and its highest scores and a histogram of operators."""
    named = df.filter(F.coalesce("session_id", F.lit("")) != "")
    by_op = named.groupBy("session_id", "operator").agg(F.count(F.lit(1)).alias("k"), F.sum(score()).alias("s"), F.max(score()).alias("top"), F.count_if(score() > 0.5).alias("m"), F.count_if(score() > 0.75).alias("h"))
    n = F.sum("k")
    return by_op.groupBy("session_id").agg(
        n.alias("n"), F.round(F.sum("s") / n, 6).alias("avg_score"), F.max("top").alias("max_score"), F.sum("m").alias("manipulated"), F.sum("h").alias("high_confidence"),
        F.round(100.0 * F.sum("m") / n, 6).alias("manipulation_rate"), F.round(100.0 * F.sum("h") / n, 6).alias("high_rate"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "operator", F.col("k").cast("string")))), ",").alias("operators"),
    )


def bursts(df: DataFrame, threshold: float, gap_us: int, least: int, partition_by: list[str] | None = None, bucket_us: int = 3_600_000_000, record_order: bool = False, bucket_rows: int = 100_000) -> DataFrame:
    """Islands of anomalies, each at most gap_us after the one before it, of `least` rows or more; in time order, or in the order of records
    (`seq`), where a step back in time is no gap. Global unless partition_by is given.

    Rows are ordered within buckets of time, or of records; only a row per bucket is ordered in one task, to carry islands over its ends."""
    by = partition_by or []
    place = [*by, "_bucket"]
    order = ["seq"] if record_order else ["ts_us", "seq"]
    rows, ends = Window.partitionBy(*place).orderBy(*order), Window.partitionBy(*by).orderBy("_bucket")
    bucket = F.floor(F.col("seq") / bucket_rows) if record_order else F.floor(F.col("ts_us") / bucket_us)
    hit = score_above(df, threshold).where("ts_us is not null").withColumn("_bucket", bucket)
    hit = hit.withColumn("_back", F.col("ts_us") - F.lag("ts_us").over(rows))
    fresh = (F.col("_back") > gap_us).cast("long")
    hit = hit.withColumn("_local", F.coalesce(F.sum(fresh).over(rows), F.lit(0))).withColumn("_o", F.struct(*order))
    parts = hit.groupBy(*place, "_local").agg(F.min(F.struct("_o", "ts_us")).alias("_a"), F.max(F.struct("_o", "ts_us")).alias("_z"), F.count(F.lit(1)).alias("n"), F.max(score()).alias("peak"), F.collect_set("operator").alias("_ops"))
    edges = parts.groupBy(*place).agg(F.min("_a").alias("_first"), F.max("_z").alias("_last"), F.max("_local").alias("_top"))
    joined = F.coalesce(F.col("_first.ts_us") - F.lag("_last.ts_us").over(ends) <= gap_us, F.lit(False))
    edges = edges.withColumn("_step", F.col("_top") + 1 - joined.cast("long")).withColumn("_base", F.sum("_step").over(ends) - F.col("_top"))
    base = edges.select(*[F.col(c).alias(f"_at_{c}") for c in place], "_base")
    whole = parts.join(base, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in place]).withColumn("_island", F.col("_base") + F.col("_local"))
    out = whole.groupBy(*by, "_island").agg(F.min("_a")["ts_us"].alias("start_us"), F.max("_z")["ts_us"].alias("end_us"), F.sum("n").alias("n"), F.max("peak").alias("peak"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ops")))), ",").alias("operators"))
    return out.where(F.col("n") >= least).drop("_island")


def session_summary(df: DataFrame, session_id: str) -> DataFrame:
    """The summary of one session; a row of zeros where it has no window."""
    one = session_summaries(df.filter(F.col("session_id") == session_id))
    asked = df.sparkSession.range(1).select(F.lit(session_id).alias("_id"))
    out = asked.join(one, F.col("_id") == F.col("session_id"), "left").drop("session_id").withColumnRenamed("_id", "session_id")
    return out.na.fill(0).na.fill("")


def all_sessions(df: DataFrame, limit: int | None = None) -> DataFrame:
    """All summaries in the order in which the sessions were first seen."""
    first = df.groupBy("session_id").agg(F.min("seq").alias("first_seq"))
    return limited(session_summaries(df).join(first, "session_id").orderBy("first_seq"), limit)


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def nth(df: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The n-th row of every group, counted from 1; groups of fewer rows have none."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") == n).drop("_rn")


def read_many(df: DataFrame, key: str, wanted: list[int]) -> DataFrame:
    """The rows with the wanted keys in the wanted order, once for each time a key is wanted; keys that are not there are left
    out. The list comes with the call, and its keys reach the scan as a filter."""
    if not wanted:
        return df.limit(0).withColumn("place", F.lit(0))
    asked = df.sparkSession.range(1).select(F.posexplode(F.lit(list(wanted))).alias("place", "_key"))
    return df.where(F.col(key).isin(list(dict.fromkeys(wanted)))).join(asked, F.col(key) == F.col("_key")).drop("_key").orderBy("place")
