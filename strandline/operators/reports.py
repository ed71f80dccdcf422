"""Reports over stored windows, blocks and streams: counts, bands, ranks and summaries, each one DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import nearest_join

#: Bounds of high and medium scores in combat reports.
HIGH, MEDIUM = 0.7, 0.4


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


def frequency(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(_n())


def most_common(df: DataFrame, key: str, k: int, order: str = "ord") -> DataFrame:
    """The k most frequent values with their counts, the first seen of equal ones; nulls count as `unknown`."""
    one = df.select(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key), F.col(order).alias("_o"))
    return one.groupBy(key).agg(_n(), F.min("_o").alias("_first")).orderBy(F.desc("n"), "_first").limit(k).select(key, "n")


def pulse_batches(df: DataFrame) -> DataFrame:
    return df.groupBy("pulse_id").agg(_n(), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count_distinct("worker_id").alias("workers"))


def recent_pulses(df: DataFrame, last: int = 5) -> DataFrame:
    """Of the `last` newest pulses: rows, failures and their part by worker, and the distinct flags."""
    top = df.agg((F.max("pulse_id") - last).alias("_from"))
    d = df.crossJoin(F.broadcast(top)).where(F.col("pulse_id") > F.col("_from"))  # one row
    flags = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))), ",").alias("flags")
    failed = F.count_if(~F.col("success"))
    return d.groupBy("worker_id").agg(_n(), failed.alias("failed"), F.round(100.0 * failed / F.count(F.lit(1)), 6).alias("failed_pct"), F.count_distinct("operator").alias("operators"), flags)


def chain_events(chains: DataFrame, events: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """The live events of every chain with their `place` in time order; ids without an event are left out."""
    return chains.join(events, chain).withColumn("place", F.row_number().over(Window.partitionBy(chain).orderBy(*order)))


def chain_bounds(events: DataFrame, chain: str, ts: str) -> DataFrame:
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.groupBy(chain).agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("starts"), F.max(ts).alias("ends"), ((F.max(micros) - F.min(micros)) / 1_000_000).cast("long").alias("seconds"))


def anchor_distribution(anchors: DataFrame) -> DataFrame:
    score = F.coalesce("score", F.lit(0.0))
    return anchors.groupBy("anchor_type").agg(_n(), F.round(F.avg(score), 6).alias("mean_score"), F.max(score).alias("max_score"), F.min(score).alias("min_score"))


def anchor_flags(anchors: DataFrame, records: DataFrame) -> DataFrame:
    """Flags of the anchors' own records, by type of anchor."""
    own = anchors.join(records.select(F.col("seq").alias("anchor_id"), "flags"), "anchor_id")
    return own.select("anchor_type", F.explode("flags").alias("flag")).groupBy("anchor_type", "flag").agg(_n())


def by_hour(anchors: DataFrame, high: float = 0.9) -> DataFrame:
    hour = F.floor(F.col("anchor_us") / 3_600_000_000 % 24).cast("int").alias("hour")
    return anchors.groupBy(hour).agg(_n(), F.count_if(F.col("score") > high).alias("high"))


def timeline_stats(streams: DataFrame) -> DataFrame:
    span = F.max("ts_us") - F.min("ts_us")
    return streams.groupBy("modality").agg(_n(), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.round(F.try_divide(F.count(F.lit(1)) * 1e6, span), 6).alias("per_second"))


def network_activity(events: DataFrame, k: int = 10) -> DataFrame:
    """(kind, value, n): connections by process and remote port (the k most frequent, the first seen of equal ones; no port, or 0, is left out),
    and by state and protocol (all). Columns: process, state, protocol, port, ord; nulls are `unknown`."""
    named = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), named(c).alias("value")) for c in ("process", "state", "protocol")], F.when(F.col("port") != 0, F.struct(F.lit("port").alias("kind"), F.col("port").cast("string").alias("value"))))
    counted = events.select("ord", F.explode(F.array_compact(pairs)).alias("p")).groupBy("p.kind", "p.value").agg(_n(), F.min("ord").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "_first"))
    return counted.withColumn("_rn", rank).where(F.col("kind").isin("state", "protocol") | (F.col("_rn") <= k)).select("kind", "value", "n")


def activity_context(events: DataFrame, k: int = 10, cut: int = 50) -> DataFrame:
    """(kind, value, n): focus events by process (all) and by window title, cut to `cut` characters, without empty ones (the k most frequent)."""
    title = F.substring(F.coalesce("title", F.lit("")), 1, cut)
    pairs = F.array(F.struct(F.lit("app").alias("kind"), F.coalesce("process", F.lit("unknown")).alias("value")), F.when(title != "", F.struct(F.lit("title").alias("kind"), title.alias("value"))))
    counted = events.select("ord", F.explode(F.array_compact(pairs)).alias("p")).groupBy("p.kind", "p.value").agg(_n(), F.min("ord").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "_first"))
    return counted.withColumn("_rn", rank).where((F.col("kind") == "app") | (F.col("_rn") <= k)).select("kind", "value", "n")


def fingerprint_stats(df: DataFrame, by: str = "operator", value: str = "score", order: str = "seq") -> DataFrame:
    """Mean, range, rows over 0 and over 0.9, and the time from the first row to the last one in the order of the file."""
    first, last = F.min_by("ts_us", order), F.max_by("ts_us", order)
    v = F.col(value)
    return df.groupBy(by).agg(F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("most"), F.min(v).alias("least"), F.count_if(v > 0).alias("triggered"), F.count_if(v > 0.9).alias("extreme"), (last - first).alias("span_us"))


def operator_fingerprints(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(operator, metric, n, mean, deviation, least, most): of the confidence `score` and each metric; a deviation of one value is 0."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in ["score", *metrics]])).alias("m")
    d = df.select("operator", each).select("operator", "m.metric", "m.v")
    return d.groupBy("operator", "metric").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 6).alias("deviation"), F.min("v").alias("least"), F.max("v").alias("most"))


def operator_flags(df: DataFrame) -> DataFrame:
    return df.select("operator", F.explode("flags").alias("flag")).groupBy("operator", "flag").agg(_n())


def combat_report(df: DataFrame) -> DataFrame:
    """By session: range and mean of scores, bands, seconds and windows a second."""
    s, span = F.col("score"), F.max("ts_us") - F.min("ts_us")
    bands = [F.count_if(s >= HIGH).alias("high"), F.count_if((s >= MEDIUM) & (s < HIGH)).alias("medium"), F.count_if(s < MEDIUM).alias("low")]
    return df.groupBy("session_id").agg(_n(), F.min(s).alias("least"), F.round(F.avg(s), 6).alias("mean"), F.max(s).alias("most"), *bands, span.alias("span_us"), F.round(F.try_divide(F.count(F.lit(1)) * 1e6, span), 6).alias("per_second"))


def combat_flags(df: DataFrame) -> DataFrame:
    """By session and flag: windows and their percentage of the session's, with the place by number, then by name."""
    total = df.groupBy("session_id").agg(F.count(F.lit(1)).alias("_all"))
    flags = df.select("session_id", F.explode("flags").alias("flag")).groupBy("session_id", "flag").agg(_n())
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "flag"))
    return flags.join(total, "session_id").select("session_id", "flag", "n", F.round(100.0 * F.col("n") / F.col("_all"), 6).alias("pct"), place.alias("place"))


def seal_sessions(df: DataFrame, threshold: float = 0.7, least: int = 3) -> DataFrame:
    """Sessions with `least` windows of the threshold or more: how many, the highest, and each offender in file order."""
    hit = df.where(F.col("score") >= threshold)
    out = hit.groupBy("session_id").agg(_n(), F.max("score").alias("peak"), F.array_sort(F.collect_list(F.struct("seq", "score"))).alias("offenders"))
    return out.where(F.col("n") >= least)


def daily_usage(df: DataFrame, ts: str, size: str, days: int = 7, fallback: int = 1 << 30) -> DataFrame:
    """(dt, bytes, mean_bytes): bytes of each day and the whole mean of the `days` days up to it; `fallback` where that is nothing."""
    d = df.groupBy(F.date_format(ts, "yyyyMMdd").alias("dt")).agg(F.sum(F.floor(size)).alias("bytes"))
    mean = F.floor(F.avg("bytes").over(Window.orderBy("dt").rowsBetween(1 - days, 0)))  # a row a day
    return d.withColumn("mean_bytes", F.when(F.coalesce(mean, F.lit(0)) > 0, mean).otherwise(F.lit(fallback)))


def evidence(df: DataFrame, threshold: float = 0.5, most: int = 20) -> DataFrame:
    """(session_id, n, mean, flags, findings): windows over the threshold, their flags, and the first `most` findings in order."""
    hit = df.where(F.col("score") > threshold)
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("ts_us", "seq"))
    first = hit.withColumn("_rn", rank).where(F.col("_rn") <= most).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("_rn", "seq", "operator", "score"))).alias("findings"))
    whole = hit.groupBy("session_id").agg(_n(), F.round(F.avg("score"), 6).alias("mean"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))).alias("flags"))
    return whole.join(first, "session_id")


def record_of_window(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The stored record of a detection window: success, reason, duration, engine, sorted flags and operators, and the kind of player."""
    bad = F.col("score") > threshold
    return df.select(
        "seq", "pulse_id", "worker_id", (F.col("ts_us") / 1e6).alias("timestamp"), (~bad).alias("success"), F.when(bad, "eomm_above_threshold").alias("failure_reason"), "session_id",
        ((F.col("end_us") - F.col("ts_us")) / 1000).cast("long").alias("window_duration_ms"), F.array_sort("flags").alias("flags"), F.array_sort(F.array_distinct("operators")).alias("operators"),
        F.coalesce(F.col("source") == "benchmark", F.lit(False)).alias("is_benchmark"), F.col("bot_difficulty").isNotNull().alias("is_baseline_bot"),
        (~F.coalesce(F.col("source") == "benchmark", F.lit(False)) & F.col("bot_difficulty").isNull()).alias("is_human"),
    )


def window_summary(detections: DataFrame, key: str, metrics: dict[str, list[str]]) -> DataFrame:
    """(key, composite, manipulation, flag_count, flags, operator_count, operators): a window's detections (operator, score, weight, flags and
    metric columns) summed up; of each operator its confidence to 3 digits and its key metrics to 2, as name=value."""
    shown = F.lit("")
    for op, names in metrics.items():
        parts = [F.concat(F.lit(f"{n}="), F.round(F.coalesce(F.col(n).cast("double"), F.lit(0.0)), 2).cast("string")) for n in names]
        shown = F.when(F.col("operator") == op, F.concat_ws(";", *parts)).otherwise(shown)
    one = F.struct("operator", F.round("score", 3).alias("confidence"), shown.alias("metrics"))
    w = F.sum("weight")
    g = detections.groupBy(key).agg(F.sum(F.col("score") * F.col("weight")).alias("_s"), w.alias("_w"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"), F.array_sort(F.collect_list(one)).alias("operators"))
    s = F.when(F.col("_w") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s") / F.col("_w")))).otherwise(0.0)
    return g.select(key, F.round(s, 3).alias("composite"), (s >= 0.5).alias("manipulation"), F.size("flags").alias("flag_count"), "flags", F.size("operators").alias("operator_count"), "operators")


def high_activity(detections: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Windows with `least` detections or more, their operators in order."""
    g = detections.groupBy(key).agg(F.count(F.lit(1)).alias("detections"), F.array_sort(F.collect_list("operator")).alias("operators"), F.max("score").alias("overall"))
    return g.where(F.col("detections") >= least)


def signature_events(windows: DataFrame, feature: str, operator: str, threshold: float = 0.5) -> DataFrame:
    """The detections of one operator in the windows (detections: array of structs with operator and confidence) whose feature is over the
    threshold."""
    hit = windows.where(F.col(feature) > threshold)
    return hit.select(*[c for c in windows.columns if c != "detections"], F.explode(F.filter("detections", lambda d: d["operator"] == operator)).alias("detection"))


def signature_rates(windows: DataFrame, feature: str, threshold: float = 0.5) -> DataFrame:
    """Events a window, mean and sample deviation of a feature, and the windows over the mean by two deviations."""
    s = windows.agg(F.avg(feature).alias("_m"), F.stddev_samp(feature).alias("_s"))
    v = F.col(feature)
    return windows.crossJoin(F.broadcast(s)).agg(_n(), F.count_if(v > threshold).alias("events"), F.round(F.try_divide(F.count_if(v > threshold), F.count(F.lit(1))), 6).alias("rate"), F.round(F.max("_m"), 6).alias("mean"), F.round(F.max("_s"), 6).alias("deviation"), F.count_if((F.col("_s") > 0) & (v > F.col("_m") + 2 * F.col("_s"))).alias("outliers"))  # one row


def correlation_summary(windows: DataFrame, inputs: DataFrame, network: DataFrame, activity: DataFrame, least: float = 0.8, tolerance_us: int = 5_000_000) -> DataFrame:
    """(kind, value, n): of windows of a score of `least` or more with a log strictly within the tolerance: mean idle seconds, sums of keys, clicks
    and movement, connections by state and the three most frequent processes, and the five most frequent titles."""
    probes = windows.where(F.col("score") >= least).select(F.col("seq").alias("probe_id"), "ts_us")

    def near(logs: DataFrame, *columns: str) -> DataFrame:
        c = logs.select("ts_us", "ord", F.struct("ord", *columns).alias("payload"))
        return nearest_join(probes, c, tolerance_us, strict=True).where("near_us is not null").select("payload.*")

    i = near(inputs, "idle", "keys", "clicks", "movement")
    sums = i.agg(F.avg("idle").alias("mean_idle"), *[F.sum(c).cast("double").alias(c) for c in ("keys", "clicks", "movement")])
    out = sums.select(F.explode(F.array(*[F.struct(F.lit("input").alias("kind"), F.lit(c).alias("value"), F.round(F.col(c), 6).alias("n")) for c in ("mean_idle", "keys", "clicks", "movement")])).alias("r")).select("r.*")
    for kind, logs, k in (("state", network, None), ("process", network, 3), ("title", activity, 5)):
        c = near(logs, kind).groupBy(F.coalesce(kind, F.lit("Unknown")).alias("value")).agg(_n(), F.min("ord").alias("_first"))
        c = c if k is None else c.orderBy(F.desc("n"), "_first").limit(k)
        out = out.unionByName(c.select(F.lit(kind).alias("kind"), "value", F.col("n").cast("double").alias("n")))
    return out


def newest_files(files: DataFrame, k: int = 5) -> DataFrame:
    """The k newest files (path, modified, length) and the session folder that each lies in."""
    parts = F.split("path", "/")
    return files.orderBy(F.desc("modified"), "path").limit(k).select("path", "modified", "length", F.element_at(parts, -2).alias("session"))


def session_files(files: DataFrame) -> DataFrame:
    """By session folder: files, bytes and the newest change."""
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("session")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modified").alias("newest"))


def score_bands(df: DataFrame, by: str = "operator") -> DataFrame:
    band = F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.4, "medium").otherwise("low").alias("band")
    return df.groupBy(by, band).agg(_n(), F.round(F.avg("score"), 6).alias("mean"))


def gaps(df: DataFrame, by: str, order: str) -> DataFrame:
    """(by, n, mean_gap): mean distance between neighbouring rows; 0 for one."""
    g = df.groupBy(by).agg(_n(), F.min(order).alias("_a"), F.max(order).alias("_b"))
    return g.select(by, "n", F.when(F.col("n") > 1, F.round((F.col("_b") - F.col("_a")) / (F.col("n") - 1), 6)).otherwise(0.0).alias("mean_gap"))


def motion_trend(df: DataFrame, by: str, span_us: int) -> DataFrame:
    """Mean, population deviation and highest score of the last `span_us` before each group's newest row."""
    newest = df.groupBy(by).agg(F.max("ts_us").alias("_new"))
    d = newest.join(df, by).where(F.col("ts_us") >= F.col("_new") - span_us)
    return d.groupBy(by).agg(_n(), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("deviation"), F.max("score").alias("most"))


def as_report(sections: dict[str, DataFrame]) -> DataFrame:
    """One row with the JSON text of all sections, each the array of its rows, which are few: the nested report."""
    out = None
    for name, df in sections.items():
        one = df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out.select(F.to_json(F.struct(*sections)).alias("report"))
