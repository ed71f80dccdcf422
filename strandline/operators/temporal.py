"""Joins in time: nearest with a tolerance, bands, and overlaps of intervals; all by time buckets, none by nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_join(probes: DataFrame, candidates: DataFrame, tolerance_us: int, by: list[str] | None = None, strict: bool = False, probe: str = "probe_id", ts: str = "ts_us", payload: str = "payload", parts: int = 4) -> DataFrame:
    """probes (probe_id, ts_us, *by) with the candidate (ts_us, ord, payload, *by) nearest in time: near_us, payload, or nulls.

    The tolerance is inclusive unless strict; of two as near the earlier wins; of candidates at one time before the probe the
    last loaded, at or after it the first. Probes without a time, or with a null in `by`, find none.

    Candidates of one time are one row. Rows are ordered within buckets of a `parts`-th of the tolerance, in which one frame runs forth and
    one back; from beyond its ends a bucket only gets the last candidate of those before it and the first of those after it."""
    by = by or []
    width = max(1, tolerance_us // parts)
    reach = -(-tolerance_us // width)
    kind = candidates.schema[payload].dataType.simpleString()
    one = candidates.groupBy(*by, F.col(ts).alias("_t")).agg(F.min_by(payload, "ord").alias("f"), F.max_by(payload, "ord").alias("l"))
    c = one.select(*by, F.floor(F.col("_t") / width).alias("_b"), "_t", F.struct(F.col("_t").alias("t"), "f", "l").alias("_c"))
    p = probes.select(*by, F.floor(F.col(ts) / width).alias("_b"), F.col(ts).alias("_t"), F.col(probe), F.lit(None).cast(f"struct<t:bigint,f:{kind},l:{kind}>").alias("_c"))
    # a probe stands before a candidate of its time
    both = p.withColumn("_kind", F.lit(0)).unionByName(c.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    forth, back = Window.partitionBy(*by, "_b").orderBy("_t", "_kind"), Window.partitionBy(*by, "_b").orderBy(F.desc("_t"), F.desc("_kind"))
    run = (Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_prev", F.last("_c", True).over(forth.rowsBetween(*run))).withColumn("_next", F.last("_c", True).over(back.rowsBetween(*run))).where("_kind = 0")
    ends = c.groupBy(*by, "_b").agg(F.max_by("_c", "_t").alias("_last"), F.min_by("_c", "_t").alias("_first"))
    beyond = ends.select(*by, F.explode(F.array(*[F.lit(k) for k in range(-reach, reach + 1) if k])).alias("_off"), "_b", "_last", "_first").withColumn("_b", F.col("_b") + F.col("_off"))
    ahead = F.col("_off") > 0  # from an earlier bucket
    sides = beyond.groupBy(*by, "_b").agg(F.max_by("_last", F.when(ahead, F.col("_last.t"))).alias("_p"), F.min_by("_first", F.when(~ahead, F.col("_first.t"))).alias("_n"))
    sides = sides.select(*[F.col(x).alias(f"_s_{x}") for x in by], F.col("_b").alias("_sb"), "_p", "_n")
    found = near.join(sides, [F.col(x) == F.col(f"_s_{x}") for x in by] + [F.col("_b") == F.col("_sb")], "left")
    prev, after = F.coalesce("_prev", "_p"), F.coalesce("_next", "_n")
    before, behind = F.col("_t") - prev["t"], after["t"] - F.col("_t")
    left = before.isNotNull() & (behind.isNull() | (before <= behind))
    gap = F.when(left, before).otherwise(behind)
    fits = gap < tolerance_us if strict else gap <= tolerance_us
    found = found.select(*by, F.col(probe), F.col("_t").alias(ts), F.when(left, F.struct(prev["t"].alias("t"), prev["l"].alias("p"))).otherwise(F.struct(after["t"].alias("t"), after["f"].alias("p"))).alias("_best"), fits.alias("_fits"))
    return found.select(*by, probe, ts, F.when(F.col("_fits"), F.col("_best.t")).alias("near_us"), F.when(F.col("_fits"), F.col("_best.p")).alias(payload))


def band_join(anchors: DataFrame, events: DataFrame, width_us: int, ts: str = "ts_us") -> DataFrame:
    """anchors (anchor_id, anchor_us) with all events within width_us, both ends inclusive."""
    b = F.floor(F.col(ts) / width_us)
    e = events.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    a = anchors.withColumn("_b", F.floor(F.col("anchor_us") / width_us))
    return a.join(e, "_b").where(F.abs(F.col(ts) - F.col("anchor_us")) <= width_us).drop("_b")


def overall_overlap(streams: DataFrame) -> DataFrame:
    """The span that all modalities share: its ends, whether it is longer than nothing, and its length or that of the gap."""
    s = streams.groupBy("modality").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    s = s.agg(F.max("lo").alias("start_us"), F.min("hi").alias("end_us"), F.count(F.lit(1)).alias("modalities"))
    return s.withColumn("overlaps", F.col("start_us") < F.col("end_us")).withColumn("micros", F.abs(F.col("end_us") - F.col("start_us")))


def nearest_recent_log(probes: DataFrame, logs: DataFrame, tolerance_us: int, lines: int | None = 100, probe: str = "probe_id", ts: str = "ts_us", payload: str = "payload") -> DataFrame:
    """As nearest_join, strictly within the tolerance, among the last `lines` rows of the log of the probe's own day (null: all); the first
    loaded of rows as near."""
    day = F.floor(F.col(ts) / 86_400_000_000)
    c = logs.withColumn("_day", day)
    if lines is not None:
        c = c.withColumn("_rn", F.row_number().over(Window.partitionBy("_day").orderBy(F.desc("ord")))).where(F.col("_rn") <= lines).drop("_rn")
    return nearest_join(probes.withColumn("_day", day), c, tolerance_us, by=["_day"], strict=True, probe=probe, ts=ts, payload=payload).drop("_day")


def interval_overlap(streams: DataFrame) -> DataFrame:
    """Of every two modalities' spans: the common one (strictly longer than nothing), or the gap between them."""
    s = streams.groupBy("modality").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    a, b = s.alias("a"), s.alias("b")
    lo, hi = F.greatest("a.lo", "b.lo"), F.least("a.hi", "b.hi")
    return a.join(b, F.col("a.modality") < F.col("b.modality")).select(F.col("a.modality").alias("first"), F.col("b.modality").alias("second"), (lo < hi).alias("overlaps"), F.when(lo < hi, hi - lo).otherwise(lo - hi).alias("micros"))
