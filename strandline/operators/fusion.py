"""Anchors, thirteen-slice blocks over six modalities, their scores and analyses; and one-second style fused windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import nearest_join

SLICES = 6
ALL_MODALITIES = ("vision", "input", "network", "gamepad", "process", "activity")


def anchors(records: DataFrame, types: tuple[str, ...], confidence: float = 0.5, peak: float = 0.7) -> DataFrame:
    """(anchor_id, anchor_us, anchor_type, score): rows of the types above the confidence, and peaks; one a millisecond, the
    first loaded, an operator before a peak."""
    found = records.where(F.col("operator").isin(*types) & (F.col("score") > confidence)).select("seq", "ts_us", F.col("operator").alias("anchor_type"), "score", F.lit(0).alias("pos"))
    peaks = records.where(F.col("score") > peak).select("seq", "ts_us", F.lit("peak").alias("anchor_type"), "score", F.lit(1).alias("pos"))
    one = Window.partitionBy(F.round(F.col("ts_us") / 1_000_000, 3)).orderBy("seq", "pos")
    return found.unionByName(peaks).withColumn("_rn", F.row_number().over(one)).where("_rn = 1").select(F.col("seq").alias("anchor_id"), F.col("ts_us").alias("anchor_us"), "anchor_type", "score")


#: Detectors whose results anchor a block above the confidence, the one that needs flags instead, and the name of peaks.
SURE_ANCHORS, FLAGGED_ANCHOR, PEAK_ANCHOR = ("crosshair_lock", "death_event", "edge_entry"), "hit_registration", "eomm_peak"


def window_anchors(windows: DataFrame, confidence: float = 0.5, peak: float = 0.7) -> DataFrame:
    """As `anchors`, from whole detection windows (ord, ts_us, score, operator_results array of operator_name, confidence and
    flags): the results of a window in their order, then its peak; null results, confidences and flags count as none."""

    def kind(r):
        sure = r["operator_name"].isin(*SURE_ANCHORS) & (r["confidence"] > confidence)
        flagged = (r["operator_name"] == FLAGGED_ANCHOR) & (F.size(r["flags"]) > 0)
        return F.when(sure | flagged, r["operator_name"])

    peaks = F.array(F.when(F.col("score") > peak, PEAK_ANCHOR))
    kinds = F.array_compact(F.concat(F.coalesce(F.transform("operator_results", kind), F.array().cast("array<string>")), peaks))
    found = windows.select("ord", "ts_us", "score", F.posexplode(kinds).alias("pos", "anchor_type"))
    one = Window.partitionBy(F.round(F.col("ts_us") / 1_000_000, 3)).orderBy("ord", "pos")
    return found.withColumn("_rn", F.row_number().over(one)).where("_rn = 1").select(F.col("ord").alias("anchor_id"), F.col("ts_us").alias("anchor_us"), "anchor_type", "score")


def slices(anchor: DataFrame, streams: DataFrame, step_us: int, tolerance_us: int) -> DataFrame:
    """(anchor_id, frame, modality, near_us, payload): the nearest event of each modality at each of 13 times; null: none. Vision of the
    centre is the anchor's own event, whatever is near."""
    times = anchor.select("anchor_id", F.explode(F.sequence(F.lit(-SLICES), F.lit(SLICES))).alias("frame"), "anchor_us")
    probes = times.select(F.struct("anchor_id", "frame").alias("probe_id"), (F.col("anchor_us") + F.col("frame") * step_us).alias("ts_us"), F.explode(F.array(*[F.lit(m) for m in ALL_MODALITIES])).alias("modality"))
    candidates = streams.select("modality", "ts_us", "ord", F.struct("ord", "score").alias("payload"))
    near = nearest_join(probes, candidates, tolerance_us, by=["modality"]).select("probe_id.*", "modality", "near_us", "payload")
    kind = near.schema["payload"].dataType
    own = anchor.select("anchor_id", F.lit(0).alias("frame"), F.lit("vision").alias("modality"), F.col("anchor_us").alias("near_us"), F.struct(F.col("anchor_id").alias("ord"), "score").cast(kind).alias("payload"))
    return near.where("not (frame = 0 and modality = 'vision')").unionByName(own)


def blocks(anchor: DataFrame, sliced: DataFrame) -> DataFrame:
    """(block_id, anchor_id, anchor_us, anchor_type, frames): the 13 frames of each block in order, each with its time's nearest events by
    modality; blocks are numbered by time. Numbers come from counts of days, so no task orders all anchors."""
    event = F.when(F.col("near_us").isNotNull(), F.struct("modality", F.struct("near_us", "payload").alias("event")))  # collect_list leaves out nulls
    each = sliced.groupBy("anchor_id", "frame").agg(F.map_from_entries(F.array_sort(F.collect_list(event))).alias("events"))
    frames = each.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("frame", "events")), lambda a, b: a["frame"] - b["frame"]).alias("frames"))
    day = F.floor(F.col("anchor_us") / 86_400_000_000)
    placed = anchor.withColumn("_day", day).withColumn("_rn", F.row_number().over(Window.partitionBy("_day").orderBy("anchor_us", "anchor_id")))
    days = placed.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    days = days.withColumn("_before", F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")  # a row a day
    number = F.col("_rn") - 1 + F.coalesce("_before", F.lit(0))
    named = placed.join(days, "_day").select("anchor_id", "anchor_us", "anchor_type", F.format_string("block_%06d_%s", number.cast("long"), "anchor_type").alias("block_id"))
    return named.join(frames, "anchor_id").select("block_id", "anchor_id", "anchor_us", "anchor_type", "frames")


def alignment(sliced: DataFrame) -> DataFrame:
    """(anchor_id, alignment, coverage): the part of a block's 13 slices that each modality fills, for those that fill any, and the mean of
    all six."""
    per = sliced.where("near_us is not null").groupBy("anchor_id", "modality").agg((F.count(F.lit(1)) / 13.0).alias("part"))
    out = per.groupBy("anchor_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", F.round("part", 6))))).alias("coverage"), F.sum("part").alias("_all"))
    every = sliced.select("anchor_id").distinct().join(out, "anchor_id", "left")
    return every.select("anchor_id", F.round(F.coalesce(F.col("_all"), F.lit(0.0)) / len(ALL_MODALITIES), 6).alias("alignment"), F.coalesce("coverage", F.create_map().cast("map<string,double>")).alias("coverage"))


def block_scores(sliced: DataFrame) -> DataFrame:
    """Alignment (filled slices of 78), coherence (of three parts), and the pattern flags of each block."""
    has = F.col("near_us").isNotNull()
    pre, at, post = F.col("frame") < 0, F.col("frame") == 0, F.col("frame") > 0
    hands = F.col("modality").isin("gamepad", "input")
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    out = sliced.groupBy("anchor_id").agg(F.count_if(has).alias("filled"), flag(pre & hands & has).alias("pre_input"), flag(at & (F.col("modality") == "vision") & has).alias("at_vision"), flag(pre & (F.col("modality") == "network") & has).alias("pre_network"), flag(post & hands & has).alias("post_input"), flag(post & (F.col("modality") == "network") & has).alias("post_network"))
    whole = F.col("pre_input").cast("int") + F.col("at_vision").cast("int") + F.col("post_network").cast("int")
    return out.withColumn("alignment", F.round(F.col("filled") / 78.0, 6)).withColumn("coherence", F.round(whole / 3.0, 6)).withColumn("chain", F.col("pre_input") & F.col("post_network"))


def modality_coverage(sliced: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return sliced.groupBy("modality").agg(n.alias("slices"), F.count("near_us").alias("filled"), F.round(100.0 * F.count("near_us") / n, 6).alias("pct"))


def temporal_patterns(blocks: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    flags = ("pre_input", "pre_network", "post_network", "post_input", "chain")
    return blocks.agg(n.alias("blocks"), *[F.count_if(c).alias(c) for c in flags], *[F.round(F.try_divide(100.0 * F.count_if(c), n), 6).alias(f"{c}_pct") for c in flags])


def block_anomalies(blocks: DataFrame, anchor: DataFrame) -> DataFrame:
    """Blocks with an issue: a score over 0.7, an alignment under 0.1 or a coherence under 0.2, each with its number."""
    b = blocks.join(anchor.select("anchor_id", "anchor_us", "anchor_type", "score"), "anchor_id")
    two = lambda c: F.bround(F.col(c).cast("decimal(20,10)"), 2).cast("decimal(20,2)").cast("string")
    # fixed values: names of the issues
    found = {"HIGH_EOMM_SCORE": (F.col("at_vision") & (F.col("score") > 0.7), "score"), "LOW_ALIGNMENT": (F.col("alignment") < 0.1, "alignment"), "LOW_COHERENCE": (F.col("coherence") < 0.2, "coherence")}
    issues = F.array_compact(F.array(*[F.when(c, F.concat(F.lit(f"{k}:"), two(v))) for k, (c, v) in found.items()]))
    return b.select("anchor_id", "anchor_us", "anchor_type", F.array_join(issues, ",").alias("issues")).where("issues <> ''")


#: Sources of fused windows in their order, and the bounds of the correlation rules.
FUSED_SOURCES = ("vision", "input", "network", "gamepad", "process")
HIGH_SCORE, FEW_MOVES, BUSY_BYTES, FEW_STICKS, FEW_KEYS = 0.7, 5, 10_000, 3, 2


def fused_windows(events: DataFrame, seconds: int = 1, max_events: int | None = 1000) -> DataFrame:
    """A row for each tumbling window of events (source, ts_us, ord, type, score, flags, frame_count, bytes_sent, bytes_recv,
    packets, process_name, cpu_percent, memory_mb) with any of the five sources; keys are times divided and cut toward zero. Of
    every source, a window takes its first `max_events` in order of arrival (`ord`); null: all."""
    d = events.where(F.col("source").isin(*FUSED_SOURCES)).withColumn("window_key", F.call_function("div", F.col("ts_us"), F.lit(seconds * 1_000_000)))
    if max_events is not None:
        rank = Window.partitionBy("window_key", "source").orderBy("ord")
        d = d.withColumn("_rn", F.row_number().over(rank)).where(F.col("_rn") <= max_events)
    return correlated(aggregate_windows(d.groupBy("window_key")))


def aggregate_windows(grouped) -> DataFrame:
    """The aggregates of a window; the same for batches and streams. Vision has the score and flags of its highest row, the
    first on ties; a source that is absent has counts of 0 and null averages."""
    of = {m: F.col("source") == m for m in FUSED_SOURCES}

    def n(source: str, kind: str | None = None):
        return F.count(F.when(of[source] & (F.col("type") == kind) if kind else of[source], 1))

    def total(source: str, c: str):
        return F.coalesce(F.sum(F.when(of[source], F.col(c))), F.lit(0))

    def mean(c: str):
        return F.avg(F.when(of["process"], F.coalesce(c, F.lit(0.0))))

    score = F.coalesce("score", F.lit(0.0))
    best = F.max_by(F.struct(score.alias("score"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags")), F.when(of["vision"], F.struct(score, -F.col("ord"))))
    out = grouped.agg(
        n("vision").alias("vision_events"), best.alias("_best"), total("vision", "frame_count").alias("frame_count"),
        n("input").alias("input_events"), n("input", "key_press").alias("key_presses"), n("input", "mouse_move").alias("mouse_moves"), n("input", "mouse_click").alias("mouse_clicks"),
        n("network").alias("network_events"), total("network", "bytes_sent").alias("bytes_sent"), total("network", "bytes_recv").alias("bytes_recv"), total("network", "packets").alias("packets"),
        n("gamepad").alias("gamepad_events"), n("gamepad", "stick").alias("stick_events"), n("gamepad", "button").alias("button_events"),
        n("process").alias("process_events"), F.size(F.collect_set(F.when(of["process"], F.coalesce("process_name", F.lit(""))))).alias("unique_processes"), mean("cpu_percent").alias("cpu_avg"), mean("memory_mb").alias("memory_avg"),
    )
    return out.withColumns({"vision_score": F.col("_best.score"), "vision_flags": F.col("_best.flags")}).drop("_best")


def correlated(w: DataFrame) -> DataFrame:
    """Adds sources_present and correlations: rules over pairs of sources, each where both are there."""
    here = {m: F.col(f"{m}_events") > 0 for m in FUSED_SOURCES}
    high = F.col("vision_score") > HIGH_SCORE
    flag = lambda x: F.array_contains("vision_flags", x)
    rules = {
        "AIM_LOCK_NO_INPUT": here["input"] & high & flag("AIM_RESISTANCE") & (F.col("mouse_moves") < FEW_MOVES),
        "MANIPULATION_STABLE_NETWORK": here["network"] & high & (F.col("bytes_recv") > BUSY_BYTES),
        "AIM_WITHOUT_GAMEPAD": here["gamepad"] & (F.col("stick_events") < FEW_STICKS) & (flag("AIM_RESISTANCE") | flag("CROSSHAIR_LOCK")),
        "HITBOX_DRIFT_NO_REACTION": here["input"] & flag("HITBOX_DRIFT") & (F.col("key_presses") < FEW_KEYS),
    }
    present = F.array_compact(F.array(*[F.when(c, m) for m, c in here.items()]))
    found = F.array_compact(F.array(*[F.when(here["vision"] & c, k) for k, c in rules.items()]))
    return w.withColumn("sources_present", present).withColumn("correlations", found)
