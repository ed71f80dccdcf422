import hashlib
import json
import math
import statistics
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import scalar
from strandline.operators import events as made
from strandline.operators import fusion, grid, query, reports, screen, stats, temporal, windows
from strandline.plans.queries import ORACLES, QUERIES
from strandline.sources import binary, jsonl
from strandline.streaming import store
from strandline.streaming import windows as streaming

S = 1_000_000


def events(spark, rows):
    return spark.createDataFrame(rows, "seq long, ts_us long, operator string, score double, session_id string, flags array<string>")


def test_filters_and_boundaries(spark):
    df = events(spark, [(1, 0, "a", 0.5, "s", ["X"]), (2, S, "b", 0.75, "s", ["X", "Y"]), (3, 2 * S, "c", None, "", []), (4, 3 * S, "a", 0.9, None, None)])
    ids = lambda d: sorted(r.seq for r in d.collect())
    assert ids(query.score_above(df, 0.5)) == [2, 4]
    assert ids(query.score_below(df, 0.5)) == [1, 3]
    assert ids(query.time_range(df, S, 2 * S)) == [2, 3]
    assert ids(query.where_flag(df, "X")) == [1, 2]
    assert ids(query.with_all_tags(df, ["X", "Y"])) == [2]
    assert query.windows_with_flag(df, "X", limit=0).count() == 0
    assert {r.session_id: r.n for r in query.session_counts(df).collect()} == {"s": 2, "": 1, "unknown": 1}
    assert [r.session_id for r in query.session_summaries(df).collect()] == ["s"]
    assert query.score_stats(df.limit(0)).first().max_score == 0.0


def test_bursts_join_at_the_gap(spark):
    df = events(spark, [(k, t * S, "a", 0.9, "s", []) for k, t in enumerate([0, 2, 4, 7, 9])])
    out = query.bursts(df, 0.75, 2 * S, 3).collect()
    assert [(r.start_us, r.end_us, r.n) for r in out] == [(0, 4 * S, 3)]


@pytest.mark.parametrize("bucket", [1, 3, 10, 1_000])
def test_bursts_pass_over_the_ends_of_buckets(spark, bucket):
    times = {"a": [0, 1, 2, 2, 5, 9, 10, 11, 12, 13, 40, 42, 44], "b": [1, 2, 30, 31, 32, 33], None: [4, 5, 6]}
    df = events(spark, [(100 * i + k, t, f"o{k % 2}", 0.8 + k / 100, s, []) for i, (s, ts) in enumerate(times.items()) for k, t in enumerate(ts)])

    def islands(ts):
        out = []
        for t in sorted(ts):
            if out and t - out[-1][-1] <= 2:
                out[-1].append(t)
            else:
                out.append([t])
        return [(x[0], x[-1], len(x)) for x in out if len(x) >= 3]

    got = query.bursts(df, 0.75, 2, 3, ["session_id"], bucket).collect()
    assert sorted((str(r.session_id), r.start_us, r.end_us, r.n) for r in got) == sorted((str(s), *x) for s, ts in times.items() for x in islands(ts))
    assert sorted((r.start_us, r.end_us, r.n) for r in query.bursts(df, 0.75, 2, 3, None, bucket).collect()) == islands(sum(times.values(), []))


def test_capsules_of_thirteen(spark):
    df = spark.createDataFrame([("v", k, k * 10_000) for k in range(13)], "source string, seq long, ts_us long")
    out = {r.seq: r for r in windows.capsules(df, "source").collect()}
    assert out[6].before == [5, 4, 3, 2, 1, 0] and out[6].after == [7, 8, 9, 10, 11, 12]
    assert (len(out[0].before), len(out[0].after), len(out[12].before), len(out[12].after)) == (0, 6, 6, 0)


@pytest.mark.parametrize("strict", [False, True])
def test_nearest_join_is_exact(spark, strict):
    probes = [(k, (k * 7919) % 400) for k in range(60)] + [(100, 50)]
    cands = [(k, (k * 6101) % 400) for k in range(50)] + [(60, 40), (61, 60)]
    p = spark.createDataFrame(probes, "probe_id long, ts_us long")
    c = spark.createDataFrame([(t, k, k) for k, t in cands], "ts_us long, ord long, payload long")
    got = {r.probe_id: (r.near_us, r.payload) for r in temporal.nearest_join(p, c, 10, strict=strict).collect()}
    for k, t in probes:
        near = [(abs(x - t), x, (-o if x < t else o), o) for o, x in cands if (abs(x - t) < 10 if strict else abs(x - t) <= 10)]
        want = min(near, default=None)
        assert got[k] == ((want[1], want[3]) if want else (None, None)), (k, t)


def test_band_join_holds_both_ends(spark):
    a = spark.createDataFrame([(1, 2_000_150_000)], "anchor_id long, anchor_us long")
    e = spark.createDataFrame([(2_000_000_000, "vision"), (2_000_050_000, "input"), (2_000_200_000, "test"), (1_999_949_999, "late"), (1_999_950_000, "edge")], "ts_us long, source string")
    assert sorted(r.source for r in temporal.band_join(a, e, 200_000).collect()) == ["edge", "input", "test", "vision"]


def test_welford_rejects_outliers(spark):
    values = [10.0, 11.0, 9.0, 10.5, 9.5, 100.0, 10.2]
    df = spark.createDataFrame([("w", k, v) for k, v in enumerate(values)], "g string, k long, v double")
    r = windows.welford(df, "g", ["k"], "v").first()
    kept = [v for v in values if v != 100.0]
    assert (r.n, r.rejected) == (6, 1)
    assert math.isclose(r["mean"], statistics.mean(kept), abs_tol=1e-6) and math.isclose(r.deviation, statistics.stdev(kept), abs_tol=1e-6)


def test_dead_band_follows_the_last_emitted(spark):
    df = spark.createDataFrame([("g", k, v) for k, v in enumerate([0.0, 0.6, 0.9, 1.2, 2.5])], "g string, k long, v double")
    assert windows.dead_band(df, "g", ["k"], "v", 1.0).count() == 3


def test_hash_chain_and_verification(spark):
    rows, last = [], "0" * 64
    for k in range(5):
        p = json.dumps({"a": k}, separators=(",", ":"))
        last = hashlib.sha256((last + p).encode()).hexdigest()
        rows.append(("f", k, p, last))
    df = spark.createDataFrame(rows, "f string, k long, p string, _sha string")
    assert windows.hash_chain(df, "f", ["k"], "p").first()["head"] == last
    assert windows.verify_chain(df, "f", ["k"], "p").where("valid").count() == 5
    broken = df.withColumn("p", F.when(F.col("k") == 2, "x").otherwise(F.col("p")))
    assert [r.k for r in windows.verify_chain(broken, "f", ["k"], "p").where("not valid").collect()] == [2]


@pytest.mark.parametrize("n", [2, 3, 9, 10, 25])
def test_exclusive_quantiles(spark, n):
    v = [float((k * 37) % 101) for k in range(n)]
    r = stats.profile(spark.createDataFrame([("g", x) for x in v], "g string, v double"), "g", "v").first()
    q = statistics.quantiles(v, n=4)
    assert math.isclose(r.p25, q[0], abs_tol=1e-6) and math.isclose(r.p75, q[2], abs_tol=1e-6)
    assert math.isclose(r.p90, statistics.quantiles(v, n=10)[8] if n >= 10 else max(v), abs_tol=1e-6)


def test_composite_of_weights(spark):
    rows = [("w", o, c, ["F"]) for o, c in (("a", 0.7), ("b", 0.8), ("c", 0.3), ("d", 0.5))] + [("u", "x", 1.0, [])]
    df = spark.createDataFrame(rows, "w string, operator string, score double, flags array<string>")
    got = {r.w: r for r in stats.composite(df, {"a": 0.30, "b": 0.30, "c": 0.25, "d": 0.15}, "w").collect()}
    assert math.isclose(got["w"].composite, 0.6) and got["w"].manipulation and not got["w"].high_confidence
    assert got["u"].composite == 0.0


def test_quiet_islands(spark):
    df = spark.createDataFrame([("f", k, 10 if k < 60 else 10 + max(0, 60 - k) + (1 if k == 60 else 1)) for k in range(62)], "f string, k long, size long")
    out = {r.k: r.state for r in windows.quiet_islands(df, "f", ["k"], "size").collect()}
    assert out[49] == "active" and out[50] == "idle" and out[60] == "active"


def test_detectors_on_a_flat_and_a_blinking_window(spark):
    rows = [(0, f, [1] * 64) for f in range(30)] + [(1, f, [9 if f % 2 else 0] * 64) for f in range(30)]
    df = spark.createDataFrame(rows, "window_id long, frame_id long, grid array<int>")
    for f in (grid.flicker, grid.hud_stability, grid.peripheral_flash):
        assert [r.window_id for r in f(df).collect()] == [1]
    assert grid.peripheral_flash(df).first().edge == "top"
    # halves of 15 frames hold 8 and 7 dark ones: 9 steps of 1 / 15 each
    assert [(r.window_id, r.emd) for r in grid.color_shift(df).collect()] == [(1, 0.6)]
    assert {r.window_id: r.overall for r in grid.fingerprint(df).collect()}[1] == 1.0


def test_screen_vectors_of_even_and_moving_frames(spark):
    ramp = [10 * x for _ in range(10) for x in range(10)]
    rows = [("a", 1, 10, [100] * 100), ("a", 2, 10, []), ("a", 3, 10, [200] * 100), ("b", 1, 10, ramp)]
    r = {(x.source, x.frame_id): x for x in screen.screen_vectors(spark.createDataFrame(rows, "cam string, frame_id long, width int, luma array<int>"), "cam").collect()}
    assert set(r) == {("a", 1), ("a", 3), ("b", 1)}
    one, two, slope = r["a", 1], r["a", 3], r["b", 1]
    assert (one.core_std, one.core_entropy, one.symmetry, one.stability, one.flash, one.motion) == (0, 0, 1, 1, 0, 0) and one.histogram[100] == 100
    assert two.motion == 100 and math.isclose(two.flash, 100 / 255) and math.isclose(two.stability, 1 - 100 / 255) and two.motion_uniformity == 1
    assert slope.core_direction == 0 and slope.motion == 0 and len(slope.sector_means) == 8 and slope.sector_means[1] == slope.sector_means[2] > slope.sector_means[0]
    assert {x.frame_id for x in screen.flash_events(screen.screen_vectors(spark.createDataFrame(rows, "cam string, frame_id long, width int, luma array<int>"), "cam")).collect()} == {3}
    rgb = spark.createDataFrame([([255], [0], [10])], "r array<int>, g array<int>, b array<int>").select(screen.luma("r", "g", "b").alias("l")).first().l
    assert math.isclose(rgb[0], 0.299 * 255 + 1.14)


def test_jsonl_readers(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('\ufeff{"timestamp": "2025-12-02T10:00:00.1234567Z", "pid": 1}\n\n{"broken\n{"epoch": 12.5, "pid": 2}\n', encoding="utf-8")
    rows = jsonl.read_jsonl(spark, [str(p), str(p)], "pid int").orderBy("pid").collect()
    assert [(r.pid, r.event_us % S) for r in rows] == [(1, 123456), (2, 500000)]
    assert jsonl.read_jsonl(spark, str(p), "pid int", "counted").where("_bad").count() == 2
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        jsonl.read_jsonl(spark, str(p), "pid int", "strict").collect()
    bad = jsonl.validate(jsonl.read_jsonl(spark, str(p), "pid int"), ("timestamp", "pid")).orderBy("pid").collect()
    assert [r.missing for r in bad] == [[], ["timestamp"]]


def test_scalars(spark):
    r = spark.range(1).select(scalar.disk_severity(F.lit(500), F.lit(200)).alias("w"), scalar.disk_severity(F.lit(150), F.lit(200)).alias("c"), scalar.disk_severity(F.lit(1000), F.lit(200)).alias("n"), scalar.quantize(F.lit(255)).alias("q"), scalar.score_band(F.lit(0.4)).alias("b")).first()
    assert tuple(r) == ("warning", "critical", None, 9, "medium")


def test_process_rules(spark):
    rows = [
        ("a.exe", None, "system", None, None, "system_service", False),
        ("a.exe", "Explorer.EXE", "ann", "C:\\x", "", "user_initiated", False),
        ("a.exe", "x", None, "C:\\Users\\ann\\AppData\\Local\\Temp\\a.exe", None, "user_initiated", True),
        ("a.exe", "services.exe", "ann", None, None, "system_service", False),
        ("a.exe", "", "ann", None, None, "external_triggered", False),
        ("a.EXE", "winword.exe", "ann", None, None, "unknown", True),
        ("a.dll", "winword.exe", "ann", None, None, "unknown", False),
        ("CMD.exe", "Firefox.exe", "ann", None, None, "unknown", True),
        ("PowerShell.exe", "x", "ann", None, "-EncodedCommand Q", "unknown", True),
        (None, None, None, None, None, "external_triggered", False),
    ]
    df = spark.createDataFrame(rows, "name string, parent string, account string, path string, command string, origin string, sus boolean")
    c = F.col
    got = df.select(scalar.process_origin(c("parent"), c("account"), c("path")).alias("o"), scalar.suspicious(c("name"), c("parent"), c("path"), c("command")).alias("s"), scalar.is_noise(c("name")).alias("n"), "origin", "sus").collect()
    assert [(r.o, r.s, r.n) for r in got] == [(r.origin, r.sus, False) for r in got]


def test_resets_places_and_reads(spark):
    df = spark.createDataFrame([("u", 1, 5.0), ("u", 2, 1.0), ("u", 3, 1.0), ("v", 4, None), ("v", 5, 2.0), ("v", 6, 0.0)], "user string, seq long, idle double")
    assert [r.seq for r in windows.resets(df, "user", ["seq"], "idle").orderBy("seq").collect()] == [2, 6]
    assert {r.user: r.seq for r in query.nth(df, 3, ["user"], [F.asc("seq")]).collect()} == {"u": 3, "v": 6} and query.nth(df, 4, ["user"], [F.asc("seq")]).count() == 0
    assert [r.seq for r in query.read_many(df, "seq", [6, 1, 6, 99]).collect()] == [6, 1, 6] and query.read_many(df, "seq", []).count() == 0
    t = jsonl.with_timestamp(spark.createDataFrame([(0.0, None), (1.25, None), (2.0, "x")], "t_start double, timestamp string")).orderBy("t_start").collect()
    assert [r.timestamp for r in t] == ["1970-01-01T00:00:00", "1970-01-01T00:00:01.250000", "x"]


def _record(seq, sections=(b"\x80", b"\x80", b"\x80"), refs=(1, 2, 0, 0), pairs=b""):
    tail = pairs + b"".join(struct.pack("<H", len(x) + 1) + b"\x01" + x for x in sections)
    raw = binary.RECORD.pack(binary.RECORD_MAGIC, 2, binary.RECORD.size + len(tail) + 4, 9, 1, seq, 1.5, 1, *refs, 3, 4, 5, 6, 10, len(pairs)) + tail
    return raw + struct.pack("<I", zlib.crc32(raw))


def test_binary_logs(spark, tmp_path):
    words = [w.encode() for w in ("task", "motor")]
    body = b"".join(struct.pack("<H", len(w)) + w + struct.pack("<I", zlib.crc32(w)) for w in words)
    (tmp_path / "strings.dict").write_bytes(binary.STRINGS.pack(binary.STRINGS_MAGIC, 2, 12 + len(body)) + body)
    metrics = b"\x83\xa1s\xcb" + struct.pack(">d", 0.75) + b"\xa5flags\x92\xa1A\xd9\x01B\xa1n\xd1\xff\x00"
    whole = [_record(1, (metrics, b"\x81\xa1k\xc0", b"\x81\xa1c\xcd\x01\x00"), pairs=b"\x02\x07"), _record(2, refs=(2, 0, 0, 1))]
    hurt = bytearray(_record(3))
    hurt[-6] ^= 1
    log = b"".join(whole) + bytes(hurt) + _record(4)
    (tmp_path / "records.bin").write_bytes(log + _record(5)[:-1])
    at, names = str(tmp_path / "records.bin"), str(tmp_path / "strings.dict")
    rows = binary.read_records(spark, at, names, "lenient").orderBy("seq").collect()
    assert [(r.seq, r.task_id, r.engine_id, r.transform_id, r.failure_reason) for r in rows] == [(1, "task", "motor", "", None), (2, "motor", "", "", "task"), (4, "task", "motor", "", None)]
    r = rows[0]
    assert json.loads(r.error_metrics) == {"s": 0.75, "flags": ["A", "B"], "n": -256} and (json.loads(r.params), json.loads(r.context)) == ({"k": None}, {"c": 256})
    assert (r.pulse_id, r.worker_id, r.timestamp, r.success, r.grid_in, r.grid_out, r.color_count, r.train_pair_indices) == (9, 1, 1.5, True, [3, 4], [5, 6], 10, [2, 7])
    assert [x.at for x in binary.read_records(spark, at, mode="counted").where("bad is not null").collect()] == [sum(map(len, whole))]
    with pytest.raises(Exception, match="checksum"):
        binary.read_records(spark, at, names).collect()

    def entry(pulse, records):
        inner = struct.pack("<QI", pulse, len(records)) + b"".join(records)
        return struct.pack("<I", len(inner) + 8) + inner + struct.pack("<I", zlib.crc32(inner))

    (tmp_path / "wal.bin").write_bytes(binary.JOURNAL.pack(binary.JOURNAL_MAGIC, 1, 0, 1, 77) + entry(1, whole) + entry(2, [_record(7)]) + entry(3, [_record(8)])[:-1] + bytes(64))
    rows = binary.read_journal(spark, str(tmp_path / "wal.bin"), names).orderBy("seq").collect()
    assert [(r.seq, r.entry_pulse, r.entry_records, r.checkpointed, r.task_id) for r in rows] == [(1, 1, 2, True, "task"), (2, 1, 2, True, "motor"), (7, 2, 1, False, "task")]
    (tmp_path / "empty.bin").write_bytes(b"")
    assert binary.read_records(spark, str(tmp_path / "empty.bin")).count() == binary.read_journal(spark, str(tmp_path / "empty.bin")).count() == 0


SENSED = "ts_us long, ord long, source string, type string, score double, flags array<string>, frame_count long, bytes_sent long, bytes_recv long, packets long, process_name string, cpu_percent double, memory_mb double"


def sensed(spark, rows):
    """Events from (ts_us, source, other fields)."""
    names = [c.split(" ")[0] for c in SENSED.split(", ")]
    return spark.createDataFrame([tuple(({"ts_us": t, "ord": k, "source": m} | x).get(n) for n in names) for k, (t, m, x) in enumerate(rows)], SENSED)


def test_fused_windows_follow_the_rules(spark):
    vision = lambda s, *flags: ("vision", {"score": s, "flags": list(flags), "frame_count": 30})
    inputs = lambda kind, n: [("input", {"type": kind})] * n
    windows_ = [
        [vision(0.71, "AIM_RESISTANCE"), vision(0.71, "X"), vision(None, "Y"), *inputs("mouse_move", 4), ("other", {})],
        [vision(0.9, "AIM_RESISTANCE"), *inputs("mouse_move", 5)],
        [vision(0.7, "AIM_RESISTANCE"), *inputs("key_press", 1)],
        [vision(0.8), ("network", {"bytes_recv": 10_001, "packets": 2})],
        [vision(0.8), ("network", {"bytes_recv": 10_000}), ("network", {})],
        [vision(0.1, "CROSSHAIR_LOCK"), *[("gamepad", {"type": "stick"})] * 2, ("gamepad", {"type": "button"})],
        [vision(0.1, "CROSSHAIR_LOCK"), *[("gamepad", {"type": "stick"})] * 3],
        [vision(0.1, "HITBOX_DRIFT"), *inputs("key_press", 1)],
        [vision(0.1, "HITBOX_DRIFT"), *inputs("key_press", 2)],
        [vision(0.9, "AIM_RESISTANCE", "HITBOX_DRIFT")],
        [("process", {"process_name": "a", "cpu_percent": 3.0}), ("process", {"process_name": "a"}), ("process", {})],
    ]
    rows = [(k * S + i, m, x) for k, w in enumerate(windows_) for i, (m, x) in enumerate(w)]
    got = fusion.fused_windows(sensed(spark, rows)).orderBy("window_key").collect()
    assert [r.correlations for r in got] == [["AIM_LOCK_NO_INPUT"], [], [], ["MANIPULATION_STABLE_NETWORK"], [], ["AIM_WITHOUT_GAMEPAD"], [], ["HITBOX_DRIFT_NO_REACTION"], [], [], []]
    a, p = got[0], got[-1]
    assert (a.vision_events, a.vision_score, a.vision_flags, a.frame_count, a.mouse_moves, a.sources_present) == (3, 0.71, ["AIM_RESISTANCE"], 90, 4, ["vision", "input"])
    assert (p.process_events, p.unique_processes, p.cpu_avg, p.memory_avg, p.vision_score, p.bytes_recv) == (3, 2, 1.0, 0.0, None, 0)
    assert fusion.fused_windows(sensed(spark, rows), max_events=2).orderBy("window_key").first().vision_events == 2
    assert fusion.fused_windows(sensed(spark, rows).limit(0)).count() == 0


def test_anchors_of_whole_windows(spark):
    rows = [
        (1, 1_000_100, 0.9, [("flicker", 0.9, ["F"]), ("hit_registration", 0.1, ["GHOST_HITS"]), ("death_event", 0.9, [])]),
        (2, 1_000_200, 0.1, [("edge_entry", 0.9, None)]),
        (3, 2_000_000, 0.71, [("crosshair_lock", 0.5, ["X"]), ("hit_registration", 0.9, []), ("hit_registration", 0.9, None)]),
        (4, 3_000_000, None, None),
        (5, 4_000_000, 0.7, [("death_event", None, []), None, ("crosshair_lock", 0.51, None)]),
    ]
    df = spark.createDataFrame(rows, "ord long, ts_us long, score double, operator_results array<struct<operator_name string, confidence double, flags array<string>>>")
    got = fusion.window_anchors(df).orderBy("anchor_us").collect()
    assert [(r.anchor_id, r.anchor_type) for r in got] == [(1, "hit_registration"), (3, "eomm_peak"), (5, "crosshair_lock")]
    assert fusion.window_anchors(df.limit(0)).count() == 0


def test_streams_agree_with_batches(spark, tmp_path):
    base = 1_700_000_000 * S
    rows = [(base + k * 137_000, ["vision", "input", "network", "gamepad", "process", "other"][k % 6], {"type": ["key_press", "stick"][k % 2], "score": (k % 10) / 10, "flags": ["AIM_RESISTANCE"], "bytes_recv": k * 500, "process_name": f"p{k % 7}", "cpu_percent": float(k % 3)}) for k in range(200)]
    df = sensed(spark, rows)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    sensed(spark, [(base + 3_600 * S, "vision", {})]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_micros("ts_us"))
    q = streaming.fused(stream).writeStream.format("memory").queryName("fused").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = fusion.fused_windows(df).orderBy("window_key")
    want = [tuple(r) for r in batch.collect()]
    assert want and [tuple(r) for r in spark.table("fused").select(*batch.columns).orderBy("window_key").collect()] == want


def test_time_buffer_and_drain_order(spark):
    df = spark.createDataFrame([(-20.0,), (-5.0,), (0.1,), (0.0,)], "t double").select((F.col("t") * S + 100 * S).cast("long").alias("ts_us"))
    assert [r.ts_us for r in streaming.time_buffer(df, 10.2).collect()] == [95 * S, 100 * S, 100 * S + 100_000]


def test_idle_alerts_and_first_row_windows(spark, tmp_path):
    spark.createDataFrame([("f", k, 5, k * 300_000) for k in range(105)], "key string, poll long, size long, ts_us long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("key string, poll long, size long, ts_us long").parquet(str(tmp_path / "in"))
    for name, df in (("idle", streaming.idle_alerts(stream(), "key")), ("wins", streaming.first_row_windows(stream(), "key"))):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert [(r.poll, r.state) for r in spark.table("idle").orderBy("poll").collect()] == [(50, "idle"), (100, "stalled")]
    assert {r.n for r in spark.table("wins").collect()} == {4}


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_anchor_gets_its_block(spark):
    from strandline.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    kinds = {r.anchor_id: r.anchor_type for r in QUERIES["anchors"](spark, d).collect()}
    assert set(kinds.values()) == {"error", "peak"}
    assert sorted(r.anchor_id for r in QUERIES["block_scores"](spark, d).collect()) == sorted(kinds)
    assert QUERIES["fusion_slices"](spark, d).count() == 78 * len(kinds)
    assert {r.modality: r.slices for r in QUERIES["modality_coverage"](spark, d).collect()} == {m: 13 * len(kinds) for m in fusion.ALL_MODALITIES}
    assert QUERIES["temporal_patterns"](spark, d).first().blocks == len(kinds)


def test_chain_events_hold_every_chain_row(spark, tmp_path):
    from strandline.plans.queries import QUERIES

    customer = {1: 7, 2: 199, 3: 200, 4: 90_000, 5: 201}
    rows = [(o, n, f"2024-01-0{n}") for o in (1, 2, 3, 4, 9) for n in (1, 2)]
    spark.createDataFrame(list(customer.items()), "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["chain_events"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(o, n, n, customer[o], day) for o, n, day in rows if o in customer]


def nearest_by_hand(probes, cands, tolerance, strict):
    out = []
    for pid, by, t in probes:
        own = sorted((c for c in cands if c[0] == by), key=lambda c: (c[1], c[2]))
        before, after = [c for c in own if c[1] < t], [c for c in own if c[1] >= t]
        near = [(abs(c[1] - t), k, c) for k, c in enumerate(before[-1:] + [c for c in after if c[1] == after[0][1]][:1])]
        best = min(near, default=None)
        ok = best is not None and (best[0] < tolerance if strict else best[0] <= tolerance)
        out.append((pid, best[2][1] if ok else None, best[2][3] if ok else None))
    return out


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("parts", [1, 4, 7])
def test_nearest_join_over_buckets(spark, strict, parts):
    rng = np.random.default_rng(parts)
    probes = [(k, "ab"[k % 2], int(t)) for k, t in enumerate(rng.integers(-200, 2_000, 150))]
    cands = [("abc"[int(rng.integers(3))], int(t), k, f"p{k}") for k, t in enumerate(rng.integers(-300, 2_000, 70))]
    cands += [("a", 500, 900, "x"), ("a", 500, 901, "y"), ("b", 777, 902, "z")]
    probes += [(1000, "a", 500), (1001, "a", 501), (1002, "a", 499), (1003, "c", 5_000)]
    for tolerance in (0, 1, 30, 400):
        got = temporal.nearest_join(spark.createDataFrame(probes, "probe_id long, m string, ts_us long"), spark.createDataFrame(cands, "m string, ts_us long, ord long, payload string"), tolerance, by=["m"], strict=strict, parts=parts)
        assert sorted(((r.probe_id, r.near_us, r.payload) for r in got.collect()), key=repr) == sorted(nearest_by_hand(probes, cands, tolerance, strict), key=repr)


def test_nearest_join_in_one_hot_bucket(spark):
    n = 100_000
    p = spark.range(n).select(F.col("id").alias("probe_id"), (F.col("id") * 2 + 1).alias("ts_us"))
    c = spark.range(n).select((F.col("id") * 2).alias("ts_us"), F.col("id").alias("ord"), F.col("id").alias("payload"))
    got = temporal.nearest_join(p, c, 10**9)  # all in one bucket; a quadratic plan does not end
    assert got.agg(F.count_if(F.col("payload") == F.col("probe_id"))).first()[0] == n


def by_hand(frames, h, w, t):
    """The six detectors of a window of frames (h x w lists), by their rules."""
    n, cells = len(frames), [(y, x) for y in range(h) for x in range(w)]
    out = {}
    part = lambda g, where, test: sum(test(g[y][x]) for y, x in where) / len(where) if where else 0.0

    def mass(g, where, empty):
        s = sum(g[y][x] for y, x in where)
        return tuple(sum(p[k] * g[p[0]][p[1]] for p in where) / s if s else empty[k] for k in (0, 1))

    steps = lambda where, empty: [math.dist(mass(a, where, empty), mass(b, where, empty)) for a, b in zip(frames, frames[1:], strict=False)]
    ring = lambda p: [(y, x) for y, x in cells if (y - h // 2) ** 2 + (x - w // 2) ** 2 <= int(min(h, w) * p) ** 2]
    if n >= 5:
        mid = [(y, x) for y, x in cells if int(0.35 * h) <= y < int((0.35 + 0.30) * h) and int(0.35 * w) <= x < int((0.35 + 0.30) * w)]
        d = steps(mid, (len(mid) // 2,) * 2)
        smooth, snap = 1 / (1 + statistics.pvariance(d)), sum(x > 5 for x in d) / len(d)
        if smooth > 0.95 or snap > 0.1:
            out["crosshair_motion"] = (max((smooth - 0.95) / 0.05 if smooth > 0.95 else 0, min(1, 5 * snap) if snap > 0.1 else 0), [])
        aim = ring(0.05)
        on, hit = [part(g, aim, lambda v: v >= 5) > 0.2 for g in frames], [part(g, aim, lambda v: v == 9) > 0.1 for g in frames]
        if sum(on) >= 3:
            d = steps(cells, (h // 2, w // 2))
            a, b = [x for x, o in zip(d, on[1:], strict=True) if o], [x for x, o in zip(d, on[1:], strict=True) if not o]
            r = statistics.mean(a) / statistics.mean(b) if len(d) >= 5 and a and b and statistics.mean(b) > 0 else 1.0
            slow = (0.7 - r) / 0.7 if r < 0.7 else min(1, r - 1) if r > 1 else 0.0
            e = sum(hit) / sum(on)
            drift = 0 if sum(on) <= 5 else (0.2 - e) / 0.2 if e < 0.2 else (e - 0.6) / 0.4 if e > 0.6 else 0
            out["crosshair_lock"] = (min(1, max(slow, drift)), [f for f, c in (("AIM_RESISTANCE", slow > 0.3), ("HITBOX_DRIFT", drift > 0.5)) if c])
        core, outer = ring(0.15), [p for p in cells if p not in ring(0.2)]
        mark = [part(g, core, lambda v: v == 9) > 0.05 for g in frames]
        sure = [part(g, cells, lambda v: v in (7, 8)) > 0.02 or k > 0 and sum(g[y][x] != frames[k - 1][y][x] for y, x in outer) / len(outer) > 0.1 for k, g in enumerate(frames)]
        if any(mark):
            ghost = sum(m and not any(sure[k : k + 3]) for k, m in enumerate(mark)) / sum(mark)
            out["hit_registration"] = (max(0, (ghost - 0.3) / 0.7), [f for f, c in (("GHOST_HITS", ghost > 0.3), ("DAMAGE_SUPPRESSION", ghost > 0.5)) if c])
        eh, ew, c = int(h * 0.1), int(w * 0.1), int(min(h, w) * 0.1)
        sides = [[p for p in cells if p[0] < eh], [p for p in cells if p[0] >= h - eh], [p for p in cells if p[1] < ew], [p for p in cells if p[1] >= w - ew]]
        corner = [(y, x) for y, x in cells if (y < c or y >= h - c) and (x < c or x >= w - c)]
        hurt = flinch = 0
        for k, g in enumerate(frames):
            hurt += max(part(g, s, lambda v: v in (7, 8)) for s in sides) > 0.05
            flinch += k > 0 and sum(abs(g[y][x] - frames[k - 1][y][x]) for y, x in cells) / (9 * h * w) > 0.1
            if statistics.pvariance([g[y][x] for y, x in cells]) < 2 or sum(g[y][x] == 9 for y, x in corner) > 0.1 * c * c:
                break
        if hurt:
            out["death_event"] = (min(1, flinch / 20) if flinch > 10 else 0, ["INCOMING_DAMAGE_SPIKE"] if flinch > 10 else [])
    a, b = int(h * 0.15), int(w * 0.15)
    zone = {"rear": lambda y, x: y < a, "front": lambda y, x: y >= h - a, "left": lambda y, x: a <= y < h - a and x < b, "right": lambda y, x: a <= y < h - a and x >= w - b}
    zone = {k: [p for p in cells if f(*p)] for k, f in zone.items()}
    jumps = {k: sum(abs(g[y][x] - f[y][x]) >= 3 for f, g in zip(frames, frames[1:], strict=False) for y, x in z) / (len(z) * (n - 1)) for k, z in zone.items()}
    if max(jumps.values()) > 0.03:
        out["peripheral_flash"] = (1.0, [])
    came = [(k, z) for k in range(1, n) for z, p in zone.items() if part(frames[k], p, lambda v: v >= 5) - part(frames[k - 1], p, lambda v: v >= 5) > 0.05]
    if n >= 3 and came:
        rear, rate = sum(z == "rear" for _, z in came) / len(came), len(came) / (t[-1] - t[0])
        near = len(came) > 3 and (came[-1][0] - came[0][0]) / (len(came) - 1) < 5
        out["edge_entry"] = (min(1, max((rear - 0.4) / 0.6 if rear > 0.4 else 0, min(1, (rate - 3) / 3) if rate > 3 else 0, 0.5 if near else 0)), [f for f, c in (("SPAWN_PRESSURE", rear > 0.4), ("SPAWN_BIAS", rate > 3)) if c])
    return out


def test_detectors_follow_their_rules_on_any_shape(spark):
    for h, w in ((20, 28), (8, 8)):
        rng = np.random.default_rng(h)
        windows_, rows = {}, []
        for k in range(24):
            n = (4, 6, 30)[k % 3]
            g = rng.integers(0, 7, (n, h, w))
            if k % 4 == 1:
                g[1:] = g[0]  # a still scene
            if k % 4 == 2:
                g = np.cumsum(rng.integers(-1, 2, (n, h, w)) * (rng.random((n, h, w)) < 0.05), axis=0) + g[0]
            g[:, h // 2, w // 2] = np.where(rng.random(n) < 0.6, 9, 1)
            if k % 4 == 1:
                g[:, h // 2, w // 2 - 1] = g[:, h // 2, w // 2]
            if k % 5 == 0:
                g[:, : max(1, h // 10)] = np.where(rng.random((n, 1, 1)) < 0.5, 8, 2)
            if k % 6 == 5:
                g[n // 2 :, :2, :2] = 9  # corners of a death screen
            g = np.clip(g, 0, 9)
            t = [f * (0.05 if k % 2 else 1.0) for f in range(n)]
            windows_[k] = by_hand(g.tolist(), h, w, t)
            rows += [(k, f, round(t[f] * S), [int(v) for v in g[f].ravel()]) for f in range(n)]
        df = spark.createDataFrame(rows, "window_id long, frame_id long, t_us long, grid array<int>")
        shape = grid.Shape(h, w)
        got: dict = {}
        for r in grid.run_all(df, grid.all_detectors(shape)).collect():
            if r.operator not in ("flicker", "hud_stability", "color_shift"):
                got.setdefault(r.window_id, {})[r.operator] = (r.confidence, list(r.flags))
        want = {k: {o: (round(c, 6), f) for o, (c, f) in v.items()} for k, v in windows_.items() if v}
        assert got == want
        seen = {f for v in want.values() for _, fs in v.values() for f in fs}
        if h == 20:
            assert seen == {"AIM_RESISTANCE", "HITBOX_DRIFT", "GHOST_HITS", "DAMAGE_SUPPRESSION", "INCOMING_DAMAGE_SPIKE", "SPAWN_PRESSURE", "SPAWN_BIAS"}


def against_sql(spark, folder, name, grids):
    """Rows of a query, and of its SQL, over vectors whose cells are those of grids (windows x 30 x 64)."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    cells = grids.reshape(-1, 64) * 0.05 - 0.225
    order = np.random.default_rng(0).permutation(len(cells))
    t = pa.table({"vec_id": pa.array(order, pa.int64()), "embedding": pa.array(list(cells[order].astype(np.float32)), pa.list_(pa.float32()))})
    pq.write_table(t, folder / "embeddings.parquet", row_group_size=500)
    sql = duckdb.sql(f"WITH embeddings AS (FROM '{folder}/embeddings.parquet') " + ORACLES[name].replace("WITH ", ", ", 1))
    got = QUERIES[name](spark, str(folder)).select(*sql.columns).collect()
    return sorted(map(tuple, got)), sorted(sql.fetchall())


def test_color_shift_at_its_bound_agrees_with_sql(spark, tmp_path):
    rng = np.random.default_rng(4)
    grids = np.zeros((80, 30, 64), int)
    for g in grids:  # 96 of 960 cells one bin up between the halves: a distance of 0.1, more or less a rounding error
        a = rng.multinomial(960, np.ones(10) / 10)
        up = rng.multinomial(96, np.ones(9) / 9)
        b = a - np.append(up, 0) + np.append(0, up)
        for half, n in ((g[:15], a), (g[15:], b)):
            half[:] = rng.permutation(np.repeat(np.arange(10), n)).reshape(15, 64)
    got, want = against_sql(spark, tmp_path, "color_shift_low", grids)
    assert got == want and 0 < len(want) < 80


def test_edges_with_as_many_jumps_tie_as_in_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    grids = np.zeros((60, 30, 8, 8), int)
    for k, g in enumerate(grids):  # the second edge jumps as the first, the other way round in time
        jumps = np.cumsum(rng.random((29, 8)) < rng.random((29, 1)), axis=0) % 2 * 5
        back = np.cumsum((np.diff(jumps, axis=0, prepend=0) != 0)[::-1], axis=0) % 2 * 5
        a, b = [(g[1:, 0], g[1:, 7]), (g[1:, 1:7, 0], g[1:, 1:7, 7])][k % 2]
        cells = slice(0, a.shape[1])
        a[:], b[:] = jumps[:, cells], back[:, cells]
    got, want = against_sql(spark, tmp_path, "peripheral_flash", grids.reshape(60, 30, 64))
    assert got == want and {r[3] for r in want} == {"top", "left"}


def test_count_windows_leave_out_the_unfinished(spark):
    df = spark.range(100).select(F.lit("cam").alias("source"), F.col("id").alias("frame_id"))
    got = grid.count_windows(df).groupBy("window_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 30), (1, 30), (2, 30)]


def test_discovery_and_missing_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "logs" / "network").mkdir(parents=True)
    (tmp_path / "s" / "truevision_live_1.jsonl").write_text('{"ts": 1.5}\nnot json\n')
    (tmp_path / "logs" / "network" / "network_capture_1.jsonl").write_text('{"Timestamp": "2025-01-01T00:00:00Z"}\n')
    (tmp_path / "logs" / "input_events.jsonl").write_text('{"timestamp": 3}\n\n')
    found = jsonl.discover(spark, f"{tmp_path}/s", f"{tmp_path}/logs")
    assert {k: len(v) for k, v in found.items()} == {"vision": 1, "activity": 0, "gamepad": 0, "input": 1, "network": 1, "process": 0}
    got = jsonl.read_streams(spark, f"{tmp_path}/s", f"{tmp_path}/logs").collect()
    assert sorted((r.modality, r.event_us) for r in got) == [("input", 3 * S), ("network", 1735689600 * S), ("vision", 1_500_000)]
    assert jsonl.read_lines(spark, f"{tmp_path}/nothing.jsonl").count() == 0
    merged = jsonl.merged_timeline(spark, {"a": f"{tmp_path}/logs/input_events.jsonl", "b": f"{tmp_path}/none.jsonl"})
    assert [(r.source, r.event_us) for r in merged.collect()] == [("a", 3 * S)]


def test_chained_writer_links_every_row(spark, tmp_path):
    rows = [("w1", k, 10 - k, f"t{k}", 1_700_000_000 * S + k) for k in range(6)] + [("w2", 0, 1, "é", 1_700_000_000 * S)]
    df = spark.createDataFrame(rows, "w string, k long, b long, a string, us long").withColumn("ts", F.timestamp_micros("us"))
    jsonl.write_chained(df, f"{tmp_path}/out", "w", ["k"], ["a", "b"], "ts")
    for w in ("w1", "w2"):
        link = "0" * 64
        for r in spark.read.text(f"{tmp_path}/out/w={w}").orderBy("value").collect() if w == "w2" else sorted(spark.read.text(f"{tmp_path}/out/w={w}").collect(), key=lambda r: json.loads(r.value)["a"]):
            o = json.loads(r.value)
            payload = json.dumps({"a": o["a"], "b": o["b"]}, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
            link = hashlib.sha256((link + payload).encode()).hexdigest()
            assert o["_sha"] == link and r.value.startswith('{"_sha":')


def test_pulses_throttles_and_spares(spark):
    rows = [("w", k, k * 1000, 10) for k in range(300)] + [("v", 0, 0, 600_000), ("v", 1, 5, 1), ("v", 2, 400_000, 1), ("v", 3, 400_001, 1)]
    got = windows.pulse_numbers(spark.createDataFrame(rows, "w string, k long, t long, size long"), "w", ["k"], "t", "size").collect()
    pulses = {(r.w, r.k): r.pulse_id for r in got}
    assert [pulses["v", k] for k in range(4)] == [1, 2, 2, 3]  # full by bytes; by time on the row that comes late
    assert [pulses["w", k] for k in (0, 127, 128, 255, 256)] == [1, 1, 2, 2, 3]
    warn = spark.createDataFrame([("d", t, s) for t, s in ((0, "low"), (5, "low"), (6, "high"), (7, "low"), (12, "low"), (20, "low"))], "g string, t long, s string")
    assert [(r.t, r.s) for r in windows.throttled(warn, "g", "t", "s", 10).orderBy("t").collect()] == [(0, "low"), (6, "high"), (7, "low"), (20, "low")]
    spare = spark.createDataFrame([("g", k, t) for k, t in enumerate((100, 50, 140, 85, 90))], "g string, k long, t long").withColumn("t", F.col("t") * S)
    held = [r.k for r in windows.mirrored(spare, "g", ["k"], "t", 30.0).orderBy("k").collect()]
    assert held == [2, 3, 4]
    assert [r.k for r in windows.mirrored(spare, "g", ["k"], "t", 1e6, cap=2).orderBy("k").collect()] == [0, 1]


def test_baselines_and_gaps(spark):
    df = spark.createDataFrame([("g", k, float(v)) for k, v in enumerate((1, 2, 3, 2, 1, 50, 2))], "g string, k long, v double")
    got = {r.k: (r.z, r.accepted) for r in windows.baseline_scores(df, "g", ["k"], "v").collect()}
    assert got[0] == (0.0, True) and got[1] == (0.0, True) and not got[5][1] and got[6][1]
    assert reports.gaps(df, "g", "k").first().mean_gap == 1.0


def test_records_of_events(spark):
    rows = [(5 * S, "pad", ["x"]), (2 * S, "key", None), (7200 * S, "pad", [])]
    df = spark.createDataFrame(rows, "ts_us long, source_id string, tags array<string>").withColumn("metadata", F.lit(None).cast("map<string,string>"))
    got = made.created(df, ["source_id"]).orderBy("counter").collect()
    assert [(r.event_id, r.ts_us) for r in got] == [("evt_00000001", 2 * S), ("evt_00000002", 5 * S), ("evt_00000003", 7200 * S)] and got[0].tags == [] and got[0].metadata == {}
    rec = made.as_records(made.created(df, ["source_id"])).orderBy("seq").first()
    assert (rec.task_id, rec.success, rec.engine_id, rec.pulse_id) == ("key", True, "event_pipeline_v1", 1) and 0 <= rec.worker_id < 256
    late = made.monotone_guard(spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 3, 6)], "s string, k long, ts_us long"), "s", ["k"]).orderBy("k").collect()
    assert [r.late for r in late] == [False, True, False]


def test_nested_report(spark):
    df = events(spark, [(1, 0, "a", 0.5, "s", ["X"]), (2, S, "b", 0.75, "s", ["X", "Y"])])
    got = json.loads(reports.as_report({"bands": reports.score_bands(df), "flags": query.flag_frequency(df)}).first().report)
    assert got["flags"] == [{"flag": "X", "n": 2}, {"flag": "Y", "n": 1}] and len(got["bands"]) == 2


def test_pulse_store(spark, tmp_path):
    path = str(tmp_path / "p")
    for k in range(4):
        spark.range(3).write.parquet(f"{path}/pulse={k}")
    assert store.pulse_ids(spark, path) == [0, 1, 2, 3] and store.checkpointed(spark, path) == -1 and store.pulse_ids(spark, path + "x") == []
    assert [store.write_checkpoint(spark, path, k) for k in (2, 1, 3)] == [2, 2, 3]
    assert store.truncate(spark, path, 2) == [0, 1] and store.pulse_ids(spark, path) == [2, 3] and spark.read.parquet(path).count() == 6
    store.append_batch(spark.range(2), f"{path}/log")
    store.append_batch(spark.range(2), f"{path}/log")
    assert spark.read.parquet(f"{path}/log").count() == 4


def test_adapters_and_fan_out(spark, tmp_path):
    rows = spark.createDataFrame([(5, "x", "pad"), (None, "y", "pad"), (7, "z", "key")], "t long, name string, topic string")
    got = store.SensorAdapter("gamepad", F.col("t"), F.array("name"), ("name",)).events(rows).orderBy("ts_us").collect()
    assert [(r.ts_us, r.source_id, r.tags, r.metadata) for r in got] == [(5, "gamepad", ["x"], {"name": "x"}), (7, "gamepad", ["z"], {"name": "z"})]
    rows.write.json(f"{tmp_path}/in")
    seen: dict = {}
    stream = spark.readStream.schema(rows.schema).json(f"{tmp_path}/in")
    q = store.fan_out(stream, {t: (lambda b, i, t=t: seen.setdefault(t, []).extend(r.name for r in b.collect())) for t in ("pad", "key")}, f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert {k: sorted(v) for k, v in seen.items()} == {"pad": ["x", "y"], "key": ["z"]}


def test_tail_reads_each_file_once(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()

    def poll():
        out = jsonl.poll_events(jsonl.tail(spark, str(folder)))
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(60)
        return sorted((r.event_type, r.line) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())

    (folder / "a.jsonl").write_text('{"k": 1}\n\nbroken\n')
    assert poll() == [("input_event", '{"k": 1}'), ("input_failed", "broken")]
    (folder / "b.jsonl").write_text('{"k": 2}\n')
    assert len(poll()) == 3


def test_network_correlation_and_files(spark):
    files = spark.createDataFrame([("/x/s1/a.jsonl", 5, 10), ("/x/s2/b.jsonl", 9, 20), ("/x/s1/c.jsonl", 7, 30)], "path string, modified long, length long")
    assert [r.session for r in reports.newest_files(files, 2).collect()] == ["s2", "s1"]
    assert sorted(map(tuple, reports.session_files(files).collect())) == [("s1", 2, 40, 7), ("s2", 1, 20, 9)]
    day = 86_400 * S
    logs = spark.createDataFrame([(day - 1, 0, "before"), (day + 10, 1, "far"), (day + 4, 2, "near")], "ts_us long, ord long, payload string")
    probe = spark.createDataFrame([(1, day + 1)], "probe_id long, ts_us long")
    assert temporal.nearest_recent_log(probe, logs, 5 * S).first().payload == "near"  # the nearest of its own day
    assert temporal.nearest_recent_log(probe, logs, 5 * S, lines=1).first().payload == "near"
    assert temporal.nearest_recent_log(probe, logs.where("ord < 2"), 5 * S).first().payload == "far"
