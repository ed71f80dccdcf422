"""Inputs in the shape of session telemetry, derived from the driver's tables by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The modality that stands for each event type.
MODALITIES = {"error": "vision", "click": "input", "view": "network", "purchase": "gamepad", "signup": "process"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored detection windows: one per event."""
    e = table(spark, sf_dir, "events")
    score = F.least(F.col("value") / 100.0, F.lit(1.0))
    return e.select(
        F.col("event_id").alias("seq"),
        (F.floor(F.col("event_id") / 128) + 1).alias("pulse_id"),
        (F.col("user_id") % 8).alias("worker_id"),
        micros("ts").alias("ts_us"),
        "ts",
        F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("session_id"),
        "user_id",
        F.col("event_type").alias("operator"),
        "value",
        score.alias("score"),
        (score <= 0.5).alias("success"),
        F.when(F.col("value") > 100, F.array("event_type", F.lit("HIGH"))).otherwise(F.array("event_type")).alias("flags"),
    )


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(modality, ord, ts_us, score, operator, user_id): the six streams; activity is the events of value over 100."""
    r = records(spark, sf_dir)
    kind = F.create_map(*[F.lit(x) for kv in MODALITIES.items() for x in kv])[F.col("operator")]
    base = r.select(kind.alias("modality"), F.col("seq").alias("ord"), "ts_us", "score", "operator", "user_id")
    busy = r.where("value > 100").select(F.lit("activity").alias("modality"), F.col("seq").alias("ord"), "ts_us", "score", "operator", "user_id")
    return base.unionByName(busy)


def sensor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events of five sources with the payload that fused windows add up."""
    r = records(spark, sf_dir)
    source = F.create_map(*[F.lit(x) for kv in MODALITIES.items() for x in kv])[F.col("operator")]
    kind = lambda *names: F.get(F.array(*[F.lit(x) for x in names]), (F.col("seq") % len(names)).cast("int"))
    whole = F.floor("value")
    return r.select(
        source.alias("source"), "ts_us", F.col("seq").alias("ord"), F.when(source == "input", kind("key_press", "mouse_move", "mouse_click")).when(source == "gamepad", kind("stick", "button")).alias("type"), "score",
        F.array(kind("AIM_RESISTANCE", "CROSSHAIR_LOCK", "HITBOX_DRIFT")).alias("flags"), F.lit(30).cast("long").alias("frame_count"), whole.alias("bytes_sent"), (100 * whole).alias("bytes_recv"), F.lit(1).cast("long").alias("packets"),
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("process_name"), F.col("value").alias("cpu_percent"), F.col("user_id").cast("double").alias("memory_mb"),
    )


def frames(spark: SparkSession, sf_dir: str, scale: int = 1) -> DataFrame:
    """(window_id, frame_id, t_us, grid): 8 x 8 cells of 0 to 9 in row order, each shown `scale` times either way; 30 frames a window
    and a second."""
    cell = lambda x: F.greatest(F.least(F.floor((x.cast("double") + 0.25) / 0.05), F.lit(9)), F.lit(0)).cast("int")
    small = F.transform("embedding", cell)
    row = lambda y: F.flatten(F.transform(F.slice("embedding", y * 8 + 1, 8), lambda x: F.array_repeat(cell(x), scale)))
    wide = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.flatten(F.array_repeat(row(y), scale))))
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 30).alias("window_id"), (F.col("vec_id") % 30).alias("frame_id"), F.floor(F.col("vec_id") * 1_000_000 / 30).alias("t_us"), (wide if scale > 1 else small).alias("grid"))


#: The processes that events stand for, dealt by user: name, parent, account, path, command.
PROCESSES = (
    ("game.exe", "explorer.exe", "ann", "C:\\Games\\game.exe", ""),
    ("svchost.exe", "services.exe", "SYSTEM", "C:\\Windows\\svchost.exe", ""),
    ("cmd.exe", "chrome.exe", "ann", "C:\\Windows\\cmd.exe", ""),
    ("setup.exe", "", "ann", "C:\\Users\\ann\\Downloads\\setup.exe", ""),
    ("tool.exe", "launcher.exe", "ann", "C:\\Users\\ann\\AppData\\tool.exe", ""),
    ("helper.exe", "EXCEL.EXE", "ann", "C:\\Office\\helper.exe", ""),
    ("powershell.exe", "services.exe", "ann", "C:\\Windows\\powershell.exe", "-Enc AAAA"),
)


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, name, parent, account, path, command): one process per event."""
    all_ = F.lit([list(p) for p in PROCESSES])
    r = records(spark, sf_dir).select("seq", F.get(all_, (F.col("user_id") % len(PROCESSES)).cast("int")).alias("p"))
    return r.select("seq", *[F.col("p")[k].alias(n) for k, n in enumerate(("name", "parent", "account", "path", "command"))])
