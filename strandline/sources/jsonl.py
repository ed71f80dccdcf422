"""JSON-lines streams: lenient, strict and counted readers, timestamps under many keys, validators, chained writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that may hold an event's time, first found first; numbers are epoch seconds, texts ISO-8601.
TIME_KEYS = ("window_start_epoch", "event_epoch", "monotonic_ts", "ts", "epoch", "timestamp", "Timestamp")
#: Keys that an event of each modality must have.
REQUIRED = {
    "network": ("Timestamp", "LocalAddress", "RemoteAddress", "State", "Protocol", "ProcessName"),
    "input": ("timestamp", "keystroke_count", "mouse_click_count", "mouse_movement_distance", "idle_seconds"),
    "activity": ("timestamp", "windowTitle", "processName"),
    "process": ("timestamp", "pid", "process_name"),
    "gamepad": ("timestamp", "event"),
}
#: File patterns of each modality, and the folder below the logs that holds them if it is there.
PATTERNS = {
    "vision": ("truevision_events.jsonl", "truevision_live_*.jsonl", "truevision_smoke_*.jsonl"),
    "activity": ("user_activity_*.jsonl", "activity_events.jsonl", "activity_*.jsonl"),
    "gamepad": ("gamepad_stream_*.jsonl", "gamepad_events.jsonl", "gamepad_*.jsonl"),
    "input": ("input_activity_*.jsonl", "input_events.jsonl", "input_*.jsonl"),
    "network": ("telemetry_*.jsonl", "network_capture_*.jsonl", "network_events.jsonl", "network_*.jsonl"),
    "process": ("process_activity_*.jsonl", "process_events.jsonl", "process_*.jsonl"),
}
_BOM = "\ufeff"


def iso_micros(text: Column) -> Column:
    """Microseconds of an ISO-8601 text with any number of fraction digits and an optional offset; null where it has none."""
    cut = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return F.unix_micros(F.try_to_timestamp(cut))


def event_micros(line: Column, keys: tuple[str, ...] = TIME_KEYS) -> Column:
    """The time of a JSON object text."""
    found = []
    for k in keys:
        v = F.get_json_object(line, f"$.{k}")
        found += [F.round(v.try_cast("double") * 1_000_000).cast("long"), iso_micros(v)]
    return F.coalesce(*found)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The files of a glob pattern, sorted by name, in any file system that Spark reads; none is no error."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [] if f.isFile())


def discover(spark: SparkSession, session: str, logs: str | None = None) -> dict[str, list[str]]:
    """The files of each modality: vision in the session folder, the others in their own folder below the logs, or in the logs themselves
    where that is not there (without logs, the session folder). A file that two patterns match is listed once, under the first."""
    base, out = logs or session, {}
    sc = spark.sparkContext
    for modality, patterns in PATTERNS.items():
        folder = session if modality == "vision" else base
        if modality != "vision":
            own = sc._jvm.org.apache.hadoop.fs.Path(f"{base}/{modality}")
            folder = f"{base}/{modality}" if own.getFileSystem(sc._jsc.hadoopConfiguration()).exists(own) else base
        out[modality] = list(dict.fromkeys(f for p in patterns for f in matching(spark, f"{folder}/{p}")))
    return out


def read_streams(spark: SparkSession, session: str, logs: str | None = None) -> DataFrame:
    """(modality, event_us, path, line): the well-formed lines of all discovered files; files and lines that are not there give no rows."""
    out = spark.createDataFrame([], "modality string, event_us long, path string, line string")
    for modality, files in discover(spark, session, logs).items():
        if files:
            one = read_lines(spark, files).where("trim(line) <> ''").where(F.get_json_object("line", "$").isNotNull())
            out = out.unionByName(one.select(F.lit(modality).alias("modality"), event_micros(F.col("line")).alias("event_us"), "path", "line"))
    return out


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line): the lines of all files, each file once, without byte-order marks; files that are not there are empty."""
    each = [p for p in dict.fromkeys([paths] if isinstance(paths, str) else paths) if matching(spark, p) or matching(spark, f"{p}/*")]
    if not each:
        return spark.createDataFrame([], "path string, line string")
    raw = spark.read.text(each)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", f"^{_BOM}", "").alias("line"))


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, mode: str = "lenient") -> DataFrame:
    """Rows of `schema` with path, event_us and line. lenient: blank and malformed lines are left out; counted: they stay, with
    _bad true; strict: the first malformed one fails the read, blank ones are left out."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    lines = read_lines(spark, paths)
    blank = F.trim("line") == ""
    if mode != "counted":
        lines = lines.where(~blank)
    parsed = F.from_json("line", full, {"mode": "FAILFAST" if mode == "strict" else "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}) if mode != "strict" else F.from_json("line", kind, {"mode": "FAILFAST"})
    out = lines.withColumn("_r", parsed)
    bad = F.lit(False) if mode == "strict" else blank | F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    out = out.withColumn("_bad", bad)
    if mode == "lenient":
        out = out.where(~F.col("_bad"))
    fields = [F.col("_r")[f.name].alias(f.name) for f in kind.fields]
    return out.select("path", *fields, event_micros(F.col("line")).alias("event_us"), "line", *(["_bad"] if mode == "counted" else []))


def merged_timeline(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(source, event_us, path, line): all files in one order: time (missing: 0), the order of the files, then the line's place. Files that are
    not there are left out."""
    out = spark.createDataFrame([], "source string, event_us long, _file int, _at long, path string, line string")
    for k, (source, path) in enumerate(files.items()):
        one = read_lines(spark, path).where("trim(line) <> ''").select(F.coalesce(F.get_json_object("line", "$.source"), F.lit(source)).alias("source"), F.coalesce(event_micros(F.col("line")), F.lit(0)).alias("event_us"), F.lit(k).alias("_file"), F.monotonically_increasing_id().alias("_at"), "path", "line")
        out = out.unionByName(one)
    return out.orderBy("event_us", "_file", "_at").drop("_file", "_at")


def validate(df: DataFrame, required: tuple[str, ...], line: str = "line") -> DataFrame:
    """Adds `missing`: the required keys that the JSON object lacks or holds null."""
    return df.withColumn("missing", F.array_compact(F.array(*[F.when(F.get_json_object(line, f"$.{k}").isNull(), k) for k in required])))


def canonical(columns: list[str]) -> Column:
    """The JSON text of a row with sorted keys and no spaces, for integers and strings."""
    return F.to_json(F.struct(*sorted(columns)))


def write_chained(df: DataFrame, path: str, writer: str, order: list[str], columns: list[str], ts: str) -> None:
    """Appends rows as JSON lines with sorted keys and `_sha`, the link sha256(previous link + canonical row), a chain per writer from 64
    zeros, filed under the writer and the day that turns at 00:01 in New York."""
    from ..operators.windows import chained

    links = chained(df.select(writer, *order, canonical(columns).alias("_row")), writer, order, "_row").drop("_row")
    rows = df.select(writer, *order, day_key(F.col(ts)).alias("day"), *[F.col(c).alias(f"_k_{c}") for c in columns]).join(links, [writer, *order])
    line = F.to_json(F.struct(*[F.col("_sha" if c == "_sha" else f"_k_{c}").alias(c) for c in sorted([*columns, "_sha"])]))
    placed = rows.select(writer, "day", *order, line.alias("value")).repartition(writer, "day").sortWithinPartitions(writer, "day", *order)
    placed.select(writer, "day", "value").write.mode("append").partitionBy(writer, "day").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """Writes a nested report (one row, column `report`) as one text file."""
    df.select(F.col("report").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def tail(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """A stream of (path, line) of files that come into a folder; each file is read once, whole, by its name: a log is tailed by the files it is
    cut into, and what was read is in the query's checkpoint."""
    raw = spark.readStream.format("text").option("pathGlobFilter", pattern).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", f"^{_BOM}", "").alias("line")).where("trim(line) <> ''")


def poll_events(lines: DataFrame) -> DataFrame:
    """(path, event_type, line) of lines polled from files (batch or stream): an `input_event` each, and `input_failed` for a malformed one."""
    ok = F.get_json_object("line", "$").isNotNull()
    return lines.select("path", F.when(ok, "input_event").otherwise("input_failed").alias("event_type"), "line")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def retained(df: DataFrame, ts: str, days: int, now_us: int, keep: Column | None = None) -> DataFrame:
    """Rows of the last `days` days, and those that `keep` marks."""
    fresh = F.col(ts) >= now_us - days * 86_400_000_000
    return df.where(fresh | keep if keep is not None else fresh)


def day_key(ts: Column) -> Column:
    """The day of a chained file, which turns at 00:01 in New York."""
    return F.date_format(F.from_utc_timestamp(ts, "America/New_York") - F.expr("interval 1 minute"), "yyyy-MM-dd")


def with_timestamp(df: DataFrame, seconds: str = "t_start", name: str = "timestamp") -> DataFrame:
    """Fills a missing ISO-8601 text from epoch seconds, in the session's time zone; whole seconds have no fraction."""
    micros = F.round(F.col(seconds) * 1_000_000).cast("long")
    t = F.timestamp_micros(micros)
    iso = F.when(micros % 1_000_000 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return df.withColumn(name, F.coalesce(F.col(name), iso) if name in df.columns else iso)
