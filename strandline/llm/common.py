"""What the corpus operators share: scratch tables, tokens, global ids and components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker holds at once.
PIECE_BYTES = 12_000_000
#: Bytes of text among which words are counted at once: counting takes some ten bytes for each.
COUNT_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one of our own in local mode, and an error on a cluster,
    whose machines would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of scratch tables that results may still read.
_held: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch() -> None:
    """Deletes all scratch tables of this process: call it once the results that read them are written. Also done at exit."""
    while _held:
        spark, path = _held.pop()
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception as e:  # at exit the JVM may be gone
            if not isinstance(e, OSError | AttributeError | RuntimeError) and type(e).__module__.partition(".")[0] not in ("py4j", "pyspark"):
                raise


atexit.register(clear_scratch)


class Scratch:
    """Tables written to the shared folder; drop() deletes those that no result reads any more, clear_scratch() all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        _held.append((spark, self.root))

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `most` bytes of text, one document at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def words(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(n + 1 offsets, all tokens): runs of other characters than the six ASCII blanks, A-Z lower-cased. Null: none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    keep = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(keep)])
    return before[offsets - offsets[0]], flat.filter(pa.array(keep))


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each token, distinct tokens)."""
    d = flat.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def word_count(column: str) -> F.Column:
    """Number of tokens of a text column, on the JVM; null: 0."""
    blanks = r"[\x20\x09-\x0D]+"
    inner = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), f"^{blanks}|{blanks}$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, blanks))).cast("long")


@F.arrow_udf(T.LongType())
def words_in(text: pa.Array) -> pa.Array:
    """Number of tokens of each text; null: 0. As word_count, at a fraction of its cost on long texts."""
    text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    at = ends[:-1][np.diff(ends) > 0]  # a text's first byte starts a word whatever stands before it
    before, total, last = np.zeros(len(ends), np.int64), 0, False  # words that start before each text's end
    for lo in range(0, len(raw), COUNT_BYTES):
        b = raw[lo : lo + COUNT_BYTES]
        solid = ~((b == 32) | (b >= 9) & (b <= 13))
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        start[0] &= not last
        i, j = np.searchsorted(at, [lo, lo + len(b)])
        start[at[i:j] - lo] = solid[at[i:j] - lo]
        upto = np.cumsum(start)
        i, j = np.searchsorted(ends, [lo, lo + len(b)], "right")
        before[i:j] = total + upto[ends[i:j] - lo - 1]
        total, last = total + int(upto[-1]), solid[-1]
    n = np.diff(before)
    return pa.array(np.where(text.is_null().to_numpy(zero_copy_only=False), 0, n))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where a column of the table has them, whatever the case."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def repeated(df: DataFrame, times: str, number: str, each: int = 20_000) -> DataFrame:
    """Every row as often as its column `times` says, numbered from 0; rows of many repeats are dealt to many tasks."""
    (part,) = fresh(df, "_part")
    d = df.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({times} - 1) div {each}"))))
    d = d.repartition(F.xxhash64(*[c for c in df.columns if c != times], part))
    return d.withColumn(number, F.explode(F.sequence(F.col(part) * each, F.least(F.col(times), (F.col(part) + 1) * each) - 1))).drop(part)


def partitions_for(rows: int, each: int = 200_000) -> int:
    """Partitions of a small intermediate table, so that iterations over it stay short."""
    return max(1, min(20_000, -(-rows // each)))


def top_rows(df: DataFrame, k: int, count: str, key: str) -> DataFrame:
    """The k rows of the highest `count` (a positive long); of rows alike, those whose `key` has the least hash.

    The cut is found digit by digit over both, 16 bits each, so that at most 65,536 bins come to the driver at a time; rows that agree in
    all digits come together."""
    most = df.agg(F.max(count), F.count(F.lit(1))).first()
    if most[1] <= k:
        return df
    hashed = F.xxhash64(F.lit(3), key)
    digits = [F.shiftright(F.col(count), s).bitwiseAND(F.lit(0xFFFF)) for s in range((int(most[0]).bit_length() - 1) // 16 * 16, -1, -16)]
    digits += [F.lit(0xFFFF) - F.shiftrightunsigned(hashed, s).bitwiseAND(F.lit(0xFFFF)) for s in (48, 32, 16, 0)]
    taken, edge, need = F.lit(False), F.lit(True), k
    for digit in digits:
        bins = df.where(edge).groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
        for d, n in sorted(map(tuple, bins), reverse=True):
            if n > need:
                taken, edge = taken | edge & (digit > d), edge & (digit == d)
                break
            need -= n
        else:
            return df.where(taken | edge)
        if not need:
            return df.where(taken)
    return df.where(taken | edge)


def dense_ids(keys: DataFrame, cols: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Adds `name`: the place of each (distinct) key in their sorted order, from 0.

    Range partitions are sorted apart and shifted by the rows before them, so that no task sees all keys."""
    spark = keys.sparkSession
    ordered = keys.repartitionByRange(*cols).sortWithinPartitions(*cols)
    held = scratch.save(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, rows = [], 0
    for part, n in sorted((r[0], r[1]) for r in held.groupBy("_part").count().collect()):  # one row a partition
        before.append((part, rows))
        rows += n
    shift = spark.createDataFrame(before or [(0, 0)], "_part int, _before long")
    return held.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the edges (u, v); alternating large and small stars.

    A star counts the least neighbour of each node and joins it to its edges; rounds end when no edge moves. Only sums of the edges come to the driver."""

    mins: list[DataFrame] = []

    def star(e: DataFrame, small: bool) -> DataFrame:
        if small:  # towards smaller neighbours: every pair once, from its larger end
            near = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        else:
            near = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # written, so that a large star's join can be dealt anew
        mins.append(least)
        linked = near.join(least, "u")
        if small:
            out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        else:
            out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(now)
    while seen[0]:
        parts = partitions_for(seen[0])
        large = scratch.save(star(now, False).coalesce(parts))
        scratch.drop(now, mins.pop())
        now = scratch.save(star(large, True).coalesce(parts))
        scratch.drop(large, mins.pop())
        last, seen = seen, mark(now)
        if last == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
