"""Row neighbourhoods, changes, clamps and folds over ordered rows."""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def capsules(df: DataFrame, source: str, before: int = 6, after: int = 6, ts: str = "ts_us", seq: str = "seq") -> DataFrame:
    """Every row with the ids of up to `before` rows before it, newest first, and `after` rows after it, and their span."""
    w = Window.partitionBy(source).orderBy(ts, seq)
    near = w.rowsBetween(-before, after)
    return df.select(source, seq, ts, F.reverse(F.collect_list(seq).over(w.rowsBetween(-before, -1))).alias("before"), F.collect_list(seq).over(w.rowsBetween(1, after)).alias("after"), (F.max(ts).over(near) - F.min(ts).over(near)).alias("span_us"))


def change_only(df: DataFrame, partition: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows that differ from the one before in any of the columns; the first row counts."""
    w = Window.partitionBy(partition).orderBy(*order)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("_same", same & (F.row_number().over(w) > 1)).where("not _same").drop("_same")


def resets(df: DataFrame, partition: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value is below the one before: an idle time that starts anew is an input event. The first row is none."""
    return df.withColumn("_before", F.lag(value).over(Window.partitionBy(partition).orderBy(*order))).where(F.col(value) < F.col("_before")).drop("_before")


def monotone_clamp(df: DataFrame, partition: str, order: list[str], ts: str, name: str = "clock") -> DataFrame:
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.max(ts).over(w))


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def ordered_fold(df: DataFrame, partition: str, order: list[str], columns: list[str], schema: str, fold: Callable[[], Callable]) -> DataFrame:
    """Runs a fold whose every step depends on what the last one decided over the rows of each key in order.

    `fold()` gives a function for one key: called with the values of (*order, *columns) of a row it gives an output tuple or None, and called
    with None, after the last row, a last one or a list of them. Output tuples are (key, *tuple) of `schema`. Rows stream through sorted partitions: a task holds
    a batch and one key's state, never a group."""
    fields = [f"_c{k}" for k in range(1 + len(order) + len(columns))]
    d = df.select(*[F.col(c).alias(n) for c, n in zip([partition, *order, *columns], fields, strict=True)])
    ordered = d.repartition(fields[0]).sortWithinPartitions(*fields[: 1 + len(order)])
    kind = T._parse_datatype_string(schema)
    names = kind.fieldNames()
    types = to_arrow_schema(kind)

    def made(key, found) -> list[tuple]:
        return [] if found is None else [(key, *x) for x in found] if isinstance(found, list) else [(key, *found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types.types, strict=True)], names)

        key, step = None, None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if step is None or row[0] != key:
                    out += made(key, step(None)) if step else []
                    key, step = row[0], fold()
                out += made(key, step(row[1:]))
            if out:
                yield batch(out)
        if step and (out := made(key, step(None))):
            yield batch(out)

    return ordered.mapInArrow(run, kind)


def _kind(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def dead_band(df: DataFrame, partition: str, order: list[str], value: str, width: float) -> DataFrame:
    """The rows (partition, *order, value) that are emitted: the first, and every one that differs from the last emitted one by more than
    width. Null values are not emitted."""

    def fold():
        last = None

        def step(row):
            nonlocal last
            if row is None or row[-1] is None or last is not None and abs(row[-1] - last) <= width:
                return None
            last = row[-1]
            return row

        return step

    return ordered_fold(df, partition, order, [value], _kind(df, partition, *order, value), fold)


class Baseline:
    """Running mean and squares that reject a value more than z deviations off, once `warm` values are in."""

    def __init__(self, z: float, warm: int):
        self.z, self.warm, self.n, self.mean, self.m2, self.rejected = z, warm, 0, 0.0, 0.0, 0

    def deviation(self) -> float:
        return math.sqrt(self.m2 / (self.n - 1)) if self.n >= 2 else 0.0

    def score(self, v: float) -> float:
        """Deviations from the mean so far; 0 under two values or without any spread."""
        sd = self.deviation()
        return (v - self.mean) / sd if sd > 0 else 0.0

    def add(self, v: float) -> bool:
        if self.n >= self.warm and abs(self.score(v)) > self.z:
            self.rejected += 1
            return False
        self.n += 1
        delta = v - self.mean
        self.mean += delta / self.n
        self.m2 += delta * (v - self.mean)
        return True


#: Deviations and warm-up of the three measures: shots to kill, time to death, shots a kill.
RULES = {"ttk": (3.0, 5), "ttd": (2.5, 3), "stk": (3.0, 5)}


def welford(df: DataFrame, partition: str, order: list[str], value: str, z: float = 3.0, warm: int = 5) -> DataFrame:
    """(partition, n, rejected, mean, deviation, warmed_up): the baseline after all rows of each key, outliers by its own state left out."""

    def fold():
        b = Baseline(z, warm)

        def step(row):
            if row is None:
                return b.n, b.rejected, round(b.mean, 6), round(b.deviation(), 6), b.n >= warm
            if row[-1] is not None:
                b.add(float(row[-1]))
            return None

        return step

    return ordered_fold(df, partition, order, [value], f"{_kind(df, partition)}, n long, rejected long, mean double, deviation double, warmed_up boolean", fold)


def baseline_scores(df: DataFrame, partition: str, order: list[str], value: str, z: float = 3.0, warm: int = 5) -> DataFrame:
    """(partition, *order, z, accepted): each row's deviations from the baseline of the rows before it, and whether it entered it."""

    def fold():
        b = Baseline(z, warm)

        def step(row):
            if row is None or row[-1] is None:
                return None
            score = b.score(float(row[-1]))
            return (*row[:-1], round(score, 6), b.add(float(row[-1])))

        return step

    return ordered_fold(df, partition, order, [value], f"{_kind(df, partition, *order)}, z double, accepted boolean", fold)


def throttled(df: DataFrame, partition: str, ts: str, severity: str, interval_us: int) -> DataFrame:
    """The warnings (partition, ts, severity) that are emitted: not one of the last emitted severity within the interval of that severity's
    last one."""

    def fold():
        last, times = None, {}

        def step(row):
            nonlocal last
            if row is None or row[1] is None or row[1] == last and row[0] - times[last] < interval_us:
                return None
            last, times[row[1]] = row[1], row[0]
            return row

        return step

    return ordered_fold(df, partition, [ts], [severity], _kind(df, partition, ts, severity), fold)


def pulse_numbers(df: DataFrame, partition: str, order: list[str], ts: str, size: str, rows: int = 128, most: int = 512 * 1024, micros: int = 250_000, first: int = 1) -> DataFrame:
    """(partition, *order, pulse_id, seq): the pulse that each row of a writer is flushed with. A pulse ends with the row that makes it `rows`
    rows or `most` bytes, or comes `micros` or more after its first one; numbers go on from `first`."""

    def fold():
        pulse, n, held, since, seq = first, 0, 0, None, 0

        def step(row):
            nonlocal pulse, n, held, since, seq
            if row is None:
                return None
            n, held, seq = n + 1, held + (row[-1] or 0), seq + 1
            since = row[-2] if since is None else since
            out = (*row[:-2], pulse, seq)
            if n >= rows or held >= most or row[-2] - since >= micros:
                pulse, n, held, since = pulse + 1, 0, 0, None
            return out

        return step

    return ordered_fold(df, partition, order, [ts, size], f"{_kind(df, partition, *order)}, pulse_id long, seq long", fold)


def transition(df: DataFrame, partition: str, order: list[str], value: str, size: int = 10, jump: float = 0.3, easy: float = 0.4) -> DataFrame:
    """The first index from 1 to n - size at which the mean of the next `size` values exceeds that of the last ones by jump, and the side of
    a group without one: easy where its mean is under `easy`, else hard; with one: mixed."""
    w = Window.partitionBy(partition).orderBy(*order)
    d = df.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(partition)))
    d = d.withColumn("gain", F.avg(value).over(w.rowsBetween(0, size - 1)) - F.avg(value).over(w.rowsBetween(-size, -1)))
    return d.groupBy(partition).agg(F.min(F.when((F.col("i") >= 1) & (F.col("i") < F.col("n") - size) & (F.col("gain") > jump), F.col("i"))).alias("first_index"), F.avg(value).alias("_mean")).select(partition, "first_index", F.when(F.col("first_index").isNotNull(), "mixed").when(F.col("_mean") < easy, "easy").otherwise("hard").alias("side"))


def mirrored(df: DataFrame, partition: str, arrival: list[str], ts: str, seconds: float = 30.0, cap: int = 50_000) -> DataFrame:
    """(partition, *arrival): what each spare's buffer holds after all rows have come in. On each arrival rows older than `seconds` before
    it leave from the head only, so an old row behind a newer one stays; at `cap` rows a newcomer is dropped. State is bounded by `cap`."""
    span = int(seconds * 1_000_000)

    def fold():
        held: deque = deque()

        def step(row):
            if row is None:
                return [x[:-1] for x in held]
            while held and held[0][-1] < row[-1] - span:
                held.popleft()
            if len(held) < cap:
                held.append(row)
            return None

        return step

    return ordered_fold(df, partition, arrival, [ts], _kind(df, partition, *arrival), fold)


def _linked(keep_rows: bool):
    def fold():
        link, n = "0" * 64, 0

        def step(row):
            nonlocal link, n
            if row is None:
                return None if keep_rows else (n, link)
            link, n = hashlib.sha256((link + row[-1]).encode()).hexdigest(), n + 1
            return (*row, link) if keep_rows else None

        return step

    return fold


def hash_chain(df: DataFrame, partition: str, order: list[str], payload: str) -> DataFrame:
    """(partition, n, head): the last link of sha256(previous link + payload), from 64 zeros."""
    return ordered_fold(df, partition, order, [payload], f"{_kind(df, partition)}, n int, head string", _linked(False))


def chained(df: DataFrame, partition: str, order: list[str], payload: str, link: str = "_sha") -> DataFrame:
    """(partition, *order, payload, link): every row with its link."""
    return ordered_fold(df, partition, order, [payload], f"{_kind(df, partition, *order, payload)}, `{link}` string", _linked(True))


def verify_chain(df: DataFrame, partition: str, order: list[str], payload: str, link: str = "_sha") -> DataFrame:
    """Rows with `valid`: their link follows from the link before."""
    w = Window.partitionBy(partition).orderBy(*order)
    return df.withColumn("valid", F.col(link) == F.sha2(F.concat(F.coalesce(F.lag(link).over(w), F.lit("0" * 64)), payload), 256))


def quiet_islands(df: DataFrame, partition: str, order: list[str], size: str, idle: int = 50, stalled: int = 100) -> DataFrame:
    """Polls of a size that did not grow, counted since the last growth: state active, idle or stalled."""
    w = Window.partitionBy(partition).orderBy(*order)
    d = df.withColumn("_grew", F.coalesce(F.col(size) > F.lag(size).over(w), F.lit(True)).cast("int"))
    d = d.withColumn("_isle", F.sum("_grew").over(w))
    d = d.withColumn("quiet", F.row_number().over(Window.partitionBy(partition, "_isle").orderBy(*order)) - 1)
    return d.withColumn("state", F.when(F.col("quiet") >= stalled, "stalled").when(F.col("quiet") >= idle, "idle").otherwise("active")).drop("_grew", "_isle")
