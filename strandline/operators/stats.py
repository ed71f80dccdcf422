"""Session statistics: exclusive quantiles, profiles, co-occurrence, cascades, thresholds, composite scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_quantile(ordered: Column, n: int, k: int) -> Column:
    """The k-th of n quantiles of a sorted array by the exclusive method; null under two values."""
    m = F.size(ordered)
    j = F.least(F.greatest(F.floor(F.lit(k) * (m + 1) / n).cast("int"), F.lit(1)), m - 1)
    delta = F.lit(k) * (m + 1) - j * n
    return F.when(m >= 2, (F.element_at(ordered, j) * (n - delta) + F.element_at(ordered, j + 1) * delta) / n)


def profile(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median, sample deviation, range and exclusive quantiles of each group, and how many values are over 0. Values are ranked within
    their group, which sorts and spills, and only those beside a quantile are kept."""
    w = Window.partitionBy(by)
    v = F.col(value)
    d = df.where(v.isNotNull()).select(by, v.alias("_v"), F.row_number().over(w.orderBy(value)).alias("_rn"), F.count(F.lit(1)).over(w).alias("_m"))

    def quantile(n: int, k: int) -> Column:
        m = F.col("_m")
        j = F.least(F.greatest(F.floor(F.lit(k) * (m + 1) / n), F.lit(1)), m - 1)
        at = lambda place: F.max(F.when(F.col("_rn") == place, F.col("_v")))
        delta = F.max(F.lit(k) * (m + 1) - j * n)
        return F.round(F.when(F.max(m) >= 2, (at(j) * (n - delta) + at(j + 1) * delta) / n), 6)

    x, rows = F.col("_v"), F.count(F.lit(1))
    g = d.groupBy(by).agg(
        rows.alias("n"), F.round(F.avg(x), 9).alias("mean"), F.round(F.stddev_samp(x), 6).alias("deviation"), F.min(x).alias("least"), F.max(x).alias("most"), quantile(2, 1).alias("median"), quantile(4, 1).alias("p25"), quantile(4, 3).alias("p75"),
        F.when(rows < 10, F.max(x)).otherwise(quantile(10, 9)).alias("p90"), F.count_if(x > 0).alias("non_zero"), F.round(F.count_if(x > 0) / rows, 6).alias("rate"),
    )
    return g


def cooccurrence(windows: DataFrame, key: str, item: str) -> DataFrame:
    """Unordered pairs of a window's detections, those of one item with itself too, how many there are and their percentage of all windows."""
    counts = windows.groupBy(key, item).agg(F.count(F.lit(1)).alias("c"))
    sets = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("a"), "c"))).alias("s"))  # as many as there are kinds of items
    pairs = F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 1, size(s)), (y, j) -> struct(x.a as first, y.a as second, if(j = 0, x.c * (x.c - 1) div 2, x.c * y.c) as k))))")
    each = sets.select(F.explode(pairs).alias("p")).where("p.k > 0")
    total = sets.agg(F.count(F.lit(1)).alias("_all"))
    out = each.groupBy("p.first", "p.second").agg(F.sum("p.k").alias("pairs"))
    return out.crossJoin(F.broadcast(total)).select("first", "second", "pairs", F.round(100.0 * F.col("pairs") / F.col("_all"), 6).alias("pct"))  # one row


def cascades(windows: DataFrame, gap_us: int, bucket_us: int = 86_400_000_000) -> DataFrame:
    """Windows (start_us, n) of two detections or more that one with a detection follows within gap_us. Rows are ordered within buckets of time;
    a bucket's last one is followed by the next bucket's first, and only a row a bucket is ordered in one task."""
    d = windows.withColumn("_b", F.floor(F.col("start_us") / bucket_us))
    w = Window.partitionBy("_b").orderBy("start_us")
    d = d.withColumn("_next", F.lead(F.struct("start_us", "n")).over(w))
    firsts = d.groupBy("_b").agg(F.min(F.struct("start_us", "n")).alias("_first"))
    after = firsts.select(F.col("_b").alias("_at"), F.lead("_first").over(Window.orderBy("_b")).alias("_after"))
    d = d.join(after, F.col("_b") == F.col("_at")).withColumn("_next", F.coalesce("_next", "_after"))
    hit = (F.col("n") >= 2) & (F.col("_next.n") >= 1) & (F.col("_next.start_us") - F.col("start_us") <= gap_us)
    return d.where(hit).select("start_us", "n", F.col("_next.start_us").alias("next_us"), F.col("_next.n").alias("next_n"), (F.col("_next.start_us") - F.col("start_us")).alias("duration_us"), (F.col("n") + F.col("_next.n")).alias("total"))


def outliers(df: DataFrame, value: str, sigmas: float = 2.0) -> DataFrame:
    """Rows over mean + sigmas deviations of all rows."""
    m = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.crossJoin(F.broadcast(m)).where((F.col("_s") > 0) & (F.col(value) > F.col("_m") + sigmas * F.col("_s"))).drop("_m", "_s")  # one row


def thresholds(easy: DataFrame, hard: DataFrame, by: str, confidence: str, metrics: list[str]) -> DataFrame:
    """(by, metric, threshold), for groups on both sides: of the confidence the midpoint of the means, to 2 digits; of each metric that of the easy
    side's upper and the hard side's lower deviation, to 3. Halves go to the even digit."""

    def stat(d: DataFrame, side: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("v")) for m, c in (("confidence", confidence), *((m, m) for m in metrics))])).alias("x")
        return d.select(by, each).groupBy(by, "x.metric").agg(F.avg("x.v").alias(f"m{side}"), F.coalesce(F.stddev_samp("x.v"), F.lit(0.0)).alias(f"s{side}"))

    d = stat(easy, "e").join(stat(hard, "h"), [by, "metric"])
    middle, apart = (F.col("me") + F.col("mh")) / 2, ((F.col("me") + F.col("se")) + (F.col("mh") - F.col("sh"))) / 2
    return d.select(by, "metric", F.when(F.col("metric") == "confidence", F.bround(middle, 2)).otherwise(F.bround(apart, 3)).alias("threshold"))


def composite(detections: DataFrame, weights: dict[str, float], key: str, operator: str = "operator", confidence: str = "score") -> DataFrame:
    """Weighted mean of the confidences, clamped to 0 and 1; unknown operators weigh 0; the union of flags; verdicts."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(operator)], F.lit(0.0))
    g = detections.groupBy(key).agg(F.sum(F.col(confidence) * w).alias("_s"), F.sum(w).alias("_w"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))), ",").alias("flags"))
    s = F.round(F.when(F.col("_w") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s") / F.col("_w")))).otherwise(0.0), 6)
    return g.select(key, s.alias("composite"), (s >= 0.5).alias("manipulation"), (s >= 0.75).alias("high_confidence"), "flags")
