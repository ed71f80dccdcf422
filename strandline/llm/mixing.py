"""Mixing sources to target weights by entropy balancing.

A source's documents get rates w in [0, 2] that stay close to 1 in relative entropy while the source's expected words
meet its target: w = 2 / (1 + exp(-a * size)), tilted by the multiplier a of the source's token constraint (size in units of
the source's mean). The multipliers solve the convex dual by Newton steps, each a distributed sum over a histogram of
sizes. Rates become copies by rounding against a hash of the document; one threshold a source shifts the rounding until
its words meet the target to within about a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, repeated, words_in

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
STEPS = 12
RESULT = ("doc_id", "size", "source_size", "target", "rate", "copies", "taken")
#: Digits of the rounding threshold that are found level by level: 3 levels of 12 bits.
BITS, LEVELS = 12, 3


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): `share` of all words dealt by weight, none over `most` times its source, the excess
    dealt again by weight among the rest. Sources by code point, null last, take the weights in turn.

    Sources fill up in the order of most * size / weight; with the k first full, the level of the rest is what is left by
    the weights left. The right k is the first whose next source stays below its bound."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))  # one row a source
    per = per.withColumn("_at", F.row_number().over(place) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(cap / F.col("weight"), "_at")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("_level", level).withColumn("_open", level * F.col("weight") <= cap)
    first = F.min(F.when(F.col("_open"), F.struct((cap / F.col("weight")).alias("c"), "_at", "_level"))).over(Window.partitionBy())["_level"]
    return per.select("source", "source_size", F.least(cap, F.coalesce(first * F.col("weight"), cap)).alias("target"))


def _rate(a, size, mean):
    x = a * size / mean
    return F.when(x > 40, F.lit(2.0)).when(x < -40, F.lit(0.0)).otherwise(F.lit(2.0) / (F.lit(1.0) + F.exp(-x)))


def balance(sizes: DataFrame, goal: DataFrame, scratch: Scratch, steps: int = STEPS) -> DataFrame:
    """goal with `a`, the multiplier of each source (null: all rates 2, the target is at its bound)."""
    hist = scratch.save(sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    mean = hist.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    # start at the solution for equal sizes
    part = F.try_divide(F.col("target"), MOST * F.col("source_size"))
    state = goal.join(mean, goal.source.eqNullSafe(mean.source), "left").drop(mean.source)
    state = state.withColumn("a", F.when((part > 1e-9) & (part < 1 - 1e-9), F.log(part / (1 - part))))
    state = state.withColumn("lo", F.lit(-1e6)).withColumn("hi", F.lit(1e6))
    state = scratch.save(state)
    for _ in range(steps):
        h = hist.join(state.select(F.col("source").alias("s"), "a", "mean"), F.col("source").eqNullSafe(F.col("s")))
        w = _rate(F.col("a"), F.col("size"), F.col("mean"))
        words = F.col("n") * F.col("size")
        g = h.groupBy("s").agg(F.sum(words * w).alias("got"), F.sum(words * w * (1 - w / 2) * F.col("size") / F.col("mean")).alias("slope"))
        j = state.join(g, state.source.eqNullSafe(g.s), "left").drop("s")
        gap = F.col("target") - F.col("got")
        lo, hi = F.when(gap > 0, F.col("a")).otherwise(F.col("lo")), F.when(gap <= 0, F.col("a")).otherwise(F.col("hi"))
        step = F.col("a") + F.when(F.col("slope") > 1e-12, gap / F.col("slope")).otherwise(0.0)
        # a Newton step, halved into the bracket where it would leave it
        kept = F.when((step > lo) & (step < hi), step).when((lo > -1e6) & (hi < 1e6), (lo + hi) / 2).otherwise(F.col("a") + F.signum(gap))
        new = scratch.save(j.select("source", "source_size", "target", "mean", F.when(F.col("a").isNotNull(), kept).alias("a"), lo.alias("lo"), hi.alias("hi")).coalesce(1))
        scratch.drop(state)
        state = new
    scratch.drop(hist)
    return state.select("source", "source_size", "target", "mean", "a")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken): a row for every row of `docs`, with the columns named in
    `keep` besides, but for those of these names. copies is 0, 1 or 2; taken is copies * size.

    Null and empty texts have size 0, rate 1 and one copy, of no words; long ones are counted whole. A null source is a source of its
    own. Rows alike in id, source, text and the kept columns draw evenly spaced numbers, so they share their copies out among
    themselves. Reruns agree, whatever the partitions. An empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "mixing")
    keep = [c for c in keep or [] if c not in RESULT]
    span = 1 << (BITS * LEVELS)
    hashed = F.xxhash64(F.col(doc_id).cast("string"), F.col(doc_id).isNull(), F.col(source), F.col(text).cast("string"), *[F.col(c).cast("string") for c in keep])
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text).cast("string")).alias("size"), hashed.alias("h"), *[F.col(c).alias(f"_k_{c}") for c in keep])
    sized = scratch.save(base if not keep else base.select("source", "size", "h"))
    if not keep:  # the texts are read once
        base = sized
    groups = sized.groupBy("source", "size", "h").agg(F.count(F.lit(1)).alias("times"))
    turn = lambda j: F.pmod(F.col("h") + F.floor(F.col(j) * (span / F.col("times"))), F.lit(span)).cast("long")
    small = scratch.save(repeated(groups, "times", "j").select("source", "size", turn("j").alias("draw")))
    twice = scratch.save(groups.where("times > 1").select(F.col("h").alias("twice")).distinct())
    if twice.isEmpty():
        base = base.withColumn("draw", F.pmod("h", F.lit(span)).cast("long")).drop("h")
    else:
        cols = [c for c in base.columns if c != "h"]
        once = base.join(twice, F.col("h") == F.col("twice"), "left_anti").select(*cols, F.pmod("h", F.lit(span)).cast("long").alias("draw"))
        more = base.join(twice, F.col("h") == F.col("twice"), "left_semi").groupBy(*base.columns).agg(F.count(F.lit(1)).alias("times"))
        base = once.unionByName(repeated(more, "times", "j").select(*cols, turn("j").alias("draw")))
    goal = scratch.save(targets(small, weights, share, most).coalesce(1))
    state = scratch.save(balance(small, goal, scratch).coalesce(1))
    # a copy more than floor(rate) where draw < fraction + shift: the place of a document is draw - fraction
    st = state.select(F.col("source").alias("s"), "source_size", "target", "mean", "a")

    def rated(d: DataFrame) -> DataFrame:
        d = d.join(st, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        full = F.col("target") >= most * F.col("source_size")
        d = d.withColumn("rate", F.when(F.col("size") == 0, 1.0).when(full, 2.0).when(F.col("a").isNull(), 0.0).otherwise(_rate(F.col("a"), F.col("size"), F.col("mean"))))
        whole = F.when(F.col("rate") >= 2, 1.0).otherwise(F.floor("rate"))
        d = d.withColumn("whole", whole.cast("long"))
        return d.withColumn("place", F.greatest(F.lit(0).cast("long"), F.least(F.lit(2 * span - 1), (F.col("draw") - (F.col("rate") - F.col("whole")) * span + span).cast("long"))))

    placed = scratch.save(rated(small).where("size > 0").select("source", "size", "whole", "place", "target"))
    cut = placed.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("need")).withColumn("low", F.lit(0).cast("long"))
    cut = scratch.save(cut.coalesce(1))
    width = 2 * span
    for _ in range(LEVELS):
        width = max(1, width >> BITS)
        c = cut.select(F.col("source").alias("s"), "need", "low")
        inside = placed.join(c, placed.source.eqNullSafe(c.s)).where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.lit(width << BITS if width > 1 else 1 << BITS + 1)))
        bins = inside.groupBy("s", "need", "low", F.floor((F.col("place") - F.col("low")) / width).alias("bin")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 8192 bins at most
        bins = bins.withColumn("upto", F.sum("words").over(run))
        fits = bins.where("upto <= need").groupBy("s").agg(F.max("bin").alias("bin"), F.max("upto").alias("upto"))
        new = c.join(fits.select(F.col("s").alias("f"), "bin", "upto"), F.col("s").eqNullSafe(F.col("f")), "left")
        new = new.select(F.col("s").alias("source"), (F.col("need") - F.coalesce("upto", F.lit(0))).alias("need"), (F.col("low") + (F.coalesce(F.col("bin") + 1, F.lit(0))) * width).cast("long").alias("low"))
        new = scratch.save(new.coalesce(1))
        scratch.drop(cut)
        cut = new
    # one more copy, of the document that brings the source nearest to its target; of those with two copies none
    c = cut.select(F.col("source").alias("s"), "need", "low")
    after = placed.join(c, placed.source.eqNullSafe(c.s)).where(F.col("whole") + (F.col("place") < F.col("low")).cast("int") < 2)
    nearest = after.groupBy("s", "need").agg(F.min(F.struct(F.abs(F.col("need") - F.col("size")).alias("gap"), "place", "size")).alias("best"))
    more = nearest.where(F.col("best.gap") < F.abs(F.col("need"))).select(F.col("s").alias("n"), F.col("best.place").alias("one_place"), F.col("best.size").alias("one_size"))
    cut = scratch.save(c.join(more, F.col("s").eqNullSafe(F.col("n")), "left").select("s", F.col("low").alias("shift"), "one_place", "one_size").coalesce(1))
    scratch.drop(small, placed, *([sized] if keep else []))
    out = rated(base).join(cut.withColumnRenamed("s", "c"), F.col("source").eqNullSafe(F.col("c")), "left")
    below = F.coalesce(F.col("place") < F.col("shift"), F.lit(False)).cast("int")
    one = F.coalesce((F.col("place") == F.col("one_place")) & (F.col("size") == F.col("one_size")), F.lit(False)).cast("int")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("whole") + below + one).cast("int")
    copies = F.least(F.lit(int(most)), copies)
    out = out.withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"_k_{x}").alias(x) for x in keep or []])
