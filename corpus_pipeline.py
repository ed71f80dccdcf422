"""A corpus pipeline of five operators: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, mixing.

Each stage reads what its predecessor kept; all but the last return the columns of `documents`. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, lines, mixing, simhash, toxicity
from strandline.llm.common import Scratch, fresh


def _apart(docs: DataFrame, taken: tuple[str, ...], own: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The documents with other names for columns that a result takes, and the way back to all of their own columns."""
    clash = [c for c in docs.columns if c.lower() in taken and c not in own]
    names = dict(zip(clash, fresh(docs, *[f"_own_{c}" for c in clash]), strict=True))
    back = [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]
    return docs.withColumnsRenamed(names), lambda out: out.select(back)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; null, blank and empty texts stay. Repeated rows are judged alike, as
    often as they come, whatever their ids; a document's own columns `score`, `predicted` and `held_out` stay as they are."""
    renamed, back = _apart(docs, ("held_out", "score", "predicted"))
    scored = toxicity.score(renamed, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=renamed.columns)
    return back(scored.where("predicted = 0"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of 50 words or more go from the texts; documents of which no word is left go with them. Null, blank
    and short texts stay; rows of one id and text, a null id too, are one document and lose the same lines."""
    renamed, back = _apart(docs, ("lines_before", "lines_removed"))
    out = lines.dedup_lines(renamed)
    changed = F.col("lines_removed") > 0
    out = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return back(out)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Adds a key: id and 128 bits of the text, never null; null ids last. Only rows of one id and one text share it."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    (key,) = fresh(docs, "_key")
    return docs.withColumn(key, own), key


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked fingerprints, the document with the smallest doc_id stays, one with a null id only if no other
    is there. Of rows with that id in the group, one stays; other groups' rows with a null or the same id are not touched.
    All texts without a word are one group."""
    keyed, key = _keyed(docs)
    (keep,) = fresh(keyed, "_keep")
    groups = Scratch(spark, "groups").save(simhash.near_duplicates(keyed, doc_id=key))
    first = groups.where(F.col("doc_id") == F.col("component_id"))
    n = first.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    out = keyed.join(first.select(F.col("doc_id").alias(keep)).distinct(), F.col(key) == F.col(keep), "left_semi")
    return (out.dropDuplicates([key]) if n[0] > n[1] else out).drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows of a null or the same id with other texts stay, and so do null, blank and
    empty texts. Repeated rows go or stay together."""
    keyed, key = _keyed(docs)
    (leak,) = fresh(keyed, "_leak")
    found = decontaminate.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=key)
    leaks = Scratch(spark, "leaks").save(found.select(F.col("doc_id").alias(leak)).distinct())
    return keyed.join(leaks, F.col(key) == F.col(leak), "left_anti").drop(key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its rate, its number of copies (0, 1 or 2) and the words that these take: the mix as a plan. Documents
    of no copies stay in the table as such, so that clean ones are not lost, and those of two come once. Texts without words
    have one copy, of none; rows alike share their copies out. A document's own columns of the plan's names give way to it."""
    taken = [c.lower() for c in mixing.RESULT]
    own = [c for c in docs.columns if c.lower() not in taken]
    return mixing.mix(docs, keep=own).select("doc_id", *own, *mixing.RESULT[1:])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: Stages fit models and link fingerprints, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
