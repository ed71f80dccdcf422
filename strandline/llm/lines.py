"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

A suffix starts at a line. Its rank at level k is the place of its first 2 ** k lines in the sorted order of all such
sequences; level 0 is the place of the line itself, and level k + 1 the place of the pair (rank here, rank 2 ** k lines on),
found by a range-partitioned sort of the distinct pairs. Suffixes of one rank are an LCP interval of 2 ** k lines; the
interval of any other length m has the pair of ranks at the ends of its m lines as its name. A repeated run counts from
`min_words` words on, so only runs of the fewest lines that have them, from or up to each line, need a name: together they
cover every maximal repeated run. Of the runs of one name the first in the corpus stays, and the lines of the others go.

Lines that occur once end every run, and documents without `min_words` words of repeated lines in a row leave at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, coded, dense_ids, fresh, pieces

MIN_WORDS = 50
DOC = ["doc_id", "sha"]  # rows of one id and text are one document


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line: its document, place, 128-bit name and words."""
    for b in pieces(batches):
        lists = pc.split_pattern(pc.fill_null(b.column("text"), ""), "\n")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        codes, distinct = coded(lists.flatten())
        names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode()) for x in distinct.to_pylist()), np.int64).reshape(-1, 2)
        split = pc.ascii_split_whitespace(distinct)
        full = np.concatenate([[0], np.cumsum(pc.not_equal(pc.binary_length(split.flatten()), 0).to_numpy(zero_copy_only=False))])
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        n_words = (full[at[1:]] - full[at[:-1]]).astype(np.int32)
        count = np.diff(offsets)
        of = np.repeat(np.arange(b.num_rows), count)
        place = (np.arange(len(codes)) - np.repeat(offsets[:-1] - offsets[0], count)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of)), b.column("sha").take(pa.array(of)), pa.array(place), pa.array(names[codes, 0]), pa.array(names[codes, 1]), pa.array(n_words[codes])], ["doc_id", "sha", "place", "a", "b", "n"])


def shortest_runs(place: np.ndarray, n: np.ndarray, new: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last): the runs of consecutive lines with min_words words that end, or start, as near as they can, by row.

    `new` marks the rows that start a document; lines that are not consecutive part runs too."""
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = new.copy()
    cut[1:] |= np.diff(place) != 1
    segment = np.cumsum(cut) - 1
    upto = np.concatenate([[0], np.cumsum(n.astype(np.int64))])
    rows = np.arange(len(n))
    end = np.searchsorted(upto, upto[:-1] + min_words, "left") - 1  # row at which min_words are reached, from each row
    start = np.searchsorted(upto, upto[1:] - min_words, "right") - 1  # and the last row from which they are, up to each
    ok_f = end < len(n)
    ok_f[ok_f] &= segment[end[ok_f]] == segment[rows[ok_f]]
    ok_b = start >= 0
    ok_b[ok_b] &= segment[start[ok_b]] == segment[rows[ok_b]]
    runs = np.unique(np.concatenate([rows[ok_f] * (len(n) + 1) + end[ok_f], start[ok_b] * (len(n) + 1) + rows[ok_b]]))
    return runs // (len(n) + 1), runs % (len(n) + 1)


def _by_line(b: pa.RecordBatch, fields: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    lists = b.column("lines")
    flat = lists.flatten()
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(b.num_rows), count)
    new = np.zeros(len(of), bool)
    new[(np.cumsum(count) - count)[count > 0]] = True
    return of, {f: flat.field(f).fill_null(-1).to_numpy(zero_copy_only=False) for f in fields}, new


def _relevant(min_words: int):
    """Keeps the lines that some run of min_words covers; `most` is the longest run of the document, in lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, v, new = _by_line(b, ["place", "a", "b", "n"])
            first, last = shortest_runs(v["place"], v["n"], new, min_words)
            cover = np.zeros(len(of) + 1, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, last + 1, -1)
            kept = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            longest = np.zeros(b.num_rows, np.int32)
            np.maximum.at(longest, of[first], (last - first + 1).astype(np.int32))
            docs = pa.array(of[kept])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(docs), b.column("sha").take(docs), *[pa.array(v[f][kept]) for f in ("place", "a", "b", "n")], pa.array(longest[of[kept]])], ["doc_id", "sha", "place", "a", "b", "n", "most"])

    return run


def _named_runs(min_words: int, levels: int):
    """A row for each shortest run all of whose lines repeat: its length and the ranks at its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, v, new = _by_line(b, ["place", "n", *[f"r{k}" for k in range(levels)]])
            first, last = shortest_runs(v["place"], v["n"], new, min_words)
            m = last - first + 1
            k = np.minimum(np.floor(np.log2(np.maximum(m, 1))).astype(np.int64), levels - 1)
            ranks = np.stack([v[f"r{j}"] for j in range(levels)]) if len(of) else np.zeros((levels, 0), np.int64)
            ra, rb = ranks[k, first], ranks[k, np.maximum(last + 1 - (1 << k), 0)]
            ok = np.flatnonzero((ra >= 0) & (rb >= 0))
            docs = pa.array(of[first[ok]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(docs), b.column("sha").take(docs), pa.array(v["place"][first[ok]].astype(np.int32)), pa.array(m[ok].astype(np.int32)), pa.array(ra[ok].astype(np.int64)), pa.array(rb[ok].astype(np.int64))], ["doc_id", "sha", "place", "m", "ra", "rb"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for spans in b.column("spans").to_pylist():
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in spans):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            out.append([{"start": s, "end": e} for s, e in merged])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sha"), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "sha", "spans"])


def later_copies(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, sha, spans): the lines [start, end) to delete, of the documents that lose any. docs: doc_id, text."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", F.xxhash64("text").alias("sha"), "text")
    lines = scratch.save(keyed.mapInArrow(_lines, f"doc_id {kind}, sha long, place int, a long, b long, n int"))
    # what lines and runs are counted to is written before it is joined, so that a very frequent one's join can be dealt anew
    twice = scratch.save(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"))
    again = lines.join(twice, ["a", "b"], "left_semi")
    grouped = again.groupBy(*DOC).agg(F.sum("n").alias("words"), F.array_sort(F.collect_set(F.struct("place", "a", "b", "n"))).alias("lines")).where(F.col("words") >= min_words)
    held = scratch.save(grouped.select(*DOC, "lines").mapInArrow(_relevant(min_words), f"doc_id {kind}, sha long, place int, a long, b long, n int, most int"))
    longest = held.agg(F.max("most")).first()[0] or 1
    levels = int(longest).bit_length()
    ids = dense_ids(held.select("a", "b").distinct(), ["a", "b"], "r0", scratch)
    ranked = scratch.save(held.join(ids, ["a", "b"]).select(*DOC, "place", "n", "r0"))
    scratch.drop(lines, twice, held)
    for k in range(levels - 1):
        along = Window.partitionBy(*DOC).orderBy("place")
        far = 1 << k
        next_rank = F.when(F.lead("place", far).over(along) == F.col("place") + far, F.lead(f"r{k}", far).over(along))
        paired = ranked.withColumn("next", next_rank)
        pairs = paired.where(f"r{k} is not null and next is not null").groupBy(f"r{k}", "next").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
        place = dense_ids(pairs, [f"r{k}", "next"], f"r{k + 1}", scratch)
        new = scratch.save(paired.join(place, [f"r{k}", "next"], "left").select(*DOC, "place", "n", *[f"r{j}" for j in range(k + 2)]))
        scratch.drop(ranked)
        ranked = new
    fields = F.struct("place", "n", *[f"r{j}" for j in range(levels)])
    runs = ranked.groupBy(*DOC).agg(F.array_sort(F.collect_list(fields)).alias("lines"))
    runs = scratch.save(runs.mapInArrow(_named_runs(min_words, levels), f"doc_id {kind}, sha long, place int, m int, ra long, rb long"))
    scratch.drop(ranked)
    name = ["m", "ra", "rb"]
    first = runs.groupBy(*name).agg(F.min(F.struct("doc_id", "sha", "place")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    first = scratch.save(first)
    copies = runs.join(first, name).where(~F.col("first").eqNullSafe(F.struct("doc_id", "sha", "place")))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sha") == F.col("first.sha"))
    start = F.when(own, F.greatest("place", F.col("first.place") + F.col("m"))).otherwise(F.col("place"))
    spans = copies.select(*DOC, F.struct(start.alias("start"), (F.col("place") + F.col("m")).alias("end")).alias("span"))
    return spans.groupBy(*DOC).agg(F.collect_set("span").alias("spans")).mapInArrow(_merged, f"doc_id {kind}, sha long, spans array<struct<start:int,end:int>>")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs`, all columns, with the later copies of repeated line runs of min_words words deleted from the text, and
    two columns more: lines_before and lines_removed.

    A copy is later if its document has the larger doc_id (null first; then the hash of the text), or stands further down in
    one document; where copies overlap, the lines of the first stay. Rows of one id and text are one document, and
    treated alike. Null, empty and short texts come back as they are, long ones are read whole; a text all of whose lines go
    becomes empty. A column of `docs` named lines_before or lines_removed is replaced; all others stay."""
    scratch = Scratch(docs.sparkSession, "lines")
    base = docs.drop("lines_before", "lines_removed")
    spans = scratch.save(later_copies(base.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), scratch, min_words))
    # one plan at every size: the spans grow with the corpus, so they are never broadcast
    of, sha, cut, own = fresh(base, "_doc", "_sha_of", "_spans", "_sha")
    s = spans.select(F.col("doc_id").alias(of), F.col("sha").alias(sha), F.col("spans").alias(cut)).hint("merge")
    d = base.withColumn(own, F.xxhash64(F.col(text).cast("string")))
    d = d.join(s, F.col(doc_id).eqNullSafe(F.col(of)) & (F.col(own) == F.col(sha)), "left")
    split = F.split(F.col(text), "\n", -1)
    kept = F.filter(split, lambda line, i: ~F.exists(cut, lambda r: (i >= r["start"]) & (i < r["end"])))
    gone = F.aggregate(cut, F.lit(0), lambda acc, r: acc + r["end"] - r["start"])
    touched = F.col(cut).isNotNull()
    d = d.withColumn("lines_before", F.when(F.col(text).isNull(), 0).otherwise(F.size(split)))
    d = d.withColumn("lines_removed", F.when(touched, gone).otherwise(0)).withColumn(text, F.when(touched, F.array_join(kept, "\n")).otherwise(F.col(text)))
    return d.drop(of, sha, cut, own)
