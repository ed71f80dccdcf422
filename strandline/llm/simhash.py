"""SimHash near-duplicates by tables of Hamming distances to reference fingerprints.

The references are the zero fingerprint and, for every pair of neighbouring bits, the fingerprint with just these two
set. Two fingerprints that differ in at most `radius` bits have distances to any reference that differ by that at most,
and the distances to all references but those over a changed bit shift alike. The references are dealt into groups, so
that any pair within the radius agrees on all but `radius` groups, up to the shift: equal coordinates of some choice of
the other groups are the key that candidates share. A candidate is discarded if one coordinate differs by more than the
radius, and the rest are verified on the fingerprints themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, pieces

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Groups of references, with so many more for every eight times of fingerprints beyond 2 ** ENOUGH: longer keys, more of them.
GROUPS, ENOUGH = 5, 26
#: Extra references for the discard by maximum coordinate difference: fixed, dense bit patterns.
DISCARD = [(0x9E3779B97F4A7C15 * (2 * k + 1)) & (1 << 64) - 1 for k in range(8)]
#: Members up to which a key's fingerprints are compared pair by pair; larger ones go by shared neighbours, exactly.
PAIRWISE = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the XXH64 bits over the word shingles, repeats included; no words: 0."""
    doc = b" ".join((text or "").encode().lower().split())
    if not doc:
        return 0
    blanks = np.flatnonzero(np.frombuffer(doc, np.uint8) == 32)
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(doc)]])
    if len(starts) <= shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), 100_000):
        part = [digest(doc[a:b], SEED) for a, b in zip(starts[k : k + 100_000].tolist(), ends[k : k + 100_000].tolist(), strict=True)]
        ones += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row a document; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int, groups: int, scratch: Scratch) -> DataFrame:
    """(u, v): fingerprints of `distinct` (column fp) that differ in 1 to radius bits; in large keys a spanning part."""
    distance = lambda r: F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(r)))).cast("int")
    base = distance(0)
    codes = []
    for g in range(groups):  # a digit per reference: 0, 1 or 2 of its bits are set
        refs = range(32 * g // groups, 32 * (g + 1) // groups)
        code = F.lit(0).cast("long")
        for j in refs:
            code = code * 3 + F.floor((base - distance(3 << (2 * j)) + 2) / 2)
        codes.append(code)
    table = distinct.select("fp", base.alias("d0"), *[distance(r).alias(f"d{k + 1}") for k, r in enumerate(DISCARD)], *[c.alias(f"g{k}") for k, c in enumerate(codes)])
    keys = F.array(*[F.struct(F.lit(n).alias("pick"), *[(F.col(f"g{picked[k]}") if k < len(picked) else F.lit(0).cast("long")).alias(f"k{k}") for k in range(groups - radius)]) for n, picked in enumerate(combinations(range(groups), groups - radius))])
    coords = [f"d{k}" for k in range(len(DISCARD) + 1)]
    keyed = table.select("fp", *coords, F.explode(keys).alias("key")).select("fp", *coords, "key.*")
    by = ["pick", *[f"k{k}" for k in range(groups - radius)]]
    sizes = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = scratch.save(keyed.join(sizes, by))
    a, b = keyed.where(f"n <= {PAIRWISE}").alias("a"), keyed.where(f"n <= {PAIRWISE}").alias("b")
    apart = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    close = F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in coords]) <= radius
    cond = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by] + [F.col("a.fp") < F.col("b.fp"), close, apart <= radius]
    out = a.join(b, cond).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    # fingerprints within two bits share one that is a bit from each; at most 65 can share it
    dense = keyed.where(f"n > {PAIRWISE}").select("fp").distinct()
    if radius > 2:
        wide = keyed.where(f"n > {PAIRWISE}")
        a, b = wide.alias("a"), wide.alias("b")
        more = a.join(b, cond).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    else:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)) for k in range(64)])
        near = dense.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
        least = near.groupBy("mid").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
        more = least.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v")
        if radius < 2:
            more = more.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    return out.union(more).distinct()


def groups_for(fingerprints: int) -> int:
    """Groups that keep the fingerprints sharing a key few; the links are the same for any number."""
    return GROUPS + max(0, -(-(max(1, fingerprints).bit_length() - ENOUGH) // 3))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, groups: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id): one row a document; component_id is the smallest doc_id reachable by links of at most
    `radius` differing bits.

    Null, empty and blank texts have fingerprint 0 and link like any other; long texts are read whole. Rows that repeat are rows of one component.
    Rows whose doc_id is null are fingerprinted and linked; component_id is null only if no other row is reachable.
    Other columns are not read. An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, doc_id, text))
    first = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(first.select("fp"), radius, groups or groups_for(first.count()), scratch), scratch)
    placed = first.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = scratch.save(placed)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
