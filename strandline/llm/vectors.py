"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors of one label and dimension are ordered by the nearest of some pivots and cut into tiles, and tiles in a row make a slab. For
a pair of slabs, and then of tiles, whose caps (centre and angular radius) may come within the threshold, the int8 codes are
multiplied; with a = s q + e, the product of two vectors differs from that of their codes by |s q| |e'| + |s' q'| |e| + |e| |e'|
at most, each norm measured. Only pairs that may reach the threshold by this bound are multiplied in double precision.

A tile is sent once to each pair of slabs that its own is part of, not to each pair of tiles; a task holds two slabs. It
gives a count of links for each vector and a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components

THRESHOLD = 0.93
#: Vectors of a tile at most, bytes of it at most, tiles of a slab, and vectors multiplied with a tile at once.
TILE, TILE_BYTES, SLAB, STRIP = 2048, 1 << 20, 16, 512
#: Pivots that order the vectors: so many rows, the first by a hash; fixed directions for other dimensions. They only shape the
#: tiles, not the links.
PIVOTS = 64


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of the coded vector, norm of the error), per row; the norms are rounded up."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = q * scale[:, None]
    norm = lambda m: np.sqrt(np.einsum("ij,ij->i", m, m)) * (1 + 1e-12) + 1e-15
    return q, scale, norm(coded), norm(unit - coded)


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) with cosine >= threshold, strip by strip; for one tile with itself, i < j."""
    qa, sa, na, ea = quantised(a)
    qb, sb, nb, eb = (qa, sa, na, ea) if same else quantised(b)
    fb = qb.astype(np.float32)
    for k in range(0, len(a), STRIP):
        rows = slice(k, min(len(a), k + STRIP))
        dots = np.zeros((rows.stop - rows.start, len(b)))
        for d in range(0, a.shape[1], 1024):  # integers under 2 ** 24 are exact in single precision
            dots += qa[rows, d : d + 1024].astype(np.float32) @ fb[:, d : d + 1024].T
        upper = dots * sa[rows, None] * sb[None, :] + na[rows, None] * eb[None, :] + ea[rows, None] * (nb + eb)[None, :]
        i, j = np.nonzero(upper >= threshold - 1e-9)
        i = i + k
        if same:
            i, j = i[i < j], j[i < j]
        for p in range(0, len(i), 200_000):
            x, y = i[p : p + 200_000], j[p : p + 200_000]
            near = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            yield x[near], y[near]


def _matrices(b: pa.RecordBatch, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the batch's vectors by dimension."""
    lists = b.column("embedding")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    dim = b.column("dim").to_numpy(zero_copy_only=False)
    end = np.cumsum(dim)
    for d in np.unique(dim).tolist():
        rows = np.flatnonzero(dim == d)
        yield rows, flat[(end[rows] - d)[:, None] + np.arange(d)]


def _placed(by_dim: dict[int, np.ndarray], kind: str):
    """Adds the nearest pivot of each vector and its cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for rows, m in _matrices(b, kind):
                d = m.shape[1]
                pivots = by_dim[d] if d in by_dim else _unit(np.random.default_rng(d).normal(size=(PIVOTS, d)))
                for k in range(0, len(rows), TILE):
                    dots = _unit(m[k : k + TILE]) @ pivots.T
                    near[rows[k : k + TILE]], far[rows[k : k + TILE]] = dots.argmax(axis=1), dots.max(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(far)], [*b.schema.names, "near", "far"])

    return run


_TILES = "slab long, label string, dim int, n int, cls binary, times binary, data binary, centre array<double>, radius double"


def _tiles(kind: str):
    """Tiles of rows in order of label, dimension and place; `slab` numbers the slabs of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, slab, held, key = 0, TaskContext.get().partitionId() << 32, [], None

        def tile(cls: np.ndarray, times: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            unit = _unit(rows)
            centre = unit.mean(axis=0)
            centre = centre / max(np.linalg.norm(centre), 1e-30)
            radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) + 1e-6
            return pa.RecordBatch.from_pylist([{"slab": slab, "label": key[0], "dim": key[1], "n": len(cls), "cls": cls.tobytes(), "times": times.tobytes(), "data": rows.tobytes(), "centre": centre.tolist(), "radius": radius}], schema)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """The held rows in tiles; those of a last tile that is not full stay held unless `last`."""
            nonlocal made, slab, held
            if last and made and not held:
                made, slab = 0, slab + 1
            if not held:
                return
            cls, times, rows = (np.concatenate([h[k] for h in held]) for k in range(3))
            most = max(64, min(TILE, TILE_BYTES // max(1, rows.shape[1] * rows.itemsize)))
            upto = len(cls) if last else len(cls) // most * most
            for k in range(0, upto, most):
                yield tile(cls[k : min(upto, k + most)], times[k : min(upto, k + most)], rows[k : min(upto, k + most)])
                made += 1
                if made == SLAB:
                    made, slab = 0, slab + 1
            held = [(cls[upto:], times[upto:], rows[upto:])] if upto < len(cls) else []
            if last and made:
                made, slab = 0, slab + 1

        for b in batches:
            label, dim = b.column("label").dictionary_encode(), b.column("dim").to_numpy(zero_copy_only=False)
            code = label.indices.to_numpy(zero_copy_only=False)
            cls, times = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cls", "times"))
            flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
            at = np.concatenate([[0], np.cumsum(dim)])
            cuts = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(dim) != 0)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for x, y in zip(cuts, cuts[1:], strict=False):
                now = (label.dictionary[int(code[x])].as_py(), int(dim[x]))
                if now != key:
                    yield from flush(True)
                    key = now
                held.append((cls[x:y], times[x:y], flat[at[x] : at[y]].reshape(y - x, now[1])))
                yield from flush(False)
        yield from flush(True)

    schema = pa.schema([("slab", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("n", pa.int32()), ("cls", pa.binary()), ("times", pa.binary()), ("data", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())])
    return run


def _hooked(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least label of each tree after joining i to j, by hooking and shortening."""
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for x in (i, j):
            np.minimum.at(new, x, low)
            np.minimum.at(new, root[x], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _slab_pair(kind: str, threshold: float):
    """Links of one pair of slabs: (cls, links, root) of all vectors with any."""

    def run(t: pa.Table) -> pa.Table:
        first, cols = t.column("first").to_pylist(), {c: t.column(c).to_pylist() for c in ("slab", "dim", "cls", "times", "data", "centre", "radius")}
        order = sorted(range(t.num_rows), key=lambda k: (cols["slab"][k], cols["cls"][k]))  # one order, whatever the shuffle
        cls = [np.frombuffer(cols["cls"][k], np.int64) for k in order]
        times = [np.frombuffer(cols["times"][k], np.int64) for k in order]
        unit = [_unit(np.frombuffer(cols["data"][k], kind).reshape(-1, cols["dim"][k])) for k in order]
        start = np.concatenate([[0], np.cumsum([len(c) for c in cls])])
        every, weight = np.concatenate(cls), np.concatenate(times)
        count, root = np.zeros(len(every), np.int64), np.arange(len(every))
        own = [cols["slab"][k] == first[k] for k in order]  # of the pair's first slab
        single = all(own)
        reach = float(np.arccos(threshold)) + 1e-6
        for x in range(len(order)):
            for y in range(x, len(order)):
                if not single and own[x] == own[y]:
                    continue  # two tiles of one slab meet in its pair with itself
                a, b = order[x], order[y]
                angle = np.arccos(np.clip(np.dot(cols["centre"][a], cols["centre"][b]), -1, 1))
                if x != y and angle > cols["radius"][a] + cols["radius"][b] + reach:
                    continue
                for i, j in tile_links(unit[x], unit[y], x == y, threshold):
                    i, j = i + start[x], j + start[y]
                    np.add.at(count, i, weight[j])
                    np.add.at(count, j, weight[i])
                    root = _hooked(root, i, j)
        hit = np.flatnonzero(count)
        return pa.table({"cls": pa.array(every[hit]), "links": pa.array(count[hit]), "root": pa.array(every[root[hit]])})

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for every row of `vectors`.

    Vectors are compared where labels are equal and not null and dimensions agree. Null, empty and zero vectors and those
    with a null, NaN or infinite component link with nothing: 0 links, a component of their own. Equal vectors are one class
    that links with itself; n_links counts all other vectors, copies and repeated rows included. component_id is the
    smallest vec_id reachable. Repeated rows and equal vec_ids come out as often as they are there; a null vec_id is its own
    component's only where no other is reachable. Vectors of any length are read whole. Other columns are not read. An empty
    table gives no rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = "float64" if "double" in dict(vectors.dtypes)[embedding] else "float32"
    fine = f"forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0) and size(v) > 0 and label is not null"
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"), F.col(label).cast("string").alias("label"))
    rows = rows.withColumn("valid", F.coalesce(F.expr(fine), F.lit(False)))
    classes = rows.where("valid").groupBy("label", F.col("v").alias("embedding")).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("times"))
    classes = scratch.save(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    picked = [np.array(r[0]) for r in classes.orderBy(F.xxhash64("embedding"), "cls").limit(PIVOTS).select("embedding").collect()]
    by_dim: dict[int, np.ndarray] = {d: _unit(np.array([p for p in picked if len(p) == d])) for d in {len(p) for p in picked}}
    ordered = classes.mapInArrow(_placed(by_dim, kind), T.StructType([*classes.schema.fields, T.StructField("near", T.IntegerType()), T.StructField("far", T.DoubleType())]))
    place = ["label", "dim", "near", "far", "cls"]
    n = max(1, classes.count() // (SLAB * TILE))
    tiles = scratch.save(ordered.repartitionByRange(n, *place).sortWithinPartitions(*place).mapInArrow(_tiles(kind), _TILES))
    # a slab's cap: around the middle of its tiles' centres, as wide as the farthest of them
    dot = lambda x, y: F.expr(f"acos(greatest(-1d, least(1d, aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0d, (s, p) -> s + p))))")
    caps = tiles.groupBy("slab", "label", "dim").agg(F.collect_list(F.struct("centre", "radius")).alias("caps"))  # SLAB tiles at most
    middle = "aggregate(caps, array_repeat(0d, dim), (s, x) -> zip_with(s, x.centre, (p, q) -> p + q))"
    caps = caps.withColumn("sum", F.expr(middle)).withColumn("norm", F.expr("greatest(1e-30d, sqrt(aggregate(sum, 0d, (s, p) -> s + p * p)))"))
    caps = caps.withColumn("middle", F.expr("transform(sum, p -> p / norm)"))
    wide = "array_max(transform(caps, x -> x.radius + acos(greatest(-1d, least(1d, aggregate(zip_with(x.centre, middle, (p, q) -> p * q), 0d, (s, p) -> s + p))))))"
    per = Window.partitionBy("label", "dim")  # a row a slab
    caps = scratch.save(caps.select("slab", "label", "dim", "middle", (F.expr(wide) + 1e-6).alias("wide"), (F.row_number().over(per.orderBy("slab")) - 1).alias("k"), F.count(F.lit(1)).over(per).alias("of")))
    # every pair of slabs of one label and dimension, found from its first one's number, then by the second's
    a = caps.select(F.col("slab").alias("first"), "label", "dim", F.col("middle").alias("m1"), F.col("wide").alias("w1"), F.explode(F.expr("sequence(k, of - 1)")).alias("k")).repartition("label", "dim", "k")
    b = caps.select(F.col("slab").alias("second"), F.col("label").alias("l2"), F.col("dim").alias("d2"), F.col("middle").alias("m2"), F.col("wide").alias("w2"), F.col("k").alias("k2"))
    pairs = a.join(b, (F.col("label") == F.col("l2")) & (F.col("dim") == F.col("d2")) & (F.col("k") == F.col("k2")))
    may = (F.col("first") == F.col("second")) | (dot("m1", "m2") <= F.col("w1") + F.col("w2") + F.lit(float(np.arccos(threshold)) + 1e-6))
    pairs = scratch.save(pairs.where(may).select("first", "second"))
    sides = pairs.withColumn("slab", F.explode(F.array_distinct(F.array("first", "second"))))
    work = tiles.select("slab", "dim", "cls", "times", "data", "centre", "radius").join(sides, "slab")
    found = scratch.save(work.groupBy("first", "second").applyInArrow(_slab_pair(kind, threshold), "cls long, links long, root long"))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.where("cls <> root").select(F.col("cls").alias("u"), F.col("root").alias("v")), scratch)
    known = classes.select("cls", "label", "embedding", "first", "times").join(counts, "cls", "left").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    known = scratch.save(known.withColumn("root", F.coalesce("root", "cls")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("times") - 1))
    least = known.groupBy("root").agg(F.min("first").alias("component"))
    known = known.join(least, "root").select(F.xxhash64("label", "embedding").alias("h"), F.col("label").alias("l"), "embedding", "links", "component")
    scratch.drop(tiles, caps, pairs)
    out = rows.withColumn("h", F.when(F.col("valid"), F.xxhash64("label", "v"))).alias("r").join(known.alias("k"), (F.col("r.h") == F.col("k.h")) & (F.col("r.label") == F.col("k.l")) & (F.col("r.v") == F.col("k.embedding")), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
