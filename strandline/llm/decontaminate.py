"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

Shingles are five words, weighted by how few items hold them. The similarity of a window with an item is the weight of the
item's shingles that the window holds (with their counts), as a part of the item's whole weight. A window of the length of
some items can reach the threshold only if the benchmark shingles in it weigh enough for the lightest of these items; the
other windows are put aside without loss. The rest get a fingerprint; an item within the radius agrees with it in one of the
blocks up to radius // blocks bits, and a table by block value gives these items. Candidates are then compared exactly.

The radius of 26 of 64 bits leaves a similarity of 0.8 (an expected distance of 13, deviation 3.2) four deviations.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, coded, pieces, word_count, words

SHINGLE, SIMILAR = 5, 0.8
RADIUS, BLOCKS = 26, 8
#: Words of benchmark text that one pass over the documents looks for; a longer benchmark takes more passes.
PASS_WORDS = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _word_hashes(flat: pa.Array) -> np.ndarray:
    codes, distinct = coded(flat)
    table = np.fromiter((xxhash.xxh64_intdigest(w.encode(), 7) for w in distinct.to_pylist()), np.uint64, len(distinct))
    return table[codes] if len(codes) else np.zeros(0, np.uint64)


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` words in a row, of the whole sequence of word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _P + h[k : k + n]
    return _mix(out)


def _signs(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32) * 2 - 1


class Items:
    """The items of one pass, by shingle size (five, or the whole of a shorter item).

    df and items: how many items of the whole benchmark hold a shingle, by (size, shingle as a signed long), and how many there
    are, by size; without them the rows are the whole benchmark."""

    def __init__(self, rows: list[tuple], df: dict[tuple[int, int], int] | None = None, items: dict[int, int] | None = None):
        offsets, flat = words(pa.array([t for _, t in rows], pa.string()))
        h = _word_hashes(flat)
        self.sizes: dict[int, dict] = {}
        for k, (item, _) in enumerate(rows):
            own = h[offsets[k] : offsets[k + 1]]
            if len(own):
                size = min(SHINGLE, len(own))
                self.sizes.setdefault(size, {"ids": [], "n": [], "sh": []})
                g = self.sizes[size]
                g["ids"].append(item)
                g["n"].append(len(own))
                g["sh"].append(_rolled(own, size))
        for size, g in self.sizes.items():
            held = Counter(x for s in g["sh"] for x in set(s.tolist()))
            g["all"] = np.array(sorted(held), np.uint64)
            if df is not None:
                held = dict(zip(g["all"].tolist(), (df[size, x] for x in g["all"].view(np.int64).tolist()), strict=True))
            total = len(g["ids"]) if items is None else items[size]
            g["rare"] = float(np.log1p(total))
            g["w"] = np.array([np.log1p(total / held[x]) for x in g["all"].tolist()])
            g["n"] = np.array(g["n"])
            g["count"] = [Counter(s.tolist()) for s in g["sh"]]
            of = dict(zip(g["all"].tolist(), g["w"].tolist(), strict=True))
            g["of"] = of
            g["total"] = np.array([sum(of[x] * c for x, c in m.items()) for m in g["count"]])
            g["fp"] = np.array([self._fp(_signs(s) * np.array([of[x] for x in s.tolist()], np.float32)[:, None]) for s in g["sh"]], np.uint64)
            g["need"] = {int(n): SIMILAR * g["total"][g["n"] == n].min() - 1e-9 for n in np.unique(g["n"])}
            bits = 64 // BLOCKS
            near = np.bitwise_count(np.arange(1 << bits)[:, None] ^ np.arange(1 << bits)[None, :]) <= RADIUS // BLOCKS
            value = np.stack([(g["fp"] >> np.uint64(b * bits)) & np.uint64((1 << bits) - 1) for b in range(BLOCKS)]).astype(np.int64)
            g["index"] = near[:, value].transpose(1, 0, 2)  # block, value, item
            low = np.zeros(1 << 16, bool)
            low[(g["all"] & np.uint64(0xFFFF)).astype(np.int64)] = True
            g["low"] = low
            g["size"] = size

    @staticmethod
    def _fp(m: np.ndarray) -> int:
        return int(np.packbits(m.sum(axis=0) > 0, bitorder="little").view("<u8")[0])

    def find(self, h: np.ndarray) -> dict:
        """{item: (similarity, first word)} of one document's word hashes."""
        best: dict = {}
        for g in self.sizes.values():
            sh = _rolled(h, g["size"])
            at = np.flatnonzero(g["low"][(sh & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(g["all"], sh[at]), len(g["all"]) - 1)
            true = g["all"][place] == sh[at]
            at, place = at[true], place[true]
            if not len(at):
                continue
            far = int(g["n"].max())
            for zone in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > far) + 1):  # no window spans two zones' hits
                first, last = max(0, int(at[zone[0]]) - far), min(len(sh), int(at[zone[-1]]) + far + 1)
                self._zone(g, sh[first:last], at[zone] - first, g["w"][place[zone]], first, best)
        return best

    @staticmethod
    def _zone(g: dict, sh: np.ndarray, at: np.ndarray, w: np.ndarray, first: int, best: dict) -> None:
        weight, known = np.full(len(sh), g["rare"], np.float32), np.zeros(len(sh))
        weight[at] = known[at] = w
        before = np.concatenate([[0.0], np.cumsum(known)])
        starts, ends, lengths = [], [], []
        for n, need in g["need"].items():
            if before[-1] < need:
                continue
            span = n - g["size"] + 1
            s = np.arange(max(1, len(sh) - span + 1))
            e = np.minimum(s + span, len(sh))
            ok = before[e] - before[s] >= need
            starts.append(s[ok])
            ends.append(e[ok])
            lengths.append(np.full(int(ok.sum()), n))
        if not starts or not (n_all := sum(map(len, starts))):
            return
        s, e, n = (np.concatenate(x) for x in (starts, ends, lengths))
        sums = np.concatenate([np.zeros((1, 64)), np.cumsum(_signs(sh) * weight[:, None], axis=0, dtype=np.float64)])
        bits = 64 // BLOCKS
        for k in range(0, n_all, 1_000):
            x, y, m = s[k : k + 1_000], e[k : k + 1_000], n[k : k + 1_000]
            fp = np.packbits(sums[y] - sums[x] > 1e-6, axis=1, bitorder="little").view("<u8")[:, 0]
            may = np.zeros((len(fp), len(g["fp"])), bool)
            for b in range(BLOCKS):
                may |= g["index"][b, ((fp >> np.uint64(b * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)]
            may &= (m[:, None] == g["n"][None, :]) & (np.bitwise_count(fp[:, None] ^ g["fp"][None, :]) <= RADIUS)
            for item in np.flatnonzero(may.any(axis=0)).tolist():
                own, of, total = g["count"][item], g["of"], g["total"][item]
                mine = np.array([of[v] if v in own else 0.0 for v in sh.tolist()])
                upto = np.concatenate([[0.0], np.cumsum(mine)])
                rows = np.flatnonzero(may[:, item])
                most = (upto[y[rows]] - upto[x[rows]]) / total  # exact where no shingle repeats in the window
                for r in rows[np.lexsort((x[rows], -most))].tolist():
                    bound = (upto[y[r]] - upto[x[r]]) / total
                    now = best.get(g["ids"][item], (SIMILAR - 2e-9, 0))
                    if bound <= now[0] + 1e-12 and (bound < now[0] - 1e-12 or first + int(x[r]) >= now[1]):
                        break
                    have = Counter(sh[x[r] : y[r]].tolist())
                    same = sum(of[v] * min(c, have[v]) for v, c in own.items() if v in have) / total
                    start = first + int(x[r])
                    if same >= SIMILAR - 1e-9 and (same > now[0] + 1e-12 or abs(same - now[0]) <= 1e-12 and start < now[1]):
                        best[g["ids"][item]] = (float(same), start)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pass, size, shingle): the distinct shingles of each item, and a null one for the item itself."""
    for b in pieces(batches):
        offsets, flat = words(b.column("text"))
        h = _word_hashes(flat)
        for k, part in enumerate(b.column("pass").to_pylist()):
            own = h[offsets[k] : offsets[k + 1]]
            if len(own):
                size = min(SHINGLE, len(own))
                sh = np.unique(_rolled(own, size)).view(np.int64)
                n = len(sh) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, size), pa.int32()), pa.array([*sh.tolist(), None], pa.int64())], ["pass", "size", "shingle"])


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): a row for every document and item with a window of 0.8 or more; the best
    window, the first of equal ones. Columns in `keep` come along.

    Null, empty and blank documents and items match nothing; an item under five words is one shingle. Repeated documents give
    their rows again; of repeated item ids the more similar counts. No items or no documents give no rows. A benchmark of more
    than PASS_WORDS words is looked for in passes: all rows of an item id are in one, and shingles weigh as in the whole."""
    spark = docs.sparkSession
    b = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"), word_count(item_text).alias("n"))
    passes = max(1, int(-(-(b.agg(F.sum("n")).first()[0] or 0) // PASS_WORDS)))
    b = b.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)).cast("int"))
    if passes > 1:
        scratch = Scratch(spark, "leaks")
        found = scratch.save(b.select("pass", "text").mapInArrow(_shingles, "pass int, size int, shingle long"))
        count = found.groupBy("size", "shingle").agg(F.count(F.lit(1)).alias("df"))
        weighed = scratch.save(found.where("shingle is not null").distinct().join(count, ["size", "shingle"]))
        items = {r[0]: r[1] for r in count.where("shingle is null").select("size", "df").collect()}  # at most a row a size
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *(keep or []))
    kinds = dict(d.dtypes) | {"item_id": dict(b.dtypes)["item_id"]}
    cols = ["doc_id", *(keep or [])]
    out = None
    for k in range(passes):
        rows = b.where(F.col("pass") == k).select("item_id", "text").collect()  # about PASS_WORDS words
        rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0], r[1]))
        known = (rows,)
        if passes > 1:
            df = {(r[0], r[1]): r[2] for r in weighed.where(F.col("pass") == k).select("size", "shingle", "df").collect()}  # of these words
            known = (rows, df, items)
        held = spark.sparkContext.broadcast(known)
        one = d.mapInArrow(_search(held, cols), ", ".join(f"`{c}` {kinds[c]}" for c in cols) + f", item_id {kinds['item_id']}, similarity double, first_word int")
        out = one if out is None else out.union(one)
    return out


def _search(held, cols: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*held.value)
        every = np.concatenate([g["all"] for g in items.sizes.values()]) if items.sizes else np.zeros(0, np.uint64)
        for b in pieces(batches):
            offsets, flat = words(b.column("text"))
            if not len(every) or not len(flat):
                continue
            h = _word_hashes(flat)
            # documents with any benchmark shingle; a shingle over the edge of two documents only adds one to look at
            hit = np.zeros(len(h), bool)
            for size, g in items.sizes.items():
                sh = _rolled(h, size)
                at = np.flatnonzero(g["low"][(sh & np.uint64(0xFFFF)).astype(np.int64)])
                hit[at[np.isin(sh[at], g["all"])]] = True
            docs = np.unique(np.searchsorted(offsets, np.flatnonzero(hit), "right") - 1)
            rows, ids, same, first = [], [], [], []
            for k in docs.tolist():
                for item, (s, w) in items.find(h[offsets[k] : offsets[k + 1]]).items():
                    rows.append(k)
                    ids.append(item)
                    same.append(s)
                    first.append(w)
            if rows:
                part = b.select(cols).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids), pa.array(same, pa.float64()), pa.array(first, pa.int32())], [*cols, "item_id", "similarity", "first_word"])

    return run
