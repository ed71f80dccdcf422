"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

Kernel. A string's features are its two- and three-character subsequences that span at most five characters, weighted by
DECAY to the power of their span and hashed to DIM places; the kernel is their product, divided by a function of either
string's length. A character put into an insult, or a gap, keeps most of its subsequences.

Instances. A sentence is read as its words, its words without inner punctuation, and its runs of spelled-out letters; a
document is a bag of them that takes the score of its worst one. Labels are those of documents: every toxic training
document names one witness, its instance that toxic documents hold in the greatest excess, and the witnesses are the positive
instances, with altered forms of each; the negative ones are drawn from clean documents, and after a first fit the clean
instances nearest to the boundary are added. Copies of a text count once here.

Fit. Landmarks among both kinds give the Nystroem map; a squared-hinge machine is fitted in it on the driver, from bounded
sets of instances. Map and weights fold into one table of DIM weights, so a string is scored by its subsequences alone.
A logistic curve on the bags' scores gives the probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, coded, pieces, words

DECAY, DIM = 0.75, 1 << 16
#: Offsets of a subsequence's second (and third) character.
SPANS = [(1,), (2,), (3,), (1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
#: Strings in one block of the fit and of scoring, which takes some hundred bytes for each character.
BLOCK = 2_048
#: Bytes of text that a worker holds at once; its arrays and strings take some forty times as much.
TEXT = 3_000_000
#: Longer strings are read in overlapping parts of this length.
LONG = 24
#: Bounds of the fit: labelled documents (the first by a hash of doc_id), positive, negative and added instances, landmarks.
MAX_DOCS, MAX_POSITIVE, MAX_NEGATIVE, MAX_HARD, LANDMARKS = 20_000, 3_000, 30_000, 10_000, 256
_CODE = np.array([(b * 37 + 11) % 64 for b in range(256)], np.int64)  # letters and digits take different places
_CODE[ord("^")], _CODE[ord("$")] = 62, 63


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _features(strings: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of subsequence: (place in DIM, string number, weight)."""
    data = b"".join(b"^" + s + b"$" for s in strings)
    size = np.array([len(s) + 2 for s in strings], np.int64)
    of = np.repeat(np.arange(len(strings)), size)
    code = _CODE[np.frombuffer(data, np.uint8)]
    scale = 1.0 / np.sqrt(size)
    for span in SPANS:
        far = span[-1]
        if far >= len(code):
            continue
        n = len(code) - far
        place = code[:n]
        for d in span:
            place = place * 64 + code[d : d + n]
        place = (place * 2654435761 + len(span) * 40503) >> 7 & (DIM - 1)
        inside = np.flatnonzero(of[:n] == of[far:])
        yield place[inside], of[inside], scale[of[inside]] * DECAY ** (far + 1)


def kernel(strings: list[bytes], table: np.ndarray) -> np.ndarray:
    """Products of the strings' features with the columns of `table` (DIM, or DIM x m)."""
    out = np.zeros((len(strings), *table.shape[1:]))
    for place, of, weight in _features(strings):
        if table.ndim == 1:
            out += np.bincount(of, table[place] * weight, len(strings))
        else:
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
            for p in range(0, len(starts), 200):
                a = starts[p]
                b = starts[p + 200] if p + 200 < len(starts) else len(of)
                out[of[starts[p : p + 200]]] += np.add.reduceat(table[place[a:b]] * weight[a:b, None], starts[p : p + 200] - a)
    return out


def _columns(strings: list[bytes]) -> np.ndarray:
    out = np.zeros((DIM, len(strings)), np.float32)
    for place, of, weight in _features(strings):
        np.add.at(out, (place, of), weight.astype(np.float32))
    return out


_EDGE = re.compile(rb"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$")
_INNER = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def parts(word: bytes) -> list[bytes]:
    """The strings by which a lower-cased word is judged."""
    bare = _EDGE.sub(b"", word)
    out = [bare, _INNER.sub(b"", bare)] if _INNER.search(bare) else [bare]
    cut: list[bytes] = []
    for s in out:
        cut += [s] if len(s) <= LONG else [s[k : k + LONG] for k in range(0, len(s) - LONG // 2, LONG // 2)]
    return [s for s in cut if len(s) > 2]


def _bags(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(document, string number) pairs without repeats, by document, and the distinct strings of a piece."""
    offsets, flat = words(text)
    codes, distinct = coded(flat)
    raw = [w.encode() for w in distinct.to_pylist()]
    number: dict[bytes, int] = {}
    of_word = [[number.setdefault(s, len(number)) for s in parts(w)] for w in raw]
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pair = np.unique(docs * max(1, len(distinct)) + codes)
    doc, word = pair // max(1, len(distinct)), pair % max(1, len(distinct))
    count = np.array([len(x) for x in of_word], np.int64)
    start = np.concatenate([[0], np.cumsum(count)])
    flat_of = np.array([x for own in of_word for x in own], np.int64)
    n = count[word] if len(word) else np.zeros(0, np.int64)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[word], n) if len(word) else np.zeros(0, np.int64)
    doc, unit = np.repeat(doc, n), flat_of[at] if len(at) else at
    # letters spelled out one by one
    letter = np.array([len(_EDGE.sub(b"", w).decode(errors="ignore")) == 1 for w in raw], bool)
    if letter.any():
        single = letter[codes]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        more_d, more_u = [], []
        bound = set(offsets.tolist())
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < 4:
                continue
            cuts = [a, *[k for k in range(a + 1, b) if k in bound], b]
            for x, y in zip(cuts, cuts[1:], strict=False):
                run = b"".join(_EDGE.sub(b"", raw[c]) for c in codes[x:y].tolist())
                if y - x >= 4:
                    d = int(np.searchsorted(offsets, x, "right") - 1)
                    for s in {run[k : k + LONG] for k in range(0, max(1, len(run) - LONG // 2), LONG // 2)}:
                        more_d.append(d)
                        more_u.append(number.setdefault(s, len(number)))
        if more_d:
            doc, unit = np.concatenate([doc, more_d]), np.concatenate([unit, more_u])
            order = np.argsort(doc, kind="stable")
            doc, unit = doc[order], unit[order]
    return doc, unit, list(number)


@dataclass
class Machine:
    table: np.ndarray  # DIM weights
    bias: float
    slope: float = 1.0
    at: float = 0.0

    def strings(self, s: list[bytes]) -> np.ndarray:
        out = np.zeros(len(s))
        for k in range(0, len(s), BLOCK):
            out[k : k + BLOCK] = kernel(s[k : k + BLOCK], self.table) + self.bias
        return out

    def bags(self, text: pa.Array) -> np.ndarray:
        """The worst string's score of every document; no string: that of none."""
        doc, unit, strings = _bags(text)
        out = np.full(len(text), min(self.bias, -1.0))
        if len(doc):
            np.maximum.at(out, doc, self.strings(strings)[unit])
        return out

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * worst + self.at, -40, 40)))


def altered(s: bytes) -> list[bytes]:
    """Forms of an insult with a character put in, doubled, or left out in between."""
    mid, third = len(s) // 2, max(1, len(s) // 3)
    return [s[:mid] + b"x" + s[mid:], s[:third] + b"." + s[third:], s[:mid] + s[mid : mid + 1] + s[mid:], s[:third] + b"-" + s[third : 2 * third] + b"-" + s[2 * third :]]


def fit_machine(positive: list[bytes], negative: list[bytes], landmarks: list[bytes]) -> Machine:
    cols = _columns(landmarks)
    k_mm = kernel(landmarks, cols)
    value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = value > value.max() * 1e-6
    white = vector[:, good] / np.sqrt(value[good])
    # rows are held in single precision and worked on block by block, to bound the driver's memory
    strings, m = positive + negative, int(good.sum())
    x = np.ones((len(strings), m + 1), np.float32)
    for k in range(0, len(strings), BLOCK):
        x[k : k + BLOCK, :m] = kernel(strings[k : k + BLOCK], cols) @ white
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    c = np.where(y > 0, 0.5 / len(positive), 0.5 / max(1, len(negative)))
    w, ridge = np.zeros(m + 1), 1e-5 * np.append(np.ones(m), 1e-3)

    def margins(w: np.ndarray) -> np.ndarray:
        return np.concatenate([x[k : k + BLOCK].astype(np.float64) @ w for k in range(0, len(x), BLOCK)])

    def loss(w: np.ndarray) -> float:
        return float((ridge * w * w).sum() + (c * np.maximum(0, 1 - y * margins(w)) ** 2).sum())

    for _ in range(40):  # Newton steps on the squared hinge
        f = margins(w)
        active = y * f < 1
        grad, hess = 2 * ridge * w, 2 * np.diag(ridge)
        for k in range(0, len(x), BLOCK):
            on = np.flatnonzero(active[k : k + BLOCK]) + k
            z = x[on].astype(np.float64)
            grad -= 2 * (c[on] * (y - f)[on]) @ z
            hess += 2 * (z.T * c[on]) @ z
        step, t, now = np.linalg.solve(hess, grad), 1.0, loss(w)
        while t > 1e-4 and loss(w - t * step) > now:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-7:
            break
    return Machine((cols @ (white @ w[:-1]).astype(np.float32)).astype(np.float64), float(w[-1]))


def _spread(strings: list[bytes], n: int) -> list[bytes]:
    """n strings, each the least like those before it."""
    if len(strings) <= n:
        return strings
    chosen, like = [strings[0]], np.full(len(strings), -np.inf)
    for _ in range(n - 1):
        like = np.maximum(like, kernel(strings, _columns(chosen[-1:])[:, 0]))
        chosen.append(strings[int(np.argmin(like))])
    return list(dict.fromkeys(chosen))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, most=TEXT):
        doc, unit, strings = _bags(b.column("text"))
        if not len(doc):
            continue
        pair = np.unique(doc * len(strings) + unit)
        toxic = np.asarray(b.column("toxic").to_pylist(), np.int64)[pair // len(strings)]
        pos = np.bincount(pair % len(strings), toxic, len(strings)).astype(np.int64)
        every = np.bincount(pair % len(strings), minlength=len(strings))
        yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), pa.array(pos), pa.array((every - pos).astype(np.int64))], ["unit", "pos", "neg"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, most=TEXT):
        doc, unit, strings = _bags(b.column("text"))
        if len(doc):
            yield pa.RecordBatch.from_arrays([b.column("bag").take(pa.array(doc)), pa.array(strings, pa.binary()).take(pa.array(unit))], ["bag", "unit"])


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_docs: int = MAX_DOCS) -> Machine | None:
    """docs: doc_id, text; labels: doc_id, toxic. None if the training rows hold no instance of either kind."""
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)  # so many rows at most
    bags = docs.where(~held_out(F.col("doc_id"))).join(F.broadcast(known), "doc_id").withColumn("bag", F.xxhash64("text"))
    bags = scratch.save(bags.groupBy("bag").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")))
    total = bags.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n_pos, n = int(total[0] or 0), int(total[1])
    if not 0 < n_pos < n:
        return None
    rate = n_pos / n
    units = scratch.save(bags.mapInArrow(_units, "unit binary, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    seen = F.col("pos") + F.col("neg")
    excess = (F.col("pos") - seen * rate) / F.sqrt(seen * rate * (1 - rate))
    telling = units.where((F.col("pos") >= 3) & (F.col("pos") > 2 * F.col("neg")) & (excess > 4)).withColumn("excess", excess)
    pairs = bags.where("toxic = 1").select("bag", "text").mapInArrow(_members, "bag long, unit binary")
    witness = pairs.join(telling, "unit").groupBy("bag").agg(F.max(F.struct("excess", "unit")).alias("w")).groupBy("w.unit").agg(F.count(F.lit(1)).alias("bags"))
    found = witness.orderBy(F.desc("bags"), "unit").limit(MAX_POSITIVE).collect()
    positive = [bytes(r[0]) for r in found]
    if not positive:
        return None
    clean = units.where((F.col("neg") > 0) & ~((F.col("pos") > F.col("neg")) & (excess > 2)))
    drawn = [bytes(r[0]) for r in clean.orderBy(F.xxhash64("unit"), "unit").limit(MAX_NEGATIVE).select("unit").collect()]
    shown = positive + [a for s in positive[:500] for a in altered(s)]
    marks = list(dict.fromkeys(_spread(positive[:1500], LANDMARKS // 2) + drawn[: LANDMARKS // 2]))
    first = fit_machine(shown, drawn, marks)
    held = spark.sparkContext.broadcast(first)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("unit"), pa.array(held.value.strings([bytes(u) for u in b.column("unit").to_pylist()]))], ["unit", "f"])

    hard = [bytes(r[0]) for r in clean.select("unit").mapInArrow(near, "unit binary, f double").where("f > -0.8").orderBy(F.desc("f"), "unit").limit(MAX_HARD).collect()]
    negative = list(dict.fromkeys(drawn + hard))
    marks = list(dict.fromkeys(marks + _spread(hard[:1500], LANDMARKS // 4)))
    machine = fit_machine(shown, negative, marks)
    held = spark.sparkContext.broadcast(machine)

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, most=TEXT):
            yield pa.RecordBatch.from_arrays([pa.array(held.value.bags(b.column("text"))), b.column("toxic")], ["f", "toxic"])

    rows = bags.mapInArrow(worst, "f double, toxic int").collect()  # max_docs numbers, or copies of these documents
    f, t = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    goal = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    theta = np.array([2.0, 0.0])
    x = np.stack([f, np.ones_like(f)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        hess = (x.T * (p * (1 - p) + 1e-6)) @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, x.T @ (p - goal) + 1e-3 * theta)
        theta = theta - np.clip(move, -2, 2)
    machine.slope, machine.at = float(max(theta[0], 1e-3)), float(theta[1])
    scratch.drop(bags, units)
    return machine


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) and the columns in `keep`: a row for every row of `docs`.

    Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0; of a document with several labels the highest
    counts, null and other labels do not. Null, blank and empty texts have no string, and get the score of none. Without
    labels of both kinds, or without any instance that tells them apart, every score is 0. Repeated rows score alike; long
    texts are scored whole. Columns in `keep` named as the result's are left out; others are not read. An empty table gives
    no rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    machine = train(d, labels, scratch)
    held = spark.sparkContext.broadcast(machine)
    cols = [c for c in dict.fromkeys(keep or []) if c not in ("doc_id", "held_out", "score", "predicted")]
    rows = docs.select(F.col(doc_id).alias("_doc"), held_out(F.col(doc_id)).alias("_held"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(f"_k{k}") for k, c in enumerate(cols) if c != text])
    names = ["text" if c == text else f"_k{k}" for k, c in enumerate(cols)]  # the text is sent once
    out_cols = ["_doc", "_held", *names]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, most=TEXT):
            m = held.value
            p = np.zeros(b.num_rows) if m is None else m.probability(m.bags(b.column("text")))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in out_cols], pa.array(p)], [*out_cols, "score"])

    out = rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in out_cols) + ", score double")
    return out.select(F.col("_doc").alias("doc_id"), F.col("_held").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[F.col(n).alias(c) for n, c in zip(names, cols, strict=True)])


__all__ = ["Machine", "altered", "fit_machine", "held_out", "kernel", "parts", "score", "train"]
