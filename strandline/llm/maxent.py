"""Language-model scoring with a hashed maximum-entropy model.

Symbols. The model's vocabulary grows with the cube root of the training tokens (GROWTH words of their own for each unit of it,
the most frequent); every other word belongs to one of an eighth as many tail symbols, by a hash of its last three bytes. A word of a tail
symbol has the share (c + 0.1) / mass in it, where mass sums c + 0.1 over the symbol's words and 0.1 for all unseen ones,
so that the model is a distribution over all words.

Model. Symbols are dealt by frequency into about as many classes as a class has members. The next symbol's class, and then the
symbol within its class, are softmaxes whose logits add the weights of their features: a bias, the last symbol (bigram), the
last but one (skip) and, for the class, both together (trigram), hashed to rows of tables that grow with the vocabulary; in
the second table the row depends on the class too.

Training. The corpus is written once as symbol numbers, without a shuffle. Each round, tasks add up the expected counts of all rows over
their share of it, the first round the observed ones too; only these sums, of the tables' size, are exchanged. A
row's gradient, observed less expected counts, is taken as a damped step of their log ratio. Rounds end when the loss per token gains less than
ENOUGH.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, coded, pieces, top_rows, words

#: Words of their own for each unit of the cube root of the training tokens, and the share of tail symbols.
GROWTH, TAIL_SHARE = 4.0, 8
#: Words whose counts every worker holds, at least all with a symbol of their own; the counts of all other words are joined.
HEAD = 131_072
#: Rows for each symbol: of hashed pairs in the first table, of last symbols and of last but ones in the second.
PAIRS_A, LAST_B, SKIP_B = 8, 8, 8
#: Rounds at most, the part of a log ratio that a step takes, counts added to both of its sides, gain per token (in nats) that ends them.
ROUNDS, STEP, DAMP, ENOUGH = 3, 0.6, 2.0, 2e-3
SMOOTH = 0.1
#: Contexts worked on at once, tokens among which equal contexts are found, rows of the summed tables in a piece of the exchange.
CHUNK, BLOCK, PIECE = 16_384, 6_000_000, 64
#: Tokens at most that a task's sums hold, in counts of four bytes; then it sends them and starts anew.
MOST = (1 << 32) - 1
#: Sorted keys among which contexts are told apart at once.
SPAN = 16 * CHUNK
#: Bytes of text that are scored at once (equal contexts among them are worked out once), encoded at once and counted at once.
TEXT, ENCODED, COUNTED = 4_000_000, 2_000_000, 1_000_000
#: Repeats of a row up to which its counts are added one by one.
FEW = 3


def suffix_of(w: pa.Array) -> np.ndarray:
    """A hash, under 2 ** 31, of the last three bytes; the end token (an empty string): 0."""
    w = w.cast(pa.large_binary())
    _, offsets, data = w.buffers()
    ends = np.frombuffer(offsets, np.int64)[w.offset + 1 : w.offset + len(w) + 1]
    size = pc.binary_length(w).to_numpy(zero_copy_only=False)
    raw = np.frombuffer(data, np.uint8).astype(np.int64) if data is not None and data.size else np.zeros(1, np.int64)
    last = sum(np.where(size > k, raw[np.maximum(ends - 1 - k, 0)] + 1, 0) << (9 * k) for k in range(3))
    return (last * 0x9E3779B1 >> 7) & 0x7FFFFFFF


@dataclass(frozen=True)
class Shape:
    """Sizes of the tables for a number of symbols; symbol `classes * members` stands before a text's start."""

    symbols: int

    @property
    def classes(self) -> int:
        return max(2, int(np.ceil(np.sqrt(self.symbols))))

    @property
    def members(self) -> int:
        return max(2, -(-self.symbols // self.classes))

    @property
    def places(self) -> int:
        return self.classes * self.members

    @property
    def rows_a(self) -> int:
        return 1 + (2 + PAIRS_A) * (self.places + 1)

    @property
    def rows_b(self) -> int:
        return self.classes + (LAST_B + SKIP_B) * (self.places + 1)

    def in_a(self, s2: np.ndarray, s1: np.ndarray) -> list[np.ndarray]:
        """Rows of the features in the first table, but for the bias, which is row 0."""
        k = self.places + 1
        both = (s2 * k + s1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        return [1 + s1, 1 + k + s2, 1 + 2 * k + both.astype(np.int64) % (PAIRS_A * k)]

    def in_b(self, s2: np.ndarray, s1: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
        """Rows of the features, each with the class, in the second table, but for the bias, which is row c."""
        k, n = self.places + 1, self.classes
        return [n + (s1 * n + c) % (LAST_B * k), n + LAST_B * k + (s2 * n + c) % (SKIP_B * k)]


def _logits(table: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    x = table.take(rows[0], axis=0)
    x += bias
    more = np.empty_like(x)
    for r in rows[1:]:
        x += np.take(table, r, axis=0, out=more, mode="clip")
    if x.size and float(x.max()) > 60.0:  # no exponential overflows
        x -= x.max(axis=1, keepdims=True)
    return x


def _scatter(table: np.ndarray, r: np.ndarray, e: np.ndarray) -> None:
    """Adds the rows of e to the rows r of the table."""
    order = np.argsort(r)
    s = r[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(first, len(s)))
    for j in range(FEW):
        at = order[first[(size > j) & (size <= FEW)] + j]
        table[r[at]] += e[at]
    many = size > FEW
    if many.any():
        at = order[np.repeat(many, size)]
        start = np.concatenate([[0], np.cumsum(size[many])[:-1]])
        table[s[first[many]]] += np.add.reduceat(e[at], start, axis=0)


def _contexts(keys: np.ndarray, divide: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The distinct keys // divide of sorted keys, CHUNK at most at once: (they, the first key of each, the end of the last one's keys)."""
    done, span = 0, SPAN
    while done < len(keys):
        x = keys[done : done + span] // divide
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        if done + len(x) == len(keys):
            first = np.append(first, len(x))
        elif len(first) == 1:  # its keys may go on
            span *= 2
            continue
        for p in range(0, len(first) - 1, CHUNK):
            start = first[p : min(p + CHUNK, len(first) - 1)]
            yield x[start], done + start, done + int(first[p + len(start)])
        done, span = done + int(first[-1]), SPAN


@dataclass
class Weights:
    shape: Shape
    a: np.ndarray  # rows_a x classes
    b: np.ndarray  # rows_b x members

    def key(self, s2: np.ndarray, s1: np.ndarray, s0: np.ndarray) -> np.ndarray:
        """One number for a symbol in its context; sorted, those of one context, and of one class in it, are neighbours."""
        return (s1 * (self.shape.places + 1) + s2) * self.shape.places + s0

    def walk(self, keys: np.ndarray) -> Iterator[tuple]:
        """Through sorted keys, once for classes and once for members: (0 or 1, bias rows, other rows and logits of the contexts, slice
        of the keys, the context of each, its true class or member). Equal contexts are worked out once."""
        s = self.shape
        k = s.places + 1
        for t, (table, divide) in enumerate(((self.a, s.places), (self.b, s.members))):
            for x, start, end in _contexts(keys, divide):
                ctx, c = (x, np.zeros(len(x), np.int64)) if t == 0 else (x // s.classes, x % s.classes)
                rows = s.in_a(ctx % k, ctx // k) if t == 0 else s.in_b(ctx % k, ctx // k, c)
                at = slice(int(start[0]), end)
                true = keys[at] // s.members % s.classes if t == 0 else keys[at] % s.members
                bias = table[:1] if t == 0 else table.take(c, axis=0)
                yield t, c, rows, _logits(table, bias, rows), at, np.repeat(np.arange(len(x)), np.diff(np.append(start, end))), true

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted keys."""
        out = np.zeros(len(keys))
        for _, _, _, x, at, of, true in self.walk(keys):
            own = x[of, true].astype(np.float64)
            out[at] += own - np.log(np.exp(x).sum(axis=1, dtype=np.float64))[of]
        return out / np.log(10)


class Vocabulary:
    """What the workers need of the counts: the head words, their counts, their symbols, and the masses of the tails."""

    def __init__(self, head: list[tuple[str, int]], own: int, tail_words: np.ndarray, tail_tokens: np.ndarray, tokens: int, distinct: int):
        """head: by count, then by word; the first `own` get symbols. tail_words, tail_tokens: distinct words and tokens of each
        tail symbol, in all."""
        self.words = [w for w, _ in head]
        self.counts = np.array([c for _, c in head], np.int64)
        self.tails = len(tail_words)
        tail = suffix_of(pa.array(self.words[:own], pa.string())) % self.tails if own else np.zeros(0, np.int64)
        n = tail_words - np.bincount(tail, minlength=self.tails)
        t = tail_tokens - np.bincount(tail, self.counts[:own], self.tails)
        self.mass = t + SMOOTH * n + SMOOTH
        sizes = np.concatenate([self.counts[:own], self.mass])
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(sizes), np.int64)
        place[order] = np.arange(len(sizes))
        self.symbol = np.full(len(head), -1, np.int64)
        self.symbol[:own] = place[:own]
        self.tail_symbol = place[own:]
        self.shape = Shape(len(sizes))
        self.sizes = np.zeros(self.shape.places)
        self.sizes[: len(sizes)] = sizes[order]
        self.tokens, self.distinct = tokens, distinct
        self.floor = np.log10(tokens + SMOOTH * (distinct + 1))

    def start(self) -> Weights:
        """Biases that give the symbols their frequencies; all other weights zero."""
        s = self.shape
        w = Weights(s, np.zeros((s.rows_a, s.classes), np.float32), np.zeros((s.rows_b, s.members), np.float32))
        by = self.sizes.reshape(s.classes, s.members) + 1e-3
        w.a[0] = np.log(by.sum(axis=1) / by.sum())
        w.b[: s.classes] = np.log(by / by.sum(axis=1, keepdims=True))
        return w


def with_ends(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """As words(), with one empty string, the end token, after each document's words."""
    offsets, flat = words(text)
    n = len(offsets) - 1
    at = np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(offsets))
    order = np.full(len(flat) + n, len(flat), np.int64)
    order[at] = np.arange(len(flat))
    both = pa.concat_arrays([flat, pa.array([""], flat.type)])
    return offsets + np.arange(n + 1), both.take(pa.array(order))


def context(first: np.ndarray, s0: np.ndarray, bos: int) -> tuple[np.ndarray, np.ndarray]:
    """(last but one, last) of each symbol; `first` are the places at which documents start."""
    s1, s2 = np.concatenate([[bos], s0[:-1]]), np.concatenate([[bos, bos], s0[:-2]])[: len(s0)]
    s1[first] = bos
    s2[first] = bos
    second = first + 1
    s2[second[second < len(s0)]] = bos
    return s2, s1


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v, self.set = v, pa.array(v.words, pa.string())

    def __call__(self, text: pa.Array):
        """(offsets, symbol of each token, place in the head or -1, tail number, whether in a tail, codes, distinct words)."""
        offsets, flat = with_ends(text)
        codes, distinct = coded(flat)
        place = pc.fill_null(pc.index_in(distinct, value_set=self.set), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        tail = suffix_of(distinct) % self.v.tails
        known = np.where(place >= 0, self.v.symbol[np.maximum(place, 0)], -1) if len(self.v.words) else np.full(len(place), -1)
        symbol = np.where(known >= 0, known, self.v.tail_symbol[tail])
        return offsets, symbol[codes], place, tail, known < 0, codes, distinct


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def _release() -> None:
    """Gives back the memory that Arrow keeps for later; a worker would hold it through all the stages that follow."""
    pa.default_memory_pool().release_unused()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        found = []
        for part in pieces([b], most=COUNTED):
            codes, distinct = coded(with_ends(part.column("text"))[1])
            found.append((distinct, np.bincount(codes, minlength=len(distinct))))
        codes, distinct = coded(pa.concat_arrays([w for w, _ in found]))
        n = np.zeros(len(distinct), np.int64)
        np.add.at(n, codes, np.concatenate([n for _, n in found]))
        yield pa.RecordBatch.from_arrays([distinct, pa.array(suffix_of(distinct).astype(np.int32)), pa.array(n)], ["word", "suffix", "n"])
        del found, codes, distinct
        _release()


def _encoded(held):
    """A row a piece: its symbols and the places at which its documents start, as numbers of four bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(held.value)
        for b in pieces(batches, most=ENCODED):
            offsets, s0, *_ = encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([s0.astype(np.uint32).tobytes()], pa.binary()), pa.array([offsets[:-1].astype(np.uint32).tobytes()], pa.binary())], ["symbols", "first"])
        _release()

    return run


def _blocks(batches: Iterator[pa.RecordBatch], w: Weights) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct keys, sorted; how often each occurs) of about BLOCK tokens at once. A token is held as its key alone, eight bytes, in an
    array that the next block takes over."""
    room, n = np.empty(BLOCK, np.int64), 0
    for b in batches:
        for k in range(b.num_rows):
            s0, first = (np.frombuffer(b.column(c)[k].as_buffer(), np.uint32).astype(np.int64) for c in ("symbols", "first"))
            if n and n + len(s0) > len(room):
                yield _distinct(room[:n])
                n = 0
            if len(s0) > len(room):
                room = np.empty(len(s0), np.int64)
            room[n : n + len(s0)] = w.key(*context(first, s0, w.shape.places), s0)
            n += len(s0)
    if n:
        yield _distinct(room[:n])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with counts, but sorts the keys in place and moves the distinct ones to their front."""
    keys.sort()
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    n, upto = np.empty(np.count_nonzero(new), np.int32), 0
    for p in range(0, len(keys), SPAN):
        first = np.flatnonzero(new[p : p + SPAN]) + p
        at = slice(upto, upto + len(first))
        keys[at], n[at] = keys[first], first
        upto += len(first)
    if upto:
        n[:-1] = n[1:] - n[:-1]
        n[-1] = len(keys) - n[-1]
    return keys[:upto], n


class Sums:
    """Expected counts of both tables under the weights, the observed ones where asked for, the log-likelihood and the tokens."""

    def __init__(self, w: Weights, observe: bool):
        self.w, self.expected = w, [np.zeros(x.shape, np.float32) for x in (w.a, w.b)]
        self.observed = [np.zeros(x.shape, np.uint32) for x in (w.a, w.b)] if observe else []  # whole, as floats stop counting at 2 ** 24
        self.loss, self.tokens = 0.0, 0

    def add(self, s2: np.ndarray, s1: np.ndarray, s0: np.ndarray) -> None:
        self.add_keys(*_distinct(self.w.key(s2, s1, s0)))

    def add_keys(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Sorted keys, each n times."""
        self.tokens += int(n.sum(dtype=np.int64))
        for t, c, rows, x, at, of, true in self.w.walk(keys):
            times, own = n[at].astype(np.float32), x[of, true]
            e = np.exp(x, out=x)
            z = e @ np.ones(e.shape[1], np.float32)
            self.loss -= float(((own - np.log(z)[of]) * times).sum(dtype=np.float64))
            e *= (np.bincount(of, times, len(e)).astype(np.float32) / z)[:, None]
            classes = np.zeros((len(e), self.w.shape.classes if t else 1), np.float32)
            classes[np.arange(len(e)), c] = 1
            self.expected[t][: classes.shape[1]] += classes.T @ e
            for r in rows:
                _scatter(self.expected[t], r, e)
            for r in [c, *rows] if self.observed else ():
                np.add.at(self.observed[t].reshape(-1), r[of] * e.shape[1] + true, n[at].astype(np.uint32))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The sums in pieces of PIECE rows; piece -1 holds the loss and the tokens."""
        for t, x in enumerate(self.expected + self.observed):
            for p in range(0, len(x), PIECE):
                part = x[p : p + PIECE].astype(np.float32, copy=False)
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([t << 32 | p // PIECE], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["piece", "sums"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([np.array([self.loss, self.tokens]).tobytes()], pa.binary())], ["piece", "sums"])


def _expected(held, observe: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Weights = held.value
        sums = Sums(w, observe)
        for keys, n in _blocks(batches, w):
            if sums.tokens + int(n.sum(dtype=np.int64)) > MOST:
                yield from sums.rows()
                sums = Sums(w, observe)
            sums.add_keys(keys, n)
            del keys, n  # else the counts are held while the next ones are made
        yield from sums.rows()
        _release()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for piece, sums in zip(b.column("piece").to_pylist(), b.column("sums").to_pylist(), strict=True):
            x = np.frombuffer(sums, np.float64 if piece < 0 else np.float32)
            total[piece] = total[piece] + x if piece in total else x
    for piece, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["piece", "sums"])


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: Weights
    counts: DataFrame  # word, suffix, c: all training words
    losses: list[float] = field(default_factory=list)  # nats per token before each step


def gathered(rows: list, w: Weights) -> tuple[list[np.ndarray], float, float]:
    """(expected and, where sent, observed tables; loss; tokens) of summed pieces."""
    tables = [np.zeros(x.shape, np.float32) for x in (w.a, w.b, w.a, w.b)]
    loss = tokens = 0.0
    for piece, raw in rows:
        if piece < 0:
            loss, tokens = np.frombuffer(bytes(raw), np.float64)
            continue
        table, at = tables[piece >> 32], (piece & (1 << 32) - 1) * PIECE
        table[at : at + PIECE] = np.frombuffer(bytes(raw), np.float32).reshape(-1, table.shape[1])
    return tables, float(loss), float(tokens)


def stepped(w: Weights, observed: list[np.ndarray], expected: list[np.ndarray]) -> Weights:
    move = [np.float32(STEP) * np.log((o + np.float32(DAMP)) / (e + np.float32(DAMP))) for o, e in zip(observed, expected, strict=True)]
    return Weights(w.shape, w.a + move[0], w.b + move[1])


def train(docs: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> Model:
    """docs: column text. Counts and contexts cover every document given."""
    spark = docs.sparkSession
    counts = scratch.save(docs.select("text").mapInArrow(_count, "word string, suffix int, n long").groupBy("word", "suffix").agg(F.sum("n").alias("c")))
    tokens, distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    own = int(np.ceil(GROWTH * np.cbrt(tokens)))
    tails = max(8, own // TAIL_SHARE)
    found = top_rows(counts, max(HEAD, own), "c", "word").select("word", "c").collect()
    head = sorted(((r[0], r[1]) for r in found), key=lambda r: (-r[1], r[0]))
    tail_words, tail_tokens = np.zeros(tails, np.int64), np.zeros(tails, np.int64)
    for tail, n, c in counts.groupBy(F.pmod("suffix", F.lit(tails))).agg(F.count(F.lit(1)), F.sum("c")).collect():  # a row a tail
        tail_words[tail], tail_tokens[tail] = n, c
    v = Vocabulary(head, min(own, len(head)), tail_words, tail_tokens, tokens, distinct)
    held = spark.sparkContext.broadcast(v)
    w, losses = v.start(), []
    if not tokens:
        return Model(v, w, counts)
    encoded = scratch.save(docs.select("text").mapInArrow(_encoded(held), "symbols binary, first binary"))
    tasks = max(1, spark.sparkContext.defaultParallelism)
    observed: list[np.ndarray] = []
    for k in range(rounds):
        now = spark.sparkContext.broadcast(w)
        kind = "piece long, sums binary"
        rows = encoded.coalesce(tasks).mapInArrow(_expected(now, k == 0), kind).repartition(tasks, "piece").mapInArrow(_summed, kind).collect()  # at most a row a piece
        tables, loss, n = gathered(rows, w)
        observed = observed or tables[2:]
        losses.append(loss / n)
        w = stepped(w, observed, tables[:2])
        now.unpersist()
        del rows, tables
        if len(losses) > 1 and losses[-2] - losses[-1] < ENOUGH:
            break
    scratch.drop(encoded)
    return Model(v, w, counts, losses)


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, w = held.value
        encode, row = Encoder(v), TaskContext.get().partitionId() << 40
        logs = np.log10(v.counts + SMOOTH) if len(v.counts) else np.zeros(1)
        mass = np.log10(v.mass)
        for b in pieces(batches, most=TEXT):
            offsets, s0, place, tail, in_tail, codes, distinct = encode(b.column("text"))
            keys, back = np.unique(w.key(*context(offsets[:-1], s0, w.shape.places), s0), return_inverse=True)
            p = w.log10(keys)[back]
            seen = place >= 0
            own = np.where(seen, logs[np.maximum(place, 0)], 0.0)  # log10(c + 0.1) of head words, the others follow by the join
            base, model = own[codes], p + np.where(in_tail, own - mass[tail], 0.0)[codes]
            first = offsets[:-1]
            total = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023  every document has its end token
            n = b.num_rows
            # words outside the head: distinct ones of each document, with their number
            far = np.flatnonzero(~seen[codes])
            doc = np.searchsorted(offsets, far, "right") - 1
            pair, times = np.unique(doc * (len(distinct) + 1) + codes[far], return_counts=True)
            lists = np.concatenate([[0], np.cumsum(np.bincount(pair // (len(distinct) + 1), minlength=n))]).astype(np.int32)
            rare = pa.StructArray.from_arrays([distinct.take(pa.array(pair % (len(distinct) + 1))), pa.array(times.astype(np.int32))], ["word", "times"])
            ids = row + np.arange(n)
            row += n
            yield pa.RecordBatch.from_arrays([pa.array(ids), b.column("doc_id"), b.column("held_out"), pa.array(np.diff(offsets)), pa.array(total(seen[codes].astype(np.int64))), pa.array(total(base)), pa.array(total(model)), pa.ListArray.from_arrays(pa.array(lists), rare)], ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_model", "rare"])
        _release()

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for every row of `docs`.

    Learns from the rows whose crc32(doc_id as text) mod 10 is not 0, a null doc_id included. Long texts are read whole. Null and blank texts have the
    end token alone. Repeated rows count and come out as often as they are there. Without training rows all words are unseen.
    Other columns are not read. An empty table gives no rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "maxent")
    d = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    m = train(d.where("not held_out"), scratch, rounds)
    held = spark.sparkContext.broadcast((m.vocabulary, m.weights))
    kind = dict(d.dtypes)["doc_id"]
    first = scratch.save(d.mapInArrow(_score(held), f"row long, doc_id {kind}, held_out boolean, n_tokens long, head_known long, head_base double, head_model double, rare array<struct<word:string,times:int>>"))
    rare = first.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    joined = rare.join(m.counts.select("word", "c"), "word", "left")
    far = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("far"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("far_known"))
    v = m.vocabulary
    out = first.drop("rare").join(far, "row", "left")
    more = F.coalesce("far", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + more - F.col("n_tokens") * F.lit(float(v.floor))).alias("base_score"),
        (F.col("head_model") + more).alias("score"),
    )
