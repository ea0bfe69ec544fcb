"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

p(word | history) = p(class | history) * p(word | class, history). The most
frequent words form classes of equal size, modelled word by word; all other
words fall into classes by their last letters and follow the add-half unigram
of their class, which leaves room for unseen words, mixed with how often the
word itself came after the word before. Both softmaxes start from the corpus
counts as base measure and add the weights of hashed features of the history:
the word before, the two before together, and the second and third word before
as skips.

Counts cover all training documents. Weights are trained by synchronous
distributed gradient updates. The gradient of a weight is how often its feature
and its class occur together less how often the model expects them to; both are
sums over all positions of all training documents, added up in each task and
then over the tasks by a tree of shuffles, so that the partitioning decides
nothing. An update scales the gradient iteratively: each weight moves by a share
of ln(observed / expected), both smoothed. At weights of 0 the expectation
follows from counts alone, so that the first update takes no softmax; each round
after it is one pass of softmaxes. Scoring works in numpy batches. Word counts
beyond the bounded table that workers hold are joined by a shuffle. So are the
counts of pairs of words: every word beyond the softmaxes has its own, however
many there are. Parcels of documents send theirs to buckets of words, which
count the training ones and answer with what each adds to its document's score.
"""

from __future__ import annotations

import dataclasses
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, small_batches, task_rows
from .word_hash import hash_bytes, mix


@dataclass(frozen=True)
class LmParams:
    #: Classes of frequent words and words in each.
    frequent_classes: int = 32
    class_words: int = 64
    #: Classes of the other words, at most 64.
    suffix_classes: int = 48
    #: Rows of either weight table, a power of 2.
    buckets: int = 1 << 13
    #: Word counts that workers hold (sorted arrays of 16 bytes a word); others are joined.
    held_counts: int = 1 << 18
    #: The update from weights of 0: share of ln(observed / expected), and how many expected ones are added to both.
    start_rate: float = 0.5
    start_smoothing: float = 24.0
    #: Rounds after it; each takes every position of every training document.
    rounds: int = 1
    rate: float = 0.5
    smoothing: float = 1000.0
    #: Weights stay within this, so that sums of them have exponentials.
    most: float = 15.0
    #: Occurrences after a word that the class's unigram counts for, beside the counted ones.
    unigram_counts: float = 16.0
    #: Bytes of text to a chunk: its arrays fit a core's cache.
    chunk: int = 1 << 15


#: The low bits of a token's number are its suffix class.
_SUFFIX = np.uint64(63)
_END = np.uint64(0x452821E638D01377) & ~_SUFFIX
_LOG10 = math.log(10)


def _held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _chunks(texts: list[str | None], p: LmParams) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Consecutive documents of about p.chunk bytes: tokens (words, then one end each), document number of each token, first and last + 1 document."""
    held: list[bytes] = []
    first, size = 0, 0
    for i, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= p.chunk or i == len(texts) - 1:
            h, tail, start = hash_bytes(b"\n".join(held))
            with np.errstate(over="ignore"):
                h = (h & ~_SUFFIX) | (mix(tail.astype(np.uint64) + np.uint64(1)) % np.uint64(p.suffix_classes))
            # A document's words end where the next one's bytes begin.
            ends = np.searchsorted(start, np.cumsum([len(x) + 1 for x in held]))
            tokens = np.insert(h, ends, _END)
            yield tokens, np.repeat(np.arange(first, i + 1), np.diff(np.concatenate([[0], ends])) + 1), first, i + 1
            held, first, size = [], i + 1, 0


def _counted(p: LmParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [tokens for tokens, _, _, _ in _chunks(batch.column(0).to_pylist(), p)]
            if parts:
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "c"])

    return run


@dataclass
class LmModel:
    """What workers hold; its size is fixed by LmParams."""

    params: LmParams
    tokens: int
    distinct: int
    #: Counts of the most frequent words, sorted by hash.
    held: np.ndarray
    held_c: np.ndarray
    #: Frequent words sorted by hash, and each one's number (class * class_words + place).
    words: np.ndarray
    number: np.ndarray
    #: ln base measures: of classes, and of the words in each frequent class.
    class_base: np.ndarray
    word_base: np.ndarray
    #: ln of the denominators of the suffix classes.
    suffix_norm: np.ndarray
    #: Weights: (buckets, classes) and (buckets, class_words).
    by_class: np.ndarray
    by_word: np.ndarray
    #: How often the other words of each suffix class come first in a text (row 0), or after each frequent word (its number + 1).
    after: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each token among the held ones, and whether it is there: by a direct table first, the rest by search."""
        if not len(self.held):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        bits = np.uint64(max(1, 4 * len(self.held)).bit_length())
        direct = self.__dict__.get("_direct")
        if direct is None:
            direct = np.zeros(1 << int(bits), np.int32)
            direct[(self.held >> np.uint64(64 - int(bits))).astype(np.int64)] = np.arange(len(self.held))
            self.__dict__["_direct"] = direct
        at = direct[(h >> np.uint64(64 - int(bits))).astype(np.int64)].astype(np.int64)
        there = self.held[at] == h
        rest = np.flatnonzero(~there)
        at[rest], there[rest] = _look(self.held, h[rest])
        return at, there


def count_words(train: DataFrame, p: LmParams, text: str = "text") -> DataFrame:
    """(h, c) of every distinct training token."""
    rows = train.select(F.col(text).cast("string").alias("text")).mapInArrow(lean(_counted(p)), "h long, c long")
    return materialize(rows.groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")


def _top(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` words with the largest counts, of equally frequent ones those with the smaller hash.

    Few counts differ (their sum is the number of tokens). Words of the last
    count are told apart by the first 16 bits of their hashes, and by the whole
    hash where these are equal, so that no task sorts all of them.
    """

    def cut(sizes: pa.Table, most: int) -> tuple[int, int] | None:
        """Which row of sizes is the first that doesn't fit whole, and how many of it do."""
        over = np.cumsum(sizes["n"].to_numpy()) - most
        at = int(np.argmax(over > 0)) if (over > 0).any() else None
        return None if at is None else (at, sizes["n"][at].as_py() - int(over[at]))

    size = F.count(F.lit(1)).alias("n")
    sizes = counts.groupBy("c").agg(size).toArrow().sort_by([("c", "descending")])
    if (found := cut(sizes, most)) is None:
        return counts
    least, left = sizes["c"][found[0]].as_py(), found[1]
    tied, bits = counts.where(F.col("c") == least), F.shiftrightunsigned("h", 48)
    sizes = tied.groupBy(bits.alias("bits")).agg(size).toArrow().sort_by("bits")
    at, left = cut(sizes, left)
    edge = sizes["bits"][at].as_py()
    return counts.where((F.col("c") > least) | ((F.col("c") == least) & (bits < edge))).unionByName(tied.where(bits == edge).orderBy("h").limit(left))


def _start(counts: DataFrame, p: LmParams) -> LmModel:
    by_suffix = {r["suffix"]: (r["n"], r["v"]) for r in counts.groupBy(F.col("h").bitwiseAND(F.lit(63)).alias("suffix")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    top = _top(counts, max(p.held_counts, p.frequent_classes * p.class_words)).toArrow()
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    by_count = np.lexsort((h, -c))
    h, c = h[by_count], c[by_count]
    suffix = (h & _SUFFIX).astype(np.int64)
    m = min(len(h), p.frequent_classes * p.class_words)
    rank, order = np.arange(m), np.argsort(h[:m])
    n = np.zeros(p.suffix_classes)
    v = np.zeros(p.suffix_classes)
    for k, (x, y) in by_suffix.items():
        n[k], v[k] = x, y
    tokens, distinct = int(n.sum()), int(v.sum())
    n -= np.bincount(suffix[:m], c[:m], p.suffix_classes)
    v -= np.bincount(suffix[:m], minlength=p.suffix_classes)
    word_c = np.zeros(p.frequent_classes * p.class_words)
    word_c[rank] = c[:m]
    word_c = word_c.reshape(p.frequent_classes, p.class_words)
    mass = word_c.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        word_base = np.where(word_c > 0, np.log(word_c) - np.log(mass)[:, None], -1e4)
        classes = np.concatenate([np.where(mass > 0, np.log(mass), -1e4), np.log(n + 0.5 * (v + 1))])
    classes -= np.log(np.exp(classes - classes.max()).sum()) + classes.max()
    all_ = np.argsort(h)
    k = p.frequent_classes + p.suffix_classes
    return LmModel(
        p, tokens, distinct, h[all_], c[all_], h[:m][order], rank[order], classes.astype(np.float32), word_base.astype(np.float32), np.log(n + 0.5 * (v + 1)),
        np.zeros((p.buckets, k), np.float32), np.zeros((p.buckets, p.class_words), np.float32),
        np.zeros((len(word_c.ravel()) + 1, p.suffix_classes), np.int64),
    )


def _look(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def _contexts(m: LmModel, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and place of every token (place -1: not a frequent word), and the hashes of its features."""
    p = m.params
    suffix = (h & _SUFFIX).astype(np.int64)
    at, frequent = _look(m.words, h)
    number = np.where(frequent, m.number[at] if len(m.words) else 0, -1)
    cls = np.where(frequent, number // p.class_words, p.frequent_classes + suffix)
    place = np.where(frequent, number % p.class_words, -1)
    # A word as history: its number if frequent, else its suffix class; 0: before the text.
    name = np.where(frequent, number + 1 + p.suffix_classes, suffix + 1).astype(np.uint64)
    past = []
    for k in (1, 2, 3):
        x = np.zeros(len(h), np.uint64)
        x[k:] = np.where(doc[k:] == doc[:-k], name[:-k], np.uint64(0)) if len(h) > k else x[k:]
        past.append(x)
    with np.errstate(over="ignore"):
        seeds = [past[0], past[0] * np.uint64(1 << 20) + past[1] + np.uint64(1), past[1], past[2]]
        return cls, place, np.stack([mix(s + np.uint64((k + 1) << 50)) for k, s in enumerate(seeds)])


def _before(m: LmModel, cls: np.ndarray, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The row of m.after of each token's word before; -1 if that isn't a frequent word."""
    row = np.zeros(len(cls), np.int64)
    row[1:] = np.where(doc[1:] == doc[:-1], np.where(place[:-1] >= 0, cls[:-1] * m.params.class_words + place[:-1] + 1, -1), 0)
    return row


def _rows(features: np.ndarray, p: LmParams, cls: np.ndarray | None = None) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((mix(features + np.uint64(0x9E3779B97F4A7C15) * (cls.astype(np.uint64) + np.uint64(1))) if cls is not None else features) & np.uint64(p.buckets - 1)).astype(np.int64)


def _powered(base: np.ndarray, table: np.ndarray, rows: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of the logits (tokens, width), their sums, and each token's logit at its target."""
    x = table.take(rows[0], 0)
    for r in rows[1:]:
        x += table.take(r, 0)
    x += base
    at = x[np.arange(len(target)), target]
    np.exp(x, out=x)
    return x, x.sum(1), at


def _log10_prob(base: np.ndarray, table: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    _, total, at = _powered(base, table, rows, target)
    return (at - np.log(total)).astype(np.float64) / _LOG10


#: Tokens to a softmax: a long text's logits are never there all at once.
_SOFTMAX = 1 << 12


def _slices(cls: np.ndarray, place: np.ndarray, features: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return ((cls[i : i + _SOFTMAX], place[i : i + _SOFTMAX], features[:, i : i + _SOFTMAX]) for i in range(0, len(cls), _SOFTMAX))


def _class_and_place(m: LmModel, cls: np.ndarray, place: np.ndarray, features: np.ndarray) -> np.ndarray:
    """log10 of each token's probability of its class, and of its place there if it is a frequent word."""
    p = m.params
    value = _log10_prob(m.class_base, m.by_class, _rows(features, p), cls)
    own = np.flatnonzero(place >= 0)
    if len(own):
        value[own] += _log10_prob(m.word_base[cls[own]], m.by_word, _rows(features[:, own], p, cls[own]), place[own])
    return value


def _expectation(base: np.ndarray, table: np.ndarray, rows: np.ndarray, target: np.ndarray, total: np.ndarray) -> None:
    """Add each token's distribution to the rows of ``total`` of its features."""
    x, norm, _ = _powered(base, table, rows, target)
    x /= norm[:, None]
    at, sums = _segment_sums(x, rows)
    total[at] += sums


#: Rows added up at a time by _segment_sums().
_WIDE = 12


def _segment_sums(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums of the values that fall on them): by whole-array gathers of every first, second .. of _WIDE members, level by level."""
    flat = rows.astype(np.uint16 if rows.max(initial=0) < 1 << 16 else np.uint32).ravel()
    order = np.argsort(flat, kind="stable")
    name, at = flat[order], order % values.shape[0]
    while True:
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        size = np.diff(np.append(first, len(name)))
        parts = -(-size // _WIDE)
        start = np.repeat(first, parts) + _WIDE * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        left = np.minimum(_WIDE, np.repeat(first + size, parts) - start)
        # The fullest parts first, so that those with a further member are a head of the array.
        fullest = np.argsort((_WIDE - left).astype(np.uint8), kind="stable")
        begin = start[fullest]
        sums = values.take(at[begin], 0)
        for k in range(1, _WIDE):
            more = np.count_nonzero(left > k)
            sums[:more] += values.take(at[begin[:more] + k], 0)
        if len(start) == len(first):
            return name[begin].astype(np.int64), sums
        place = np.empty(len(start), np.int64)
        place[fullest] = np.arange(len(start))
        values, name, at = sums, name[start], place


#: Tables go through the shuffle in so many blocks.
_BLOCKS = 16


def _blocks(whole: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(_BLOCKS, dtype=np.int32)), pa.array([TaskContext.get().partitionId()] * _BLOCKS, pa.int32()), pa.array([x.tobytes() for x in np.array_split(whole, _BLOCKS)], pa.binary())],
        ["block", "part", "w"],
    )


#: Tokens counted at a time.
_COUNTED = 1 << 16


def _observed(model, with_after: bool = False):
    """How often each row meets each class, each place in a class and each frequent class; and, cut into so many rows, LmModel.after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LmModel = model.value
        p, classes = m.params, m.by_class.shape[1]
        whole = [np.zeros(p.buckets * width, np.int64) for width in (classes, p.class_words, p.frequent_classes, _after_width(m) if with_after else 0)]

        def add(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
            cls, place, features = (np.concatenate([x[i] for x in held], -1) for i in range(3))
            own = np.flatnonzero(place >= 0)
            for row in _rows(features, p):
                whole[0] += np.bincount(row * classes + cls, minlength=len(whole[0]))
            for row in _rows(features[:, own], p, cls[own]):
                whole[1] += np.bincount(row * p.class_words + place[own], minlength=len(whole[1]))
                whole[2] += np.bincount(row * p.frequent_classes + cls[own], minlength=len(whole[2]))

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for h, doc, _, _ in _chunks(batch.column(0).to_pylist(), p):
                held.append(_contexts(m, h, doc))
                if with_after:
                    cls, place, _ = held[-1]
                    row = _before(m, cls, place, doc)
                    own = np.flatnonzero((place < 0) & (row >= 0))
                    np.add.at(whole[3], row[own] * p.suffix_classes + cls[own] - p.frequent_classes, 1)
                if sum(len(x[0]) for x in held) >= _COUNTED:
                    add(held)
                    held = []
        if held:
            add(held)
        if whole[0].any():
            yield _blocks(np.concatenate([x.reshape(p.buckets, -1) for x in whole], 1))

    return run


def _after_width(m: LmModel) -> int:
    """Columns of m.after when it is cut into as many rows as the weights have."""
    return -(-m.after.size // m.params.buckets)


#: Softmaxes to a short sum.
_SHORT = 64


def _expected(model):
    """How often the model expects each row to meet each class, and each place in a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LmModel = model.value
        p, seen = m.params, 0
        # Short sums are in single precision; they are moved to the long ones before small numbers could get lost in them.
        wide = [np.zeros(x.shape, np.float64) for x in (m.by_class, m.by_word)]
        by_class, by_word = (np.zeros(x.shape, np.float32) for x in (m.by_class, m.by_word))

        def move() -> None:
            for long, short in zip(wide, (by_class, by_word)):
                long += short
                short[:] = 0

        for batch in batches:
            for h, doc, _, _ in _chunks(batch.column(0).to_pylist(), p):
                for cls, place, features in _slices(*_contexts(m, h, doc)):
                    seen += 1
                    if seen % _SHORT == 0:
                        move()
                    _expectation(m.class_base, m.by_class, _rows(features, p), cls, by_class)
                    own = np.flatnonzero(place >= 0)
                    if len(own):
                        _expectation(m.word_base[cls[own]], m.by_word, _rows(features[:, own], p, cls[own]), place[own], by_word)
        if seen:
            move()
            yield _blocks(np.concatenate(wide, 1).astype(np.float32))

    return run


def _added(dtype: type, wide: type):
    """One row for the rows of a group: the sum of their numbers."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(w.as_buffer(), dtype).astype(wide) for w in rows["w"]), np.zeros(1, wide))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "w": pa.array([total.astype(dtype).tobytes()], pa.binary())})

    return run


#: Blocks that one task adds up at a time.
_FAN = 64


def _gathered(rows: DataFrame, count, shape: tuple[int, int], dtype: type) -> np.ndarray:
    """The sum over all tasks of the tables that ``count`` makes; zeros if there are none."""
    schema = "block int, part int, w binary"
    done = rows.mapInArrow(lean(count), schema)
    # A tree: no task adds up more than _FAN blocks.
    width = done.rdd.getNumPartitions()
    while True:
        done = done.withColumn("part", F.floor(F.col("part") / _FAN).cast("int")).groupBy("block", "part").applyInArrow(_added(dtype, np.float64 if dtype is np.float32 else dtype), schema)
        width = -(-width // _FAN)
        if width <= 1:
            break
    found = done.toArrow().sort_by("block")
    return np.concatenate([np.frombuffer(x, dtype) for x in found["w"].to_pylist()]).reshape(shape) if found.num_rows else np.zeros(shape, dtype)


def _move(weights: np.ndarray, observed: np.ndarray, expected: np.ndarray, base: np.ndarray, rate: float, smoothing: float, most: float) -> np.ndarray:
    """The weights after one update; ``smoothing`` positions distributed as the base are added to both sides."""
    added = smoothing * base
    return np.clip(weights + rate * np.log((observed + added) / (expected + added)), -most, most).astype(np.float32)


def train(docs: DataFrame, counts: DataFrame, p: LmParams, text: str = "text") -> LmModel:
    """The model after the first update and p.rounds rounds, all of them over all of docs."""
    spark, m = docs.sparkSession, _start(counts, p)
    rows = docs.select(F.col(text).cast("string").alias("text"))
    classes, words = m.by_class.shape[1], p.class_words
    shared = spark.sparkContext.broadcast(m)
    edges = np.cumsum([classes, words, p.frequent_classes, _after_width(m)])
    whole = _gathered(rows, _observed(shared, True), (p.buckets, int(edges[-1])), np.int64)
    shared.destroy()
    by_class, by_word, own, after = np.split(whole, edges[:-1], 1)
    m = dataclasses.replace(m, after=after.ravel()[: m.after.size].reshape(m.after.shape))
    # At weights of 0 every position has the base measure of its classes, or of its class's words.
    class_base = np.exp(m.class_base.astype(np.float64))[None] + 1e-12
    word_expected = own @ np.exp(m.word_base.astype(np.float64))
    n = word_expected.sum(1, keepdims=True)
    word_base = np.where(n > 0, word_expected / np.maximum(n, 1e-12), 1 / words) + 1e-9

    def moved(expected: tuple[np.ndarray, np.ndarray], rate: float, smoothing: float) -> LmModel:
        at = _move(m.by_class, by_class, expected[0], class_base, rate, smoothing, p.most), _move(m.by_word, by_word, expected[1], word_base, rate, smoothing, p.most)
        return dataclasses.replace(m, by_class=at[0], by_word=at[1])

    m = moved((by_class.sum(1, keepdims=True) * class_base, word_expected), p.start_rate, p.start_smoothing)
    for _ in range(p.rounds):
        shared = spark.sparkContext.broadcast(m)
        expected = _gathered(rows, _expected(shared), (p.buckets, classes + words), np.float32).astype(np.float64)
        shared.destroy()
        m = moved((expected[:, :classes], expected[:, classes:]), p.rate, p.smoothing)
    return m


#: Tokens to a parcel, and documents; tokens to a bucket.
_PARCEL, _PARCEL_DOCS, _BUCKET = 1 << 20, 1 << 15, 1 << 21
#: What a row of a parcel is about: words after their words before, classes after words that aren't frequent, or the documents.
_PAIRS, _AFTER, _DOCS = range(3)
_PARCELS = "kind int, bucket int, parcel long, train boolean, name binary, size binary, tag binary, doc binary"
_ANSWERS = "parcel long, kind int, doc binary, value binary"


def _signatures(h: np.ndarray, doc: np.ndarray, first: int, last: int) -> np.ndarray:
    """A hash of each document's tokens in their order."""
    edge = np.searchsorted(doc, np.arange(first, last + 1))
    with np.errstate(over="ignore"):
        place = (np.arange(len(h)) - edge[doc - first] + 1).astype(np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + place * np.uint64(0x9E3779B97F4A7C15)))])
        return total[edge[1:]] - total[edge[:-1]]


def _parcel(number: int, train: bool, parts: list[tuple[np.ndarray, ...]], bits: int) -> pa.RecordBatch:
    """Rows for each bucket of words, and of classes after words, that the parcel has tokens in, and one for its documents."""
    begin = np.cumsum([0, *(len(x[0]) for x in parts)])
    doc = np.concatenate([x[1] + b for x, b in zip(parts, begin)]).astype(np.min_scalar_type(begin[-1]))
    h, before, held = (np.concatenate([x[i] for x in parts]) for i in (2, 3, 4))
    with np.errstate(over="ignore"):
        mixed = mix(before + np.uint64(0x9E3779B97F4A7C15))
        after = mix(mixed[~held] + (h[~held] & _SUFFIX))
    rows = [(_DOCS, number % (1 << bits), b"", b"", b"", np.concatenate([x[0] for x in parts]).tobytes())]
    for kind, key, d in ((_PAIRS, h, doc), (_AFTER, after, doc[~held])):
        order = np.argsort(key)
        key, d = key[order], d[order]
        tag = (mixed[order] >> np.uint64(32)).astype(np.uint32) if kind == _PAIRS else None
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        name, size = key[first], np.diff(np.append(first, len(key))).astype(np.uint32)
        bucket = (name >> np.uint64(64 - bits)).astype(np.int64)
        to = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(name) else first
        for i, j in zip(to, [*to[1:], len(name)]):
            a, b = first[i], first[j] if j < len(first) else len(key)
            rows.append((kind, int(bucket[i]), name[i:j].tobytes(), size[i:j].tobytes(), tag[a:b].tobytes() if tag is not None else b"", d[a:b].tobytes()))
    kinds, buckets, *binary = zip(*rows)
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array([number] * n, pa.int64()), pa.array([train] * n), *(pa.array(x, pa.binary()) for x in binary)],
        ["kind", "bucket", "parcel", "train", "name", "size", "tag", "doc"],
    )


def _sent(model, bits: int):
    """Parcels of the tokens that the softmaxes don't model word by word, each with the word before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LmModel = model.value
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        waiting: dict[bool, list[tuple[np.ndarray, ...]]] = {False: [], True: []}
        for batch in batches:
            out, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for held_out, parts in waiting.items():
                for h, doc, first, last in _chunks([t for t, x in zip(texts, out) if x == held_out], m.params):
                    frequent = _look(m.words, h)[1]
                    other = np.flatnonzero(~frequent)
                    before = np.zeros(len(h), np.uint64)
                    before[1:] = np.where(doc[1:] == doc[:-1], h[:-1], np.uint64(0))
                    # The first word of a text, and one after a frequent word: m.after has what comes after.
                    held = np.ones(len(h), bool)
                    held[1:] = (doc[1:] != doc[:-1]) | frequent[:-1]
                    parts.append((_signatures(h, doc, first, last), doc[other] - first, h[other], before[other], held[other]))
                    if sum(len(x[2]) for x in parts) >= _PARCEL or sum(len(x[0]) for x in parts) >= _PARCEL_DOCS:
                        yield _parcel(next(numbers), not held_out, parts, bits)
                        parts.clear()
        for held_out, parts in waiting.items():
            if parts:
                yield _parcel(next(numbers), not held_out, parts, bits)

    return run


def _sums(name: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each entry the sum of n over the entries of the same name."""
    order = np.argsort(name)
    x = name[order]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    out = np.empty(len(n), n.dtype)
    out[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(x))))
    return out


def _answered(suffix_norm: np.ndarray, prior: float):
    """What the tokens of a bucket add to the log10 probabilities of their documents, parcel by parcel.

    A word's probability in its class is (c(before, word) + prior * u) / (c(before, class) + prior), u being its
    unigram there, which the scores have already: a pair adds what it has more than prior * u, a class after a word
    takes what it has more than prior. After frequent words the scores have taken that already.
    """

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        kind, parcels = key[0].as_py(), rows["parcel"].to_pylist()
        docs = [x.as_buffer() for x in rows["doc"]]
        if kind == _DOCS:
            return pa.table({"parcel": rows["parcel"], "kind": pa.array([kind] * len(docs), pa.int32()), "doc": rows["doc"], "value": pa.array([b""] * len(docs), pa.binary())})
        names, sizes = ([np.frombuffer(x.as_buffer(), t) for x in rows[c]] for c, t in (("name", np.uint64), ("size", np.uint32)))
        train = np.repeat(rows["train"].to_numpy().astype(np.int64), [len(x) for x in names])
        name, size = np.concatenate(names), np.concatenate(sizes).astype(np.int64)
        seen = _sums(name, size * train)
        if kind == _AFTER:
            value = np.repeat(-np.log10(1 + seen / prior), size)
        else:
            unigram = (seen + 0.5) * np.exp(-suffix_norm[(name & _SUFFIX).astype(np.int64)])
            tag = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in rows["tag"]]).astype(np.uint64)
            with np.errstate(over="ignore"):
                pair = mix(np.repeat(name, size) + tag * np.uint64(0x9E3779B97F4A7C15))
            value = np.log10(1 + _sums(pair, np.repeat(train, size)) / np.repeat(prior * unigram, size))
        got, a = [], 0
        for parcel, buffer, x in zip(parcels, docs, sizes):
            n = int(x.sum())
            doc = np.frombuffer(buffer, f"u{len(buffer) // n}")
            total = np.bincount(doc, value[a : a + n])
            at = np.flatnonzero(total)
            if len(at):
                got.append((parcel, kind, at.astype(np.uint16 if len(total) <= 1 << 16 else np.uint32).tobytes(), total[at].astype(np.float32).tobytes()))
            a += n
        columns = list(zip(*got)) or [[]] * 4
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("parcel", "kind", "doc", "value"), columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))})

    return run


def _opened(rows: pa.Table) -> pa.Table:
    """The sums of a parcel's documents, by their signatures."""
    kind = rows["kind"].to_numpy()
    documents = np.frombuffer(rows["doc"][int(np.flatnonzero(kind == _DOCS)[0])].as_buffer(), np.int64)
    total = np.zeros(len(documents))
    for i in np.flatnonzero(kind != _DOCS):
        value, buffer = np.frombuffer(rows["value"][int(i)].as_buffer(), np.float32), rows["doc"][int(i)].as_buffer()
        total[np.frombuffer(buffer, f"u{len(buffer) // len(value)}")] += value
    return pa.table({"signature": pa.array(documents), "pairs": pa.array(total)})


def _pairs(rows: DataFrame, model, m: LmModel, tokens: int) -> DataFrame:
    """(signature, pairs) of every different text of rows (held_out, text): what counts of pairs of words add to its score."""
    bits = max(6, math.ceil(math.log2(max(1, tokens) / _BUCKET)))
    sent = rows.select("held_out", "text").mapInArrow(lean(_sent(model, bits)), _PARCELS)
    answers = sent.groupBy("kind", "bucket").applyInArrow(_answered(m.suffix_norm, m.params.unigram_counts), _ANSWERS)
    # Equal texts in several parcels have equal sums but for their rounding.
    return answers.groupBy("parcel").applyInArrow(_opened, "signature long, pairs double").groupBy("signature").agg(F.max("pairs").alias("pairs"))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LmModel = model.value
        p, numbers = m.params, task_rows()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            n = np.zeros((4, len(texts)))
            rare: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            signatures = np.zeros(len(texts), np.uint64)
            for h, doc, first, last in _chunks(texts, p):
                at, held = m.find(h)
                c = np.where(held, m.held_c[at] if len(m.held) else 0, 0)
                half = np.where(held, np.log10(c + 0.5), 0.0)
                cls, place, features = _contexts(m, h, doc)
                value = np.concatenate([_class_and_place(m, *x) for x in _slices(cls, place, features)])
                other, before = np.flatnonzero(place < 0), _before(m, cls, place, doc)
                # The other words: (c + 0.5) over their class; of words not held the count comes later.
                value[other] += half[other] - m.suffix_norm[(h[other] & _SUFFIX).astype(np.int64)] / _LOG10
                after = other[before[other] >= 0]
                value[after] -= np.log10(1 + m.after[before[after], cls[after] - p.frequent_classes] / p.unigram_counts)
                for k, x in enumerate((None, held, half, value)):
                    n[k, first:last] = np.bincount(doc - first, x, last - first)
                signatures[first:last] = _signatures(h, doc, first, last)
                rest = np.flatnonzero(~held)
                rest = rest[np.lexsort((h[rest], doc[rest]))]
                x, d = h[rest], doc[rest]
                new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (d[1:] != d[:-1])])) if len(rest) else rest
                rare.append((x[new].view(np.int64), np.diff(np.append(new, len(rest))), d[new]))
            h, k, d = (np.concatenate([np.zeros(0, np.int64), *(r[i] for r in rare)]) for i in range(3))
            lengths = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(texts)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(lengths, pa.array(x)) for x in (h, k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(numbers) for _ in texts], pa.int64()), *batch.columns[:2], pa.array(n[0].astype(np.int64)), pa.array(n[1].astype(np.int64)), pa.array(n[2]), pa.array(n[3]), pa.array(signatures.view(np.int64)), *lists],
                ["row", "key", "held_out", "n_tokens", "held", "base", "model", "signature", "h", "k"],
            )

    return run


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", params: LmParams = LmParams()) -> DataFrame:
    """Scores of every row by models learned from the rows that aren't held out (crc32 of the key as text, mod 5, is not 1; a null key counts as empty).

    Returns key, held_out, n_tokens (words and one end), n_known, train_tokens,
    base_score and score (log10 probabilities of the text under the add-half
    unigram and under the model). A null or empty text is the end alone.
    Without training rows the unigram gives every token probability 1. Texts of
    any length are learned from and scored whole, a chunk at a time; of equally
    frequent words those with the smaller hash are modelled first. Repeated
    rows count and are scored each; other columns are ignored; an empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), _held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text"))
    learn = rows.where(~F.col("held_out"))
    counts = count_words(learn, params)
    m = train(learn, counts, params)
    shared = docs.sparkSession.sparkContext.broadcast(m)
    done = rows.mapInArrow(lean(_scored(shared)), f"row long, key {kind}, held_out boolean, n_tokens long, held long, base double, model double, signature long, h array<long>, k array<long>")
    done = materialize(done, "lm-scored")
    rest = done.where(F.size("h") > 0).select("row", F.explode(F.arrays_zip("h", "k")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.k").alias("k"))
    rest = rest.join(counts.select("h", "c"), "h", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("seen")
    )
    norm = math.log10(m.tokens + 0.5 * (m.distinct + 1))
    out = done.drop("h", "k").join(rest, "row", "left")
    if m.tokens:
        pairs = materialize(_pairs(rows, shared, m, done.agg(F.sum("n_tokens")).first()[0]), "lm-pairs")
        out = out.join(pairs, "signature", "left")
    else:
        out = out.withColumn("pairs", F.lit(0.0))
    extra = F.coalesce("rest", F.lit(0.0))
    return out.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("held") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(m.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("model") + extra + F.coalesce("pairs", F.lit(0.0))).alias("score"),
    )
