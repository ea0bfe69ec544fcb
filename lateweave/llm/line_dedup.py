"""Line deduplication by winnowing over line hashes.

A window is a shortest run of consecutive lines with at least ``min_words``
words that starts, or ends, at a given line. Winnowing selects the line with
the smallest hash of every window as its fingerprint: equal runs contain equal
windows, and what a window selects depends on its lines alone, so that every
repeated run of min_words words or more shares a fingerprint. Most lines never
become one.

1. One pass over the texts leaves line hashes and selected positions.
2. Positions are joined by fingerprint: one that a single document has goes.
3. From every position that is left the match is extended to the left and to
   the right as far as a window reaches that selected it, and each extension is
   joined by the hash of its lines with the first document that has it.
4. Extensions that touch or overlap are one repeated run, which is deleted
   where it comes later; the first document keeps its lines.

No pairs of occurrences are formed: an extension meets one row, its first
document. A run repeated inside its own document is found in the first pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import brief, lean, materialize, small_batches, task_rows
from .word_hash import mix, powers

MIN_WORDS = 50

_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_EDGES = " \t\n\x0b\x0c\r"


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and word counts of the lines with a word, and their numbers among all lines; last of these the number of all lines."""
    hashes, words, number = [], [], []
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if n := len(_WORD.findall(line)):
            hashes.append(xxhash.xxh3_64_intdigest(line.strip(_EDGES)))
            words.append(n)
            number.append(i)
    return np.array(hashes, np.uint64), np.array(words, np.int64), np.array([*number, len(lines)], np.int64)


def windows(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and last + 1 of every window, in order."""
    total = np.concatenate([[0], np.cumsum(words)])
    stops = np.searchsorted(total, total[:-1] + min_words)
    begins = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    a = np.concatenate([np.flatnonzero(stops <= len(words)), begins[begins >= 0]])
    b = np.concatenate([stops[stops <= len(words)], np.flatnonzero(begins >= 0) + 1])
    both = np.unique(a * (len(words) + 1) + b)
    return both // (len(words) + 1), both % (len(words) + 1)


def selected(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The line with the smallest hash in each window; of equals the first."""
    out, level, width = np.zeros(len(a), np.int64), np.arange(len(hashes)), 1
    while True:
        fits = (b - a >= width) & (b - a < 2 * width)
        left, right = level[a[fits]], level[b[fits] - width]
        out[fits] = np.where(hashes[left] <= hashes[right], left, right)
        if not (b - a >= 2 * width).any():
            return out
        # From the smallest of ``width`` lines to that of twice as many.
        left, right = level[:-width], level[width:]
        level = np.where(hashes[left] <= hashes[right], left, right)
        width *= 2


def window_hashes(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of each window's lines."""
    up, down = powers(len(hashes))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * up[:-1])])
        return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def _repeats(h: np.ndarray) -> np.ndarray:
    """Whether a hash stands earlier in its array too."""
    out = np.ones(len(h), bool)
    out[np.unique(h, return_index=True)[1]] = False
    return out


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts).astype(kind.to_pandas_dtype()) if parts else [], kind))


def _scan(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = task_rows()
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(2)):
                hashes, words, number = lines_of(text.as_py() or "")
                if words.sum() < min_words:
                    continue
                a, b = windows(words, min_words)
                again = _repeats(window_hashes(hashes, a, b))
                rows.append(i)
                p = np.unique(selected(hashes, a, b))
                found.append((hashes.view(np.int64), words, number, p, hashes[p].view(np.int64), number[a[again]], number[b[again]] - 1))
            columns = [_lists([x[k] for x in found], pa.int64() if k in (0, 4) else pa.int32()) for k in range(7)]
            head = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([pa.array([next(row) for _ in rows], pa.int64()), *head, *columns], ["row", "key", "th", "h", "w", "at", "p", "f", "first", "last"])

    return run


def _extended(min_words: int):
    """The windows that selected one of the given positions: h, key, th, first and last line. A window that its document repeats stands once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, h, first, last = [], [], [], []
            for i in range(len(batch)):
                hashes, words, number, at = (batch.column(k)[i].values.to_numpy() for k in (2, 3, 4, 5))
                hashes = hashes.view(np.uint64)
                a, b = windows(words.astype(np.int64), min_words)
                name = window_hashes(hashes, a, b)
                keep = np.isin(selected(hashes, a, b), at) & ~_repeats(name)
                a, b = a[keep], b[keep]
                rows.append(np.full(len(a), i))
                h.append(name[keep].view(np.int64))
                first.append(number[a])
                last.append(number[b] - 1)
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(h)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(first), pa.int32()), pa.array(np.concatenate(last), pa.int32())],
                    ["h", "key", "th", "first", "last"],
                )

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs of a document's deleted spans, as the segments between them."""
    for batch in batches:
        starts, sizes = [], []
        for spans in batch.column(2).to_pylist():
            a, n, at = [], [], 0
            for first, last in sorted((s["first"], s["last"]) for s in spans):
                if first > at:
                    a.append(at)
                    n.append(first - at)
                at = max(at, last + 1)
            starts.append([*a, at])
            sizes.append([*n, (1 << 31) - 1 - at])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], ["key", "th", "starts", "sizes"])


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Documents with deleted lines: key, th (hash of the text), starts and sizes of the kept segments of lines."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).cast("string").alias("text"))
    lines = f"row long, key {kind}, th long, h array<long>, w array<int>, at array<int>, p array<int>, f array<long>, first array<int>, last array<int>"
    lines = materialize(rows.mapInArrow(lean(_scan(min_words)), lines), "lines-selected")

    # Positions by fingerprint. A null key has no order among documents.
    places = lines.where(F.col("key").isNotNull()).select("row", "key", F.explode(F.arrays_zip("p", "f")).alias("x")).select("row", "key", "x.*")
    shared = places.groupBy("f").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("f")
    shared = materialize(shared, "lines-prints")
    joined = materialize(places.join(brief(shared), "f", "left_semi").groupBy("row").agg(F.collect_list("p").alias("x")), "lines-places")

    again = lines.join(brief(joined, arrays=("x",)), "row").select("key", "th", "h", "w", "at", "x")
    across = materialize(again.mapInArrow(lean(_extended(min_words)), f"h long, key {kind}, th long, first int, last int"), "lines-extended")
    origin = materialize(across.groupBy("h").agg(F.min("key").alias("o"), F.max("key").alias("z")).where("o < z").select("h", "o"), "lines-origins")
    later = across.join(brief(origin), "h").where(F.col("key") > F.col("o")).select("key", "th", "first", "last")
    inside = lines.where(F.size("first") > 0).select("key", "th", F.explode(F.arrays_zip("first", "last")).alias("x")).select("key", "th", "x.*")
    spans = later.unionByName(inside).groupBy("key", "th").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return spans.mapInArrow(lean(_kept), f"key {kind}, th long, starts array<int>, sizes array<int>")


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeated runs deleted from ``text``, and ``n_removed`` (lines deleted, blank ones among them included).

    A run is deleted if it has min_words words or more and an equal run stands
    in a document of a smaller key, or earlier in its own document. Lines are
    compared without white space at their ends; lines without a word neither
    part nor prolong a run, and go with the line before them. Rows that share a
    key count as one document and don't delete each other, repeated rows
    neither; a null key only meets its own lines. Null and empty texts stay as
    they are, however long others are; texts without repeats, the other columns
    and the order of lines stay as they are, but a column n_removed of the
    input gives way to the new one. An empty table gives an empty result.
    """
    kept = materialize(repeated_spans(docs, key=key, text=text, min_words=min_words), "lines-kept")
    # Columns by position: none of the input's names can clash with those used here.
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    k, t = (f"c{docs.columns.index(c)}" for c in (key, text))
    joined = inner.join(brief(kept, arrays=("starts", "sizes")), F.col(k).eqNullSafe(F.col("key")) & (F.xxhash64(t) == F.col("th")), "left")
    hit = F.col("starts").isNotNull()
    joined = joined.withColumn("lines", F.when(hit, F.split(t, "\n", -1)))
    segments = F.zip_with("starts", "sizes", lambda a, n: F.slice(F.col("lines"), a + 1, n))
    joined = joined.withColumn("left", F.when(hit, F.flatten(segments)))
    return joined.select(
        *[(F.when(hit, F.array_join("left", "\n")).otherwise(F.col(f"c{i}")) if f"c{i}" == t else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns) if c != "n_removed"],
        F.when(hit, F.size("lines") - F.size("left")).otherwise(0).cast("long").alias("n_removed"),
    )
