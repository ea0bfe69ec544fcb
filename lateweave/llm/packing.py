"""Best-two-fit packing of documents into sequences of bounded length.

Documents become token ids (in Python: the tokenizers are libraries), each
closed by an end id; only documents longer than a sequence are cut. What is
packed afterwards are narrow rows (length and identity), dealt evenly over
buckets of bounded size by a row number, so that neither a hot key nor a group
of copies can fill one bucket. Each bucket is packed by itself:

* fill a sequence greedily, the longest piece that fits first;
* then take its smallest piece out if two unpacked pieces fill the widened gap
  more tightly, and put those in.

A bucket leaves a few sequences partly filled at most, against thousands full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, small_batches, task_rows
from .encoders import encoder

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
#: Pieces to a bucket, on average.
BUCKET = 16_384


def _fit(mask: int, gap: int) -> int:
    """The longest length up to gap whose bit is set; 0: none."""
    return (mask & ((1 << (gap + 1)) - 1)).bit_length() - 1 if gap > 0 and mask & ((1 << (gap + 1)) - 2) else 0


def _pair(mask: int, mirror: int, gap: int, more_than: int, capacity: int, count: list[int]) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum in (more_than, gap]. mirror: mask with bit i at capacity - i."""
    for total in range(gap, more_than, -1):
        both = mask & (mirror >> (capacity - total))
        while both:
            a = both.bit_length() - 1
            both ^= 1 << a
            b = total - a
            if b > 0 and (a != b or count[a] > 1):
                return a, b
    return None


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions in ``lengths``; every length is from 1 to capacity."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in sorted(range(len(lengths)), key=lambda i: -i):
        waiting[lengths[i]].append(i)
    count = [len(w) for w in waiting]
    mask = sum(1 << n for n in range(1, capacity + 1) if count[n])
    mirror = sum(1 << (capacity - n) for n in range(1, capacity + 1) if count[n])

    def move(n: int, by: int) -> None:
        nonlocal mask, mirror
        count[n] += by
        if (count[n] > 0) != bool(mask >> n & 1):
            mask ^= 1 << n
            mirror ^= 1 << (capacity - n)

    bins: list[list[int]] = []
    while mask:
        held: list[int] = []
        gap = capacity
        while n := _fit(mask, gap):
            move(n, -1)
            held.append(n)
            gap -= n
        if gap and len(held) > 1 and (two := _pair(mask, mirror, gap + held[-1], held[-1], capacity, count)):
            move(held.pop(), 1)
            for n in two:
                move(n, -1)
                held.append(n)
        bins.append([waiting[n].pop() for n in held])
    return bins


def _pieces(capacity: int, end_id: int, tokenizer: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        row = task_rows()
        for batch in batches:
            keys, out = batch.column(0), []
            for at, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                out += [(at, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype("<i4") if keep_ids else None) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            rows, piece, start, length, crc, kept = zip(*out) if out else ((),) * 6
            columns = [keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            columns.append(pa.array([next(row) for _ in out], pa.int64()))
            names = ["key", "piece", "start", "length", "ids_crc32", "row"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _bins(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        bins = pack_lengths(rows["length"].tolist(), capacity)
        order = np.concatenate([np.asarray(b) for b in bins])
        sizes = np.array([len(b) for b in bins])
        packed = rows.iloc[order]
        number = np.repeat(np.arange(len(bins)), sizes)
        ends = np.cumsum(packed["length"].to_numpy())
        starts = ends - packed["length"].to_numpy()
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return pd.DataFrame({"row": packed["row"].to_numpy(), "sequence_id": (packed["bucket"].to_numpy() << 32) + number, "offset": starts - np.repeat(starts[first], sizes)})

    return run


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, tokenizer: str = TOKENIZER, bucket: int = BUCKET, keep_ids: bool = False) -> DataFrame:
    """Pack all documents; one row per piece.

    Returns key, piece, start, length, ids_crc32, sequence_id, offset and, with
    keep_ids, the piece's ids. A null or empty text is the end id alone; a
    special token's string in a text is that token. A document longer than
    ``capacity`` is cut so that only its first piece can be shorter, however
    long it is. Repeated rows and null keys are packed like any others, each by
    itself; pieces of one length are taken as they come; other columns are
    ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, row long" + ", ids array<int>" * keep_ids
    pieces = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(lean(_pieces(capacity, end_id, tokenizer, keep_ids)), schema)
    pieces = materialize(pieces, "packing-pieces")
    buckets = max(1, -(-pieces.count() // bucket))
    # Row numbers are written with the pieces; their hash deals them evenly whatever the keys are.
    narrow = pieces.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket"))
    placed = narrow.groupBy("bucket").applyInPandas(_bins(capacity), "row long, sequence_id long, offset long")
    return pieces.join(placed, "row").drop("row").withColumnRenamed("key", key)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (at most a sequence's capacity) from pack(..., keep_ids=True)."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
