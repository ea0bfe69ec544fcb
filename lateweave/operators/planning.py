"""Sampling passages, splitting off held-out vectors, and sizing an index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sample_size(passages: int) -> int:
    """Draws for a collection of so many passages."""
    return min(1 + math.floor(16 * math.sqrt(120 * passages)), passages)


def sample_pids(spark: SparkSession, passages: int, seed: int = 0) -> DataFrame:
    """Distinct pids of sample_size() draws with replacement from 1 .. passages."""
    draws = spark.range(sample_size(passages))
    return draws.select((F.floor(F.rand(seed) * passages) + 1).alias("pid")).distinct()


#: Hexadecimal digits of a hash that rows are counted by: 65,536 counts.
DIGITS = 4


def hash_order(key: Column, seed: int = 0) -> Column:
    """A pseudo-random order of keys that any engine with md5 can repeat."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), key.cast("string")))


def first_by_hash(rows: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """The ``size`` rows that come first in hash order, with their hash ``_h``; rows of one hash go by key.

    Rows are counted by the hash's first digits. Those below the digits where
    the size is reached are kept in place, and only the few that share these
    are sorted: no task gets more than its own part of the rows.
    """
    marked = rows.withColumn("_h", hash_order(F.col(key), seed))
    counts = sorted((r["d"], r["count"]) for r in marked.groupBy(F.substring("_h", 1, DIGITS).alias("d")).count().collect() if r["d"] is not None)
    before = 0
    for digits, n in counts:
        if before + n >= size:
            rest = marked.where(F.substring("_h", 1, DIGITS) == digits).orderBy("_h", key).limit(size - before)
            return marked.where(F.col("_h") < digits).unionByName(rest)
        before += n
    return marked


def sample_pids_by_hash(passages: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """The pids that come first in hash order."""
    return first_by_hash(passages.select("pid"), "pid", size, seed).select("pid")


def heldout_size(vectors: int, share: float = 0.05, most: int = 50_000) -> int:
    return max(1, math.floor(min(most, share * vectors)))


def heldout_split(sample: DataFrame, size: int, key: str = "eid", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, held out): the first ``size`` rows in hash order are held out."""
    marked = sample.withColumn("_h", hash_order(F.col(key), seed))
    last = first_by_hash(sample.select(key), key, size, seed).select("_h", F.col(key).alias("_k"))
    # The usual 50,000 keys are a few MB; the vectors stay where they are.
    last = F.broadcast(last) if size <= 100_000 else last
    on = (marked["_h"] == last["_h"]) & (marked[key] == last["_k"])
    return marked.join(last, on, "left_anti").drop("_h"), marked.join(last, on, "left_semi").drop("_h")


def default_chunksize(passages: int, nranks: int = 1) -> int:
    return min(25_000, 1 + passages // nranks)


#: Clusters of an index at most: their centroids are broadcast, 256 MB of them at 128 dimensions. A collection reaches this at 268 million vectors.
MOST_CLUSTERS = 1 << 18


def plan(passages: int, average_doclen: float, train_vectors: int, chunksize: int | None = None, nranks: int = 1) -> dict[str, float | int]:
    """Chunks, estimated vectors and number of clusters of an index."""
    chunksize = default_chunksize(passages, nranks) if chunksize is None else chunksize
    estimate = passages * average_doclen
    clusters = 2 ** math.floor(math.log2(16 * math.sqrt(estimate))) if estimate > 0 else 1
    return {
        "chunksize": chunksize,
        "num_chunks": -(-passages // chunksize),
        "num_documents": passages,
        "avg_doclen_est": average_doclen,
        "num_embeddings_est": estimate,
        "num_partitions": max(1, min(train_vectors, clusters, MOST_CLUSTERS)),
    }


def offsets(chunks: DataFrame, count: str = "num_embeddings", order: str = "chunk_id") -> DataFrame:
    """chunks with embedding_offset: 1 + the sum of the counts before. For chunk-sized tables: one row per chunk."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("embedding_offset", F.coalesce(F.sum(count).over(before), F.lit(0)) + 1)


def head(values: Column) -> Column:
    """All but the last entry of an array; of an empty one nothing."""
    return F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0)))
