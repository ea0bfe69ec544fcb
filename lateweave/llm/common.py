"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import remove, scratch

#: Words are [^\\x20\\x09-\\x0D]+; what parts them, and one character of a word, as Java patterns.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._scratch)


def brief(table: DataFrame, row: int = 64, arrays: tuple[str, ...] = ()) -> DataFrame:
    """A written table, to be broadcast if its rows (so many bytes each, and 8 for each entry of the arrays) are few bytes in all."""
    size = sum((8 * F.size(a) for a in arrays), F.lit(row))
    return F.broadcast(table) if (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else table


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of at most ``size`` bytes from now on, so that long texts don't add up in a Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= size:
        spark.conf.set(name, str(size))


def most_frequent(counts: DataFrame, most: int, count: str = "c") -> DataFrame:
    """The rows with the largest counts, as many whole classes of counts as make up ``most`` rows at most.

    A class is one count up to 1024 and a thirty-second of an octave beyond, so
    the histogram stays small, and no task sorts or merges candidates.
    """
    size = F.when(F.col(count) <= 1024, F.col(count)).otherwise(F.floor(F.log2(F.col(count)) * 32) + 1024).cast("long")
    left, least = most, None
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        left -= r["n"]
        if left < 0:
            break
        least = r["size"]
    return counts.where(F.lit(False) if least is None else size >= least)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; null text: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving free memory back to the system when a task ends: workers wait for their next task, and should wait small."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            # Only the GNU library has it.
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return lean_run


def shuffle_width(spark: SparkSession) -> int:
    """spark.sql.shuffle.partitions as a number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def task_rows() -> Iterator[int]:
    """Numbers that no other task of the job gives out; a task's rerun gives the same ones."""
    return itertools.count(TaskContext.get().partitionId() << 33)


#: Bytes up to which a measured table is broadcast.
BROADCAST_BYTES = 32 << 20
