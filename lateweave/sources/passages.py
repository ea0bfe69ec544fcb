"""Readers of passage collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pieces of files whose line counts are broadcast, at most.
SPLITS = 200_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(pid, text): one passage per line, pid = line number from 1 over all files in order of their names.

    A line ends at \\n; a \\r before it is dropped. Lines are counted by piece of
    a file as Spark splits them, and numbered in place from those counts: texts
    are neither moved nor leave the JVM.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r$", "").alias("text"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m")
    )
    # A task reads a piece from its begin to its end, so that its ids are successive.
    pieces = rows.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_f", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_at"))
    few = rows.rdd.getNumPartitions() <= SPLITS
    return rows.join(F.broadcast(pieces) if few else pieces, ["_f", "_b"]).select((F.col("_m") + F.col("_at")).alias("pid"), "text")


def strings(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """(pid, text) of texts in memory."""
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "pid long, text string")


def strip_pid(line: Column) -> Column:
    """The text of a pid<TAB>text line; a line without a tab is all text."""
    return F.when(F.instr(line, "\t") > 0, F.split(line, "\t", 2)[1]).otherwise(line)


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """(pid, text) of pid<TAB>text lines; the pids in the file are kept."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("v"))
    return rows.select(F.split("v", "\t", 2)[0].cast("long").alias("pid"), strip_pid(F.col("v")).alias("text"))


def concatenated(frames: Sequence[DataFrame]) -> DataFrame:
    """Several (text, ...) tables one after another, as one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
