"""An index on storage: Parquet tables and JSON records, written and read by Spark alone.

Below the index path: config, plan, codec (JSON records), centroids, doclens,
chunks, compressed (a partition for each chunk, in eid order) and ivf (postings
in partitions of successive codes, in code order). A search names the chunks
and the ranges of codes that it needs, so that Spark reads no other partition.
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..operators.codec import Codec
from ..shared import remove

TABLES = ("centroids", "doclens", "chunks", "compressed", "ivf")
RECORDS = ("config", "plan", "codec")

#: Embeddings to a range of codes, and ranges at most.
POSTINGS, RANGES = 4_000_000, 4096


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def exists(spark: SparkSession, path: str) -> bool:
    return _there(spark, path)


def save_record(spark: SparkSession, path: str, name: str, value: dict[str, Any]) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def load_record(spark: SparkSession, path: str, name: str) -> dict[str, Any]:
    if not _there(spark, f"{path}/{name}/_SUCCESS"):
        raise FileNotFoundError(f"{path}/{name}")
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/{name}").collect()))


def save_config(spark: SparkSession, path: str, config: RetrievalConfig) -> None:
    save_record(spark, path, "config", json.loads(config.to_json()))


def load_config(spark: SparkSession, path: str) -> RetrievalConfig:
    return RetrievalConfig.from_json(json.dumps(load_record(spark, path, "config")))


def save_codec(spark: SparkSession, path: str, centroids: DataFrame, codec: Codec) -> None:
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    save_record(spark, path, "codec", {"cutoffs": codec.cutoffs, "weights": codec.weights, "avg_residual": codec.avg_residual})


def load_codec(spark: SparkSession, path: str) -> tuple[DataFrame, Codec]:
    missing = [x for x in ("centroids", "codec") if not _there(spark, f"{path}/{x}/_SUCCESS")]
    if missing:
        raise FileNotFoundError(f"missing in {path}: {', '.join(missing)}")
    found = load_record(spark, path, "codec")
    return spark.read.parquet(f"{path}/centroids"), Codec(tuple(found["cutoffs"]), tuple(found["weights"]), found["avg_residual"])


def chunk_of(pid: Column, chunksize: int) -> Column:
    """The chunk (from 1) of a passage."""
    return (F.floor((pid - 1) / chunksize) + 1).cast("int")


def save_chunks(compressed: DataFrame, path: str, whole: bool = True) -> None:
    """Every chunk's rows. With whole = False only the chunks among the rows are replaced (and _SUCCESS stays as it was)."""
    mode = "static" if whole else "dynamic"
    # A chunk's rows come together, a million ids to a task at most: else every task would write a file for every chunk.
    dealt = compressed.repartition("chunk_id", F.floor(F.col("eid") / 1_000_000))
    dealt.sortWithinPartitions("chunk_id", "eid").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("chunk_id").parquet(f"{path}/compressed")


def load_compressed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/compressed")


def load_codes(spark: SparkSession, path: str) -> DataFrame:
    """(eid, code): the residuals are not read."""
    return load_compressed(spark, path).select("eid", "code")


def code_span(clusters: int, embeddings: int) -> int:
    """Codes to a partition of the postings: about POSTINGS embeddings each, in at most RANGES partitions."""
    return math.ceil(clusters / max(1, min(RANGES, clusters, math.ceil(embeddings / POSTINGS))))


def save_postings(compressed: DataFrame, path: str, clusters: int, embeddings: int) -> None:
    """The inverted file: (code, eid, pid) in partitions of successive codes, each in code order."""
    rows = compressed.select(F.floor((F.col("code") - 1) / code_span(clusters, embeddings)).cast("int").alias("codes"), "code", "eid", "pid")
    rows.repartitionByRange("codes", "code", "eid").sortWithinPartitions("codes", "code", "eid").write.mode("overwrite").partitionBy("codes").parquet(f"{path}/ivf")


def load_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/ivf")


def load_doclens(spark: SparkSession, path: str) -> DataFrame:
    """(pid, doclen); an error if they don't add up to the plan's number of embeddings."""
    plan = load_record(spark, path, "plan")
    found = spark.read.parquet(f"{path}/doclens")
    total = found.agg(F.coalesce(F.sum("doclen"), F.lit(0))).first()[0]
    if total != plan["num_embeddings"]:
        raise ValueError(f"doclens add up to {total}, the plan has {plan['num_embeddings']}")
    return found


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The finished tables of chunk properties, oldest first."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/chunks")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(top)) if fs.exists(top) else []
    return [f"{path}/chunks/{x}" for x in names if _there(spark, f"{path}/chunks/{x}/_SUCCESS")]


def save_chunk_table(chunks: DataFrame, path: str) -> None:
    """The chunks' properties as a new version; older ones go when it is finished, so that a failed write loses nothing."""
    spark = chunks.sparkSession
    before = _versions(spark, path)
    number = int(before[-1].rpartition("-")[2]) + 1 if before else 1
    chunks.coalesce(1).write.mode("overwrite").parquet(f"{path}/chunks/v-{number:09}")
    for old in before:
        remove(spark, old)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Properties of every chunk."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(f"{path}/chunks")
    return spark.read.parquet(found[-1])


def chunk_metadata(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One property of every chunk in order; no rows if there are no chunks."""
    return load_chunks(spark, path).select("chunk_id", name).orderBy("chunk_id")


def save_chunk_metadata(spark: SparkSession, path: str, name: str, values: DataFrame) -> None:
    """Set a property (chunk_id, name) of every chunk; an error if the chunks don't match."""
    chunks = load_chunks(spark, path).drop(name)
    given = values.select("chunk_id", name)
    odd = chunks.select("chunk_id", F.lit(1).alias("n")).unionByName(given.select("chunk_id", F.lit(-1).alias("n"))).groupBy("chunk_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("all"))
    if not odd.where("n <> 0 OR all <> 2").isEmpty():
        raise ValueError("there must be one value for each chunk")
    save_chunk_table(chunks.join(given, "chunk_id"), path)


def check_complete(spark: SparkSession, path: str) -> DataFrame:
    """One row per part of an index: (part, present)."""
    rows = [(x, bool(_versions(spark, path)) if x == "chunks" else _there(spark, f"{path}/{x}/_SUCCESS")) for x in (*RECORDS, *TABLES)]
    if dict(rows)["plan"]:
        rows += [(f"chunk {i}", _there(spark, f"{path}/compressed/chunk_id={i}")) for i in range(1, load_record(spark, path, "plan")["num_chunks"] + 1)]
    return spark.createDataFrame(rows, "part string, present boolean")


def is_complete(spark: SparkSession, path: str) -> bool:
    return check_complete(spark, path).where("NOT present").isEmpty()
