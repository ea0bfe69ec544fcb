"""op9: all documents over 40 equal shards by rendezvous hashing (law `key`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..sharding import place
from .crc import crc_sql

NAME = "op9_rendezvous_sharding"
SHARDS = 40


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


ORACLE = f"""
WITH crc AS (SELECT doc_id, coalesce(text, '') AS t, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
draws AS (
  SELECT doc_id, i, -1.0 / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(16**13)}) AS s
  FROM (SELECT DISTINCT doc_id FROM documents), range(0, {SHARDS + 1}) r(i)),
placed AS (
  SELECT doc_id, arg_max(i, s) FILTER (i < {SHARDS})::INTEGER AS shard, arg_max(i, s)::INTEGER AS grown_shard FROM draws GROUP BY doc_id)
SELECT c.doc_id, (octet_length(encode(t)) + 16)::BIGINT AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY c.doc_id, text_crc32) - 1 AS slot, grown_shard
FROM crc c JOIN placed p ON c.doc_id = p.doc_id
"""
