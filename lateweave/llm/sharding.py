"""Rendezvous hashing of stable record keys over weighted shards (DataFrame functions only).

Every (key, shard) pair draws one pseudo-random number u in (0, 1); the record
goes to the shard with the largest -weight / ln(u). Key and shard set alone
decide, so a further shard only takes records into itself: all other pairs
keep their draws. Nothing is exchanged to place a record. A shard's share is
proportional to its weight.

Numbering records inside a shard is a global problem, and no shard fits one
task: the narrow (key, size, checksum) rows are range-partitioned by
(shard, key, ...), numbered inside each range, and shifted by the ranges' counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_width

#: 13 hex digits of md5 make an exact double.
_DRAWS = float(16**13)


def _score(key: Column, shard: int, weight: float) -> Column:
    draw = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, 13), 16, 10).cast("double")
    return F.lit(-float(weight)) / F.log((draw + 0.5) / F.lit(_DRAWS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int) of a key. A null key counts as the empty text; shards of weight 0 get nothing.

    Equal scores go to the lower shard number.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    text = F.coalesce(key.cast("string"), F.lit(""))
    ranked = [F.struct(_score(text, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*ranked))["i"]).cast("int")


def both(key: Column, weights: Sequence[float], extra: float) -> tuple[Column, Column]:
    """The shard of a key now and with one more shard of weight ``extra``, from the same draws."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    ranked = [F.struct(_score(text, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]
    best = F.array_max(F.array(*ranked))
    more = F.struct(_score(text, len(weights), extra).alias("s"), F.lit(-len(weights)).alias("i"))
    return (-best["i"]).cast("int"), (-F.greatest(best, more)["i"]).cast("int") if extra > 0 else (-best["i"]).cast("int")


def place(docs: DataFrame, weights: Sequence[float], *, key: str = "doc_id", text: str = "text", extra: float | None = None) -> DataFrame:
    """Shard and gapless slot of every row.

    Returns key, size (UTF-8 bytes of the text, null: none, plus 16 for the
    record's header), text_crc32, shard, slot, grown_shard (with one more shard
    of weight ``extra``, the mean weight by default). Slots follow (key,
    text_crc32, size), null keys first; fully equal rows get neighbouring
    slots in any order. Texts of any length count whole; an empty text has the
    header's 16 bytes; a null key counts as the empty text. An empty table gives
    an empty result; columns of other names are ignored.
    """
    spark = docs.sparkSession
    extra = sum(weights) / len(weights) if extra is None else extra
    body = F.coalesce(F.col(text), F.lit(""))
    shard, grown = both(F.col(key), weights, extra)
    base = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(body).cast("long") + 16).alias("_size"),
        F.crc32(body.cast("binary")).alias("_crc"),
        shard.alias("_shard"),
        grown.alias("_grown"),
    )
    # A written table: the range sampler and the numbering read the same rows, and the texts only once.
    base = materialize(base, "sharding-rows").withColumn("_tie", F.monotonically_increasing_id())
    dealt = base.repartitionByRange(shuffle_width(spark), "_shard", "_key", "_crc", "_size", "_tie").withColumn("_part", F.spark_partition_id())
    order = Window.partitionBy("_part").orderBy("_shard", F.col("_key").asc_nulls_first(), "_crc", "_size", "_tie")
    ranked = materialize(dealt.withColumn("_at", F.row_number().over(order).cast("long") - 1).drop("_tie"), "sharding-ranked")

    # One row per (range, shard): where its rows start among the shard's rows.
    pieces = ranked.groupBy("_shard", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_shard", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return ranked.join(pieces, ["_shard", "_part"]).select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        (F.col("_at") + F.col("_shift")).alias("slot"),
        F.col("_grown").alias("grown_shard"),
    )
