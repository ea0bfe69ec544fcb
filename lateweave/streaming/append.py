"""Append-only indexing of a stream of passages: every micro-batch becomes a chunk of compressed embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import codec as coding
from ..operators import encode
from ..operators.tokenize import Tokens
from ..sources import checkpoint as models
from ..sources import store


def append_stream(passages: DataFrame, index_path: str, target: str, checkpoint: str, encoder: encode.Encoder | None = None, tokens: Tokens | None = None) -> StreamingQuery:
    """Encode and compress a stream (pid, text) with an index's centroids and codec into Parquet below target.

    A batch overwrites its own partition, so a replayed batch leaves no duplicates.
    """
    spark = passages.sparkSession
    config = store.load_config(spark, index_path)
    centroids, codec = store.load_codec(spark, index_path)
    names, model = (tokens, encoder) if encoder else models.load(config)

    def write(batch: DataFrame, number: int) -> None:
        coded = coding.compress(encode.encode_passages(batch, model, config, names), centroids, codec)
        coded.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return passages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
