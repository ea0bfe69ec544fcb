"""op6: language of every document, learned from three quarters of the labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..language_id import fit, predict

NAME = "op6_language_id"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = fit(docs.where(~held_out))
    return predict(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))


#: Learned from data by hashing; tests measure accuracy on held-out documents and compare with a plain version.
ORACLE = None
