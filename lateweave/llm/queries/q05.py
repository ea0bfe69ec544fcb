"""op5: documents that leak benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..decontamination import find_leaks

NAME = "op5_benchmark_decontamination"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.col("item").alias("item_id"), F.col("item_words").cast("int").alias("item_words"), F.col("covered_words").cast("int").alias("covered_words"), "changed")


#: Templates by Java patterns have no SQL form of the same meaning; tests compare with plain versions and planted cases.
ORACLE = None
