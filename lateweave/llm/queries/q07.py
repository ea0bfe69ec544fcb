"""op7: later repeated runs of lines deleted from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..line_dedup import dedup_lines

NAME = "op7_line_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


#: Winnowed windows have no practical SQL form; tests compare with a brute-force search over all runs.
ORACLE = None
