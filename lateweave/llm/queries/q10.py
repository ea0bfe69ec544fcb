"""op10: token counts of all documents, read off flat token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..token_files import document_token_counts

NAME = "op10_token_counts"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = document_token_counts(table(spark, sf_dir, "documents"))
    # A file's name without the mark of the attempt that wrote it.
    return counts.select("doc_id", "n_tokens", F.regexp_extract("path", r"part-\d+", 0).alias("file"), "start")


#: Tokenising has no SQL form; tests check the round trip against the tokenizers library.
ORACLE = None
