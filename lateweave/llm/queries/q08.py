"""op8: all documents packed into sequences of 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..packing import pack

NAME = "op8_best_two_fit_packing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


#: The tokenizer has no SQL form; tests check the packing's laws and the ids against the tokenizers library.
ORACLE = None
