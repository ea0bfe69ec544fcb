"""op4: language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..maxent_lm import score

NAME = "op4_lm_scoring"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


#: Trained weights have no SQL form; tests recompute the base exactly and compare scores on held-out documents.
ORACLE = None
