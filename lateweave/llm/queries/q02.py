"""op2: quality verdict of every document by a learned decision list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..quality_rules import BASE, judge

NAME = "op2_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept", "rule")


#: Greedy covering over learned thresholds has no SQL form; tests compare with a brute-force version.
ORACLE = None
