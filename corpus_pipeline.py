"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Each stage is f(spark, docs, sf_dir) -> DataFrame; its result is written as
Parquet and read again as the next stage's docs.

Stages decide by row: rows are told apart by doc_id, null included, together
with a hash of the text, so that a rejected row takes no other row of its
doc_id with it. Rows equal in both share every decision. Texts may be of any
length; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateweave.llm.common import brief, materialize, table
from lateweave.llm.decontamination import decontaminate
from lateweave.llm.line_dedup import dedup_lines
from lateweave.llm.ngram_join import link_components
from lateweave.llm.packing import pack
from lateweave.llm.quality_rules import judge
from lateweave.shared import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that neither the base rules nor the learned decision list reject.

    The verdict depends on the text alone (labels only teach, by doc_id); null
    and empty texts fail the base rules and go; repeated rows stay or go together.
    """
    judged = judge(docs, table(spark, sf_dir, "labels")).where("NOT kept")
    return _without(docs, judged.select(F.col("doc_id").alias("_k"), F.col("th").alias("_th")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without later repeated runs of lines; a row of which nothing but white space is left goes. n_chars follows the text.

    Rows of one doc_id count as one document, and a null doc_id only meets its
    own lines. A text that was null or blank before stays as it is.
    """
    left = dedup_lines(docs)
    left = left.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every component of near-duplicates: that of the smallest doc_id (null last), of several the smallest hash of its text.

    Of rows equal in both the one with the smallest other columns stays. Rows
    without a word are linked with nothing, and all stay.
    """
    found = materialize(link_components(docs).where("root IS NOT NULL").select("doc_id", "th", "root"), "pipeline-linked")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))
    groups = materialize(found.groupBy("root").agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "pipeline-groups")
    members = found.join(brief(groups), "root")
    chosen = F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("th") == F.col("m.th"))
    left = _without(docs, members.where(~chosen).select(F.col("doc_id").alias("_k"), F.col("th").alias("_th")))
    keys = members.where(chosen).groupBy(F.col("doc_id").alias("_k"), F.col("th").alias("_th")).agg(F.count(F.lit(1)).alias("n"))
    again = materialize(keys.where("n > 1").drop("n"), "pipeline-repeated")
    if again.isEmpty():
        return left
    same = left.join(brief(again), left["doc_id"].eqNullSafe(again["_k"]) & (F.xxhash64(left["text"]) == again["_th"]), "left_semi")
    once = same.groupBy("doc_id", F.xxhash64("text")).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return _without(left, again).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item; null and empty texts leak nothing; repeated rows stay or go together."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 2048 tokens; a null or empty text is an end id; repeated rows are packed each by itself."""
    return pack(docs)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs whose doc_id and hash of the text are not among the rows (_k, _th). Few rows are broadcast, so that texts stay where they are; many are joined by a shuffle."""
    gone = materialize(rows.distinct(), "pipeline-gone")
    return docs.join(brief(gone), docs["doc_id"].eqNullSafe(gone["_k"]) & (F.xxhash64(docs["text"]) == gone["_th"]), "left_anti")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Learned rules, shingles over whole texts and the tokenizer have no SQL form; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
