"""Building an index from passages."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import RetrievalConfig
from .operators import codec as coding
from .operators import encode, kmeans, planning, ranking
from .operators.tokenize import Tokens
from .shared import remove
from .sources import checkpoint, store
from .sources import passages as readers


class Indexer:
    """index() encodes, clusters, compresses and stores a collection.

    collection: (pid, text) rows with pids from 1 without gaps, a path of text
    lines, or a list of strings. Tokenizer and encoder are the configured
    checkpoint's unless others are given.
    """

    def __init__(
        self, spark: SparkSession, config: RetrievalConfig, collection: DataFrame | list[str] | None = None, encoder: encode.Encoder | None = None, seed: int = 0, tokens: Tokens | None = None
    ) -> None:
        self.spark, self.config, self.seed = spark, config, seed
        self.tokens, self.encoder = (tokens, encoder) if encoder else checkpoint.load(config)
        if collection is None:
            collection = readers.lines(spark, config.collection)
        self.passages = readers.strings(spark, collection) if isinstance(collection, list) else collection

    def _encoded(self, passages: DataFrame) -> DataFrame:
        return encode.encode_passages(passages, self.encoder, self.config, self.tokens)

    def index(self) -> bool | None:
        """Whether the finished index is complete; None, and nothing done, if the path exists already."""
        spark, config, path = self.spark, self.config, self.config.index_path
        if store.exists(spark, path):
            return None
        passages, count = self.passages, self.passages.count()
        pids = planning.sample_pids_by_hash(passages, planning.sample_size(count), self.seed)
        # Numbering the sample: (pid, pos) is its stable identity. It is a table of its own, so that a lost executor costs no new sample.
        drawn = f"{path}/_sample"
        self._encoded(passages.join(pids, "pid", "left_semi")).withColumn("eid", F.concat_ws("/", "pid", "pos")).write.mode("overwrite").parquet(drawn)
        sample = spark.read.parquet(drawn)
        vectors, sampled = sample.count(), pids.count()
        train, heldout = planning.heldout_split(sample, planning.heldout_size(vectors), "eid", self.seed)
        average = vectors / sampled if sampled else 0.0
        plan = planning.plan(count, average, vectors - planning.heldout_size(vectors), config.chunksize, config.nranks)
        store.save_config(spark, path, config)
        store.save_record(spark, path, "plan", plan)

        # Equal vectors are one weighted point, in a table of its own that every step reads on all cores.
        first = kmeans.first_centroids(train, plan["num_partitions"], seed=self.seed)
        points = f"{path}/_points"
        kmeans.distinct(train).repartition(2 * spark.sparkContext.defaultParallelism).write.mode("overwrite").parquet(points)
        centroids, _, _ = kmeans.fit(spark.read.parquet(points), first, count="n", max_iters=config.kmeans_niters)
        codec = coding.fit(coding.residuals(coding.codes(heldout, centroids), centroids), config.nbits)
        store.save_codec(spark, path, centroids, codec)
        remove(spark, drawn)
        remove(spark, points)

        staged = f"{path}/_staged"
        coding.compress(self._encoded(passages), *store.load_codec(spark, path)).write.mode("overwrite").parquet(staged)
        write(spark, path, spark.read.parquet(staged), passages, {**plan, "num_documents": count})
        remove(spark, staged)
        return store.is_complete(spark, path)


def write(spark: SparkSession, path: str, coded: DataFrame, passages: DataFrame, plan: dict[str, float | int]) -> None:
    """Lengths, chunks, compressed rows and postings of coded embeddings (pid, pos, code, residual), and the finished plan.

    The planned average only sized the index; lengths and offsets are the real ones.
    """
    chunk = store.chunk_of(F.col("pid"), int(plan["chunksize"]))
    encode.doclens(passages, coded).sortWithinPartitions("pid").write.mode("overwrite").parquet(f"{path}/doclens")
    lengths = spark.read.parquet(f"{path}/doclens")
    chunks = lengths.groupBy(chunk.alias("chunk_id")).agg((F.min("pid") - 1).alias("passage_offset"), F.count(F.lit(1)).alias("num_passages"), F.sum("doclen").alias("num_embeddings"))
    store.save_chunk_table(planning.offsets(chunks), path)
    # Embedding ids follow (pid, pos): the pid's block of ids, entered by position.
    place = coded.withColumn("_n", F.row_number().over(Window.partitionBy("pid").orderBy("pos")))
    ids = ranking.emb2pid(lengths).withColumn("_n", F.row_number().over(Window.partitionBy("pid").orderBy("eid")))
    store.save_chunks(place.join(ids, ["pid", "_n"]).select("eid", "pid", "code", "residual", chunk.alias("chunk_id")), path)
    stored = store.load_compressed(spark, path)
    total = stored.count()
    store.save_postings(stored, path, int(plan["num_partitions"]), total)
    count = int(plan["num_documents"])
    store.save_record(spark, path, "plan", {**plan, "num_chunks": math.ceil(count / plan["chunksize"]), "num_embeddings": total, "avg_doclen": total / count if count else 0.0})
