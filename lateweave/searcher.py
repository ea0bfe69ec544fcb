"""Searching a stored index."""

from __future__ import annotations

from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import encode, kmeans, ranking
from .operators.tokenize import Tokens
from .sources import checkpoint, store
from .sources import passages as readers

#: Queries whose vectors are broadcast together, and partitions named in one filter; more of them, and the whole table is joined.
QUERIES, NAMED = 4096, 10_000
#: Query vectors that are probed on the driver, and candidates that are collected there: a few queries take three short jobs.
FEW_VECTORS, FEW_CANDIDATES = 4096, 100_000


class Searcher:
    """Tokenizer and encoder are those of the index's checkpoint unless others are given."""

    def __init__(self, spark: SparkSession, index_path: str, encoder: encode.Encoder | None = None, tokens: Tokens | None = None) -> None:
        if not store.exists(spark, index_path):
            raise FileNotFoundError(index_path)
        self.spark = spark
        self.config = store.load_config(spark, index_path)
        self.plan = store.load_record(spark, index_path, "plan")
        self.centroids, self.codec = store.load_codec(spark, index_path)
        self.compressed = store.load_compressed(spark, index_path)
        self.postings = store.load_postings(spark, index_path)
        self.tokens, self.encoder = (tokens, encoder) if encoder else checkpoint.load(self.config)

    @cached_property
    def _decoder(self) -> Broadcast:
        """((cids, centroids), codec), sent to the workers once."""
        return self.spark.sparkContext.broadcast((kmeans.centroid_matrix(self.centroids), self.codec))

    def _postings(self, codes: list[int]) -> DataFrame:
        """The postings' partitions with these codes; all of them if they are too many to be named."""
        span = store.code_span(int(self.plan["num_partitions"]), int(self.plan["num_embeddings"]))
        parts = {(c - 1) // span for c in codes}
        return self.postings.where(F.col("codes").isin(sorted(parts))) if len(parts) <= NAMED else self.postings

    def _compressed(self, chunks: list[int]) -> DataFrame:
        """The embeddings of these chunks; all of them if they are too many to be named."""
        return self.compressed.where(F.col("chunk_id").isin(sorted(chunks))) if len(chunks) <= NAMED else self.compressed

    def candidates(self, vectors: DataFrame) -> DataFrame:
        """(qid, pid) of the passages in a query's probed clusters; of the postings, only the partitions with such clusters are read."""
        probed = ranking.probe(vectors, self.centroids, self.config.nprobe).select("qid", "cid").distinct().persist()
        codes = probed.select("cid").distinct().limit(NAMED * 100).collect()
        few = len(codes) < NAMED * 100
        return ranking.retrieve(probed, self._postings([r["cid"] for r in codes]) if few else self.postings)

    def embeddings(self, candidates: DataFrame) -> DataFrame:
        """(qid, pid, code, residual) of the candidates; only their chunks are read."""
        chunk = store.chunk_of(F.col("pid"), int(self.plan["chunksize"]))
        chunks = candidates.select(chunk.alias("c")).distinct().limit(NAMED + 1).collect()
        return ranking.gather(self._compressed([r["c"] for r in chunks]), candidates).select("qid", "pid", "code", "residual")

    def search_vectors(self, vectors: DataFrame, k: int) -> DataFrame:
        """(qid, rank, pid, score) for the vectors (qid, qpos, embedding) of a batch of queries; fewer than k rows where there are fewer candidates."""
        vectors = vectors.select(F.col("qid").cast("long").alias("qid"), "qpos", F.col("embedding").cast("array<double>").alias("embedding"))
        few = vectors.limit(FEW_VECTORS + 1).toArrow()
        if few.num_rows <= FEW_VECTORS:
            return self._of_few(few, k)
        parts = -(-vectors.select("qid").distinct().count() // QUERIES)
        several = [vectors.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [vectors]
        return reduce(DataFrame.unionByName, (self._ranked(some, k) for some in several))

    def _of_few(self, vectors: pa.Table, k: int) -> DataFrame:
        """search_vectors() of so few collected vectors that their clusters are found, and most often their candidates held, on the driver."""
        (cids, centroids), _ = self._decoder.value
        queries = ranking.query_vectors(vectors)
        wanted = [(q, int(c)) for q, x in queries.items() for c in cids[np.unique(kmeans.best_dot(x, centroids, min(self.config.nprobe, len(cids)))[0])]]
        probed = self.spark.createDataFrame(wanted, "qid long, cid int")
        found = ranking.retrieve(probed, self._postings([c for _, c in wanted]))
        held = found.limit(FEW_CANDIDATES + 1).toArrow()
        if held.num_rows <= FEW_CANDIDATES:
            chunks = np.unique((held["pid"].to_numpy() - 1) // int(self.plan["chunksize"]) + 1).tolist()
            rows = ranking.gather(self._compressed(chunks), F.broadcast(self.spark.createDataFrame(held))).select("qid", "pid", "code", "residual")
        else:
            rows = self.embeddings(found)
        return self._best(ranking.maxsim_of(rows, queries, self._decoder), k)

    def _ranked(self, vectors: DataFrame, k: int) -> DataFrame:
        """Of many queries: every passage is read once and finds the queries that probe one of its codes, so that candidates are never rows."""
        probed = ranking.probe(vectors, self.centroids, self.config.nprobe).select("qid", "cid").distinct().toArrow()
        return self._best(ranking.maxsim_of_passages(self.compressed, ranking.query_vectors(vectors.toArrow()), self._decoder, probed, k), k)

    def _best(self, scores: DataFrame, k: int) -> DataFrame:
        return ranking.top_k(scores, k, "qid").select("qid", "rank", "pid", "score")

    def search_many(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, rank, pid, score) for a batch of (qid, text)."""
        return self.search_vectors(encode.encode_queries(queries, self.encoder, self.config, self.tokens), k)

    def search(self, query: str, k: int) -> tuple[list[int], list[float]]:
        """The k best pids and their scores, best first."""
        found = self.search_many(readers.strings(self.spark, [query]).withColumnRenamed("pid", "qid"), k).orderBy("rank").collect()
        return [r["pid"] for r in found], [r["score"] for r in found]


def hydrate(results: DataFrame, passages: DataFrame) -> DataFrame:
    """results with the passages' columns."""
    return results.join(passages, "pid")
