"""Probing, postings, MaxSim and top-k: search over coded token vectors, for one query or many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .codec import Codec, byte_matrix, decode_rows
from . import kmeans
from .kmeans import best_dot, centroid_matrix, distinct_rows, list_array, matrix


def build_ivf(coded: DataFrame, clusters: int) -> DataFrame:
    """(cid, eids, len) for cid 1 .. clusters; eids ascending; clusters without embeddings have an empty list.

    A table of lists, for export and for small indexes; search() joins the
    coded rows themselves, so that no cluster has to fit one row.
    """
    lists = coded.groupBy(F.col("code").alias("cid")).agg(F.sort_array(F.collect_list("eid")).alias("eids"))
    every = coded.sparkSession.range(1, clusters + 1).select(F.col("id").cast("int").alias("cid"))
    joined = every.join(lists, "cid", "left").withColumn("eids", F.coalesce("eids", F.array().cast("array<bigint>")))
    return joined.select("cid", "eids", F.size("eids").alias("len"))


def emb2pid(doclens: DataFrame) -> DataFrame:
    """(eid, pid): embedding ids in pid order. The offsets are a running sum over chunks of pids, then inside each chunk."""
    chunk = F.floor(F.col("pid") / 25_000).cast("long")
    rows = doclens.withColumn("_c", chunk)
    totals = rows.groupBy("_c").agg(F.sum("doclen").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("doclen").over(Window.partitionBy("_c").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_in", inside).join(totals.select("_c", before.alias("_before")), "_c")
    each = placed.where("doclen > 0").select("pid", (F.col("_before") + F.col("_in")).alias("_at"), F.explode(F.sequence(F.lit(1), F.col("doclen"))).alias("_k"))
    return each.select((F.col("_at") + F.col("_k")).cast("long").alias("eid"), "pid")


def _probed(model, position: int, keep: list[int], nprobe: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, centroids = model.value
        k = min(nprobe, len(cids))
        for batch in batches:
            if not len(batch):
                continue
            top, scores = best_dot(matrix(batch.column(position)), centroids, k)
            rows = pa.array(np.repeat(np.arange(len(batch)), k))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(rows) for i in keep), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))), pa.array(cids[top].ravel().astype(np.int32)), pa.array(scores.ravel())],
                [*(batch.schema.names[i] for i in keep), "rank", "cid", "score"],
            )

    return run


def probe(queries: DataFrame, centroids: DataFrame, nprobe: int, vector: str = "embedding") -> DataFrame:
    """(query columns, rank, cid, score): each query vector's nprobe best centroids; ties go to the lower cid, nprobe is clamped to their number."""
    model = queries.sparkSession.sparkContext.broadcast(centroid_matrix(centroids))
    names = queries.columns
    keep = [i for i, c in enumerate(names) if c != vector]
    kinds = [f"`{names[i]}` {queries.dtypes[i][1]}" for i in keep]
    return queries.mapInArrow(_probed(model, names.index(vector), keep, nprobe), ", ".join([*kinds, "rank int", "cid int", "score double"]))


def top_k(scored: DataFrame, k: int, by: str, score: str = "score", tie: str = "pid") -> DataFrame:
    """The k best rows for each value of ``by``, with ``rank``; ties go to the lower ``tie``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def retrieve(probed: DataFrame, postings: DataFrame, by: str = "qid") -> DataFrame:
    """(by, pid): passages with an embedding in a probed cluster. postings: (code, pid, ...), joined on the code."""
    wanted = probed.select(by, F.col("cid").alias("code")).distinct()
    return postings.select("code", "pid").join(wanted, "code").select(by, "pid").distinct()


def gather(compressed: DataFrame, candidates: DataFrame, by: str = "qid") -> DataFrame:
    """All embeddings of the candidate passages, not only the probed ones; one copy for each query that wants them."""
    return compressed.join(candidates, "pid")


def _scored(shared, decoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding, queries = decoder and decoder.value, shared.value
        for batch in batches:
            if not len(batch):
                continue
            qid, pid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if coding is None:
                x = matrix(batch.column(2))
            else:
                (cids, centroids), codec = coding
                x = decode_rows(batch.column(2).to_numpy(), byte_matrix(batch.column(3)), cids, centroids, codec)
            for q in np.unique(qid):
                at = np.flatnonzero(qid == q)
                at = at[np.argsort(pid[at], kind="stable")]
                first = np.flatnonzero(np.diff(pid[at], prepend=pid[at][:1] - 1))
                best = np.maximum.reduceat(x[at] @ queries[q].T, first, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), q)), pa.array(pid[at][first]), list_array(best)], ["qid", "pid", "best"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches in order of the pid (first column), cut anew so that no passage lies in two; with its passages' pids and their first rows."""
    rest: list[pa.RecordBatch] = []

    def cut(batch: pa.RecordBatch):
        pid = batch.column(0).to_numpy()
        first = np.flatnonzero(np.diff(pid, prepend=pid[:1] - 1))
        return batch, pid[first], first

    for batch in batches:
        if not len(batch):
            continue
        rest.append(batch)
        pid = batch.column(0).to_numpy()
        other = np.flatnonzero(pid != pid[-1])
        last = other[-1] + 1 if len(other) else 0
        if last or rest[0].column(0)[0].as_py() != pid[-1]:
            yield cut(pa.Table.from_batches([*rest[:-1], batch.slice(0, last)]).combine_chunks().to_batches()[0])
            rest = [batch.slice(last)]
    if rest:
        yield cut(pa.Table.from_batches(rest).combine_chunks().to_batches()[0])


def _of_passages(shared, decoder, k: int | None):
    """Rows in order of their pids to (qid, pid, score): of all passages, or the k best of each query among this task's; of equals the lower pid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vectors, at, starts, codes, wanted = shared.value
        names = ["qid", "pid", "score"]
        top, held = np.full((k or 0, len(qids)), -np.inf), np.zeros((k or 0, len(qids)), np.int64)
        for batch, pids, first in _whole(batches):
            if decoder is None:
                code, x = None, matrix(batch.column(1))
            else:
                (cids, centroids), codec = decoder.value
                code, data = batch.column(1).to_numpy(), byte_matrix(batch.column(2))
            ends = np.append(first[1:], len(batch))
            most, i = max(1, kmeans.NUMBERS // len(vectors)), 0
            while i < len(pids):
                # So many whole passages that a product stays in bounds; one at least.
                j = max(i + 1, int(np.searchsorted(ends, first[i] + most, side="right")))
                a, b = first[i], ends[j - 1]
                some = x[a:b] if code is None else decode_rows(code[a:b], data[a:b], cids, centroids, codec)
                # A passage's equal vectors have equal products: they are multiplied once.
                each, place = distinct_rows(some)
                own = [np.unique(place[first[p] - a : ends[p] - a]) for p in range(i, j)]
                best, step = np.empty((j - i, len(vectors))), max(1, kmeans.NUMBERS // len(each))
                for c in range(0, len(vectors), step):
                    products = some[each] @ vectors[c : c + step].T
                    for p, r in enumerate(own):
                        best[p, c : c + step] = products[r].max(0)
                scores = np.empty((j - i, len(qids)))
                for p in range(i, j):
                    scores[p - i] = np.add.reduceat(best[p - i, at], starts)
                    if wanted is not None:
                        there = np.unique(code[first[p] : ends[p]])
                        found = np.searchsorted(codes, there)
                        found = found[codes[np.minimum(found, len(codes) - 1)] == there]
                        out = np.ones(len(qids), bool)
                        for c in found:
                            out[wanted[c]] = False
                        scores[p - i, out] = -np.inf
                if k is None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(qids, j - i)), pa.array(np.repeat(pids[i:j], len(qids))), pa.array(scores.ravel())], names)
                else:
                    # Pids ascend, so that of equal scores the held ones stay.
                    q = np.flatnonzero((scores > top[-1]).any(0))
                    both = np.concatenate([top[:, q], scores[:, q]])
                    whose = np.concatenate([held[:, q], np.broadcast_to(pids[i:j, None], (j - i, len(q)))])
                    keep = np.argsort(-both, axis=0, kind="stable")[:k]
                    top[:, q], held[:, q] = np.take_along_axis(both, keep, 0), np.take_along_axis(whose, keep, 0)
                i = j
        rank, q = np.nonzero(top > -np.inf)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(held[rank, q]), pa.array(top[rank, q])], names)

    return run


def maxsim_of_passages(rows: DataFrame, queries: dict[int, np.ndarray], decoder: Broadcast | None = None, probed: pa.Table | None = None, k: int | None = None) -> DataFrame:
    """(qid, pid, score) of whole passages (pid, embedding), or with a decoder (pid, code, residual): each is read once, whatever number of queries wants it.

    probed (qid, cid): only passages with an embedding in a probed cluster of a
    query are its candidates. k: at least each query's k best passages, a few
    from each task; of equals those of lower pids.
    """
    spark = rows.sparkSession
    if not queries:
        return rows.select(F.lit(0).cast("long").alias("qid"), "pid", F.lit(0.0).alias("score")).limit(0)
    qids = np.array(sorted(queries), np.int64)
    every = np.concatenate([queries[q] for q in qids.tolist()])
    each, at = distinct_rows(every)
    codes, wanted = None, None
    if probed is not None:
        found = probed.select(["qid", "cid"]).sort_by([("cid", "ascending"), ("qid", "ascending")])
        codes, first = np.unique(found["cid"].to_numpy(), return_index=True)
        wanted = np.split(np.searchsorted(qids, found["qid"].to_numpy()).astype(np.int32), first[1:])
    starts = np.cumsum([0, *(len(queries[q]) for q in qids.tolist())])[:-1]
    shared = spark.sparkContext.broadcast((qids, every[each], at, starts, codes, wanted))
    columns = ("code", "residual") if decoder else ("embedding",)
    dealt = rows.select(F.col("pid").cast("long"), *columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pid").sortWithinPartitions("pid")
    return dealt.mapInArrow(_of_passages(shared, decoder, k), "qid long, pid long, score double")


def query_vectors(found: pa.Table) -> dict[int, np.ndarray]:
    """qid -> (qpos ascending, dim) of collected rows (qid, qpos, embedding)."""
    if not found.num_rows:
        return {}
    found = found.sort_by([("qid", "ascending"), ("qpos", "ascending")]).combine_chunks()
    qid, x = found["qid"].to_numpy(), matrix(found["embedding"].chunk(0))
    names, first = np.unique(qid, return_index=True)
    return dict(zip(names.tolist(), np.split(x, first[1:])))


def maxsim(rows: DataFrame, queries: DataFrame, coding: tuple[DataFrame, Codec] | None = None) -> DataFrame:
    """(qid, pid, score): the sum over query vectors of the best inner product with a passage's vectors.

    rows: (qid, pid, embedding), or with coding (centroids, codec)
    (qid, pid, code, residual), which are decoded on the fly.
    """
    decoder = rows.sparkSession.sparkContext.broadcast((centroid_matrix(coding[0]), coding[1])) if coding else None
    return maxsim_of(rows, query_vectors(queries.select("qid", "qpos", "embedding").toArrow()), decoder)


def maxsim_of(rows: DataFrame, queries: dict[int, np.ndarray], decoder: Broadcast | None = None) -> DataFrame:
    """maxsim() for collected queries, which are broadcast, and a broadcast ((cids, centroids), codec).

    Every batch gives its best products for a passage; a passage that lies in
    several batches is put together by one small aggregation.
    """
    if not queries:
        return rows.select("qid", "pid", F.lit(0.0).alias("score")).limit(0)
    width = max(len(v) for v in queries.values())
    shared = rows.sparkSession.sparkContext.broadcast(queries)
    columns = ("code", "residual") if decoder else ("embedding",)
    best = rows.select(F.col("qid").cast("long"), F.col("pid").cast("long"), *columns).mapInArrow(_scored(shared, decoder), "qid long, pid long, best array<double>")
    whole = best.groupBy("qid", "pid").agg(*[F.max(F.get("best", i)).alias(f"_{i}") for i in range(width)])
    return whole.select("qid", "pid", sum((F.coalesce(F.col(f"_{i}"), F.lit(0.0)) for i in range(width)), F.lit(0.0)).alias("score"))
