"""Lloyd's k-means over embedding tables.

Assigning by squared L2 distance is a matrix product in numpy over Arrow
batches, block by block of points and of centroids, so that a product stays
within a fixed number of bytes. Sums per cluster are reduced inside each task
before one small shuffle. Centroids are k x dim numbers, and k is bounded by
the index plan (planning.MOST_CLUSTERS): they are the only thing that is
collected and broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec

#: Points to a product, and numbers in one.
POINTS, NUMBERS = 1000, 1 << 22


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, dim) float64 of a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def list_array(rows: np.ndarray) -> pa.ListArray:
    """A list column of a matrix's rows."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cids ascending, vectors) of a centroid table (cid, vector)."""
    found = centroids.select("cid", vec.doubles("vector").alias("vector")).toArrow().sort_by("cid").combine_chunks()
    if not found.num_rows:
        raise ValueError("no centroids")
    return found["cid"].to_numpy(), matrix(found["vector"].chunk(0))


def distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of every distinct row, in any order, and every row's place among them."""
    bits = np.ascontiguousarray(x, np.float64).view(np.uint64)
    odd = np.random.default_rng(0).integers(0, 1 << 63, bits.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    _, first, at = np.unique((bits * odd).sum(1, dtype=np.uint64), return_index=True, return_inverse=True)
    if not np.array_equal(bits[first][at], bits):  # two rows of one hash
        _, first, at = np.unique(bits, axis=0, return_index=True, return_inverse=True)
    return first, at.ravel()


def first_of_equals(cids: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without centroids that equal one of a lower cid: no point is ever given to them."""
    first = np.sort(distinct_rows(centroids)[0])
    return cids[first], centroids[first]


def _blocks(centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, NUMBERS // POINTS)
    return ((i, centroids[i : i + step]) for i in range(0, len(centroids), step))


def _best(points: np.ndarray, centroids: np.ndarray, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Row of the centroid with the largest score for each point; of equals the first. Equal points are compared once."""
    if points.shape[1] != centroids.shape[1]:
        raise ValueError("points and centroids differ in dimension")
    each, place = distinct_rows(points)
    points = points[each]
    out = np.zeros(len(points), np.int64)
    for i in range(0, len(points), POINTS):
        some = points[i : i + POINTS]
        most = np.full(len(some), -np.inf)
        for first, part in _blocks(centroids):
            found = score(some, part)
            at = found.argmax(1)
            value = found[np.arange(len(some)), at]
            more = value > most
            out[i : i + POINTS][more] = first + at[more]
            most = np.maximum(most, value)
    return out[place]


def nearest_l2(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Row of the nearest centroid by squared L2 distance; of equals the first."""
    return _best(points, centroids, lambda x, c: 2 * (x @ c.T) - (c * c).sum(1))


def nearest_dot(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Row of the centroid with the largest inner product; of equals the first."""
    return _best(points, centroids, lambda x, c: x @ c.T)


def best_dot(points: np.ndarray, centroids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and inner products of the k best centroids for each point, best first; of equals the first. k is at most their number."""
    rows, scores = np.zeros((len(points), k), np.int64), np.zeros((len(points), k))
    for i in range(0, len(points), POINTS):
        some = points[i : i + POINTS]
        at, value = np.zeros((len(some), 0), np.int64), np.zeros((len(some), 0))
        for first, part in _blocks(centroids):
            found = some @ part.T
            if k < found.shape[1]:
                # All that reach the k-th best value, ties included, in order; then the first k of each point.
                least = np.partition(found, found.shape[1] - k, 1)[:, found.shape[1] - k]
                point, column = np.nonzero(found >= least[:, None])
                order = np.lexsort((column, -found[point, column], point))
                start = np.searchsorted(point[order], np.arange(len(some)))
                top = column[order][start[:, None] + np.arange(k)]
            else:
                top = np.argsort(-found, axis=1, kind="stable")
            at = np.concatenate([at, first + top], 1)
            value = np.concatenate([value, np.take_along_axis(found, top, 1)], 1)
            keep = np.argsort(-value, axis=1, kind="stable")[:, :k]
            at, value = np.take_along_axis(at, keep, 1), np.take_along_axis(value, keep, 1)
        rows[i : i + POINTS], scores[i : i + POINTS] = at, value
    return rows, scores


def _assigned(model, how, position: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, centroids = model.value
        for batch in batches:
            if len(batch):
                rows = how(matrix(batch.column(position)), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cids[rows].astype(np.int32))], [*batch.schema.names, "cid"])

    return run


def assign(points: DataFrame, centroids: DataFrame, vector: str = "embedding", metric: str = "l2") -> DataFrame:
    """points with the ``cid`` of their nearest centroid. metric: l2 (clustering) or dot (coding); they may disagree."""
    model = points.sparkSession.sparkContext.broadcast(first_of_equals(*centroid_matrix(centroids)))
    kinds = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)
    how = {"l2": nearest_l2, "dot": nearest_dot}[metric]
    return points.mapInArrow(_assigned(model, how, points.columns.index(vector)), f"{kinds}, cid int")


def _measured(model, keep: list[int], position: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, centroids = model.value
        # So many points that the differences of all of them from all centroids stay in bounds.
        step = max(1, NUMBERS // centroids.size)
        for batch in batches:
            for i in range(0, len(batch), step):
                part = batch.slice(i, step)
                x = matrix(part.column(position))
                # The difference first, so that equal vectors are at exactly 0.
                d = ((x[:, None] - centroids[None]) ** 2).sum(2)
                rows = pa.array(np.repeat(np.arange(len(x)), len(cids)))
                head = [part.column(k).take(rows) for k in keep]
                yield pa.RecordBatch.from_arrays([*head, pa.array(np.tile(cids.astype(np.int32), len(x))), pa.array(d.ravel())], [*(part.schema.names[k] for k in keep), "cid", "distance"])

    return run


def distances(points: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Every point's squared distance to every centroid: (other columns of points, cid, distance), a map-only pass."""
    model = points.sparkSession.sparkContext.broadcast(centroid_matrix(centroids))
    keep = [i for i, c in enumerate(points.columns) if c != vector]
    kinds = [f"`{points.columns[i]}` {points.dtypes[i][1]}" for i in keep]
    return points.mapInArrow(_measured(model, keep, points.columns.index(vector)), ", ".join([*kinds, "cid int", "distance double"]))


def _partial(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, centroids = model.value
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if len(batch):
                x, n = matrix(batch.column(0)), batch.column(1).to_numpy()
                rows = nearest_l2(x, centroids)
                order = np.argsort(rows, kind="stable")
                first = np.flatnonzero(np.diff(rows[order], prepend=-1))
                sums[rows[order][first]] += np.add.reduceat((x * n[:, None])[order], first, axis=0)
                np.add.at(counts, rows, n)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cids[used].astype(np.int32)), pa.array(counts[used]), list_array(sums[used])], ["cid", "n", "total"])

    return run


def _means(points: DataFrame, cids: np.ndarray, now: np.ndarray, vector: str, count: str | None = None) -> DataFrame:
    """(cid, m) of the clusters that have points."""
    shared = points.sparkSession.sparkContext.broadcast(first_of_equals(cids, now))
    n = F.lit(1) if count is None else F.col(count)
    parts = points.select(vector, n.cast("long")).mapInArrow(_partial(shared), "cid int, n long, total array<double>")
    whole = parts.groupBy("cid").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", i)).alias(f"_{i}") for i in range(now.shape[1])])
    return whole.select("cid", F.array(*[F.col(f"_{i}") / F.col("n") for i in range(now.shape[1])]).alias("m"))


def step(points: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """One iteration: (cid, vector) with each cluster's mean; a cluster without points becomes the zero vector."""
    cids, now = centroid_matrix(centroids)
    means = _means(points, cids, now, vector)
    return centroids.select("cid").join(means, "cid", "left").select("cid", F.coalesce("m", vec.zeros(now.shape[1])).alias("vector"))


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: the largest change of any coordinate of any centroid."""
    both = old.select("cid", vec.doubles("vector").alias("a")).join(new.select("cid", vec.doubles("vector").alias("b")), "cid")
    return both.agg(F.max(F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))).alias("delta"))


def distinct(points: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vector, n): equal points as one, with their number, for fit()."""
    return points.groupBy(vector).agg(F.count(F.lit(1)).alias("n"))


def fit(points: DataFrame, centroids: DataFrame, *, vector: str = "embedding", count: str | None = None, max_iters: int = 10, tol: float = 1e-4) -> tuple[DataFrame, int, bool]:
    """(centroids, iterations, converged) from the given first centroids.

    When the largest change is below tol, the centroids that the last
    assignment was made with are kept; when the iterations run out, the last
    means are. Centroids go from round to round as one matrix on the driver.
    count: the column that says how many points a row stands for.
    """
    spark = points.sparkSession
    cids, now = centroid_matrix(centroids)

    def made(rows: np.ndarray) -> DataFrame:
        return spark.createDataFrame(pa.table({"cid": pa.array(cids.astype(np.int32)), "vector": list_array(rows)}))

    for turn in range(1, max_iters + 1):
        found = _means(points, cids, now, vector, count).toArrow().combine_chunks()
        new = np.zeros_like(now)
        if found.num_rows:
            new[np.searchsorted(cids, found["cid"].to_numpy())] = matrix(found["m"].chunk(0))
        if np.abs(new - now).max() < tol:
            return made(now), turn, True
        now = new
    return made(now), max_iters, False


def first_centroids(sample: DataFrame, k: int, *, key: str = "eid", vector: str = "embedding", seed: int = 0) -> DataFrame:
    """k points without replacement in hash order, numbered from 1."""
    from pyspark.sql import Window

    from .planning import first_by_hash

    chosen = first_by_hash(sample.select(key, vec.doubles(vector).alias("vector")), key, k, seed)
    # Keys alone go to one task and are broadcast; the plan bounds k, and the vectors stay where they are.
    numbered = chosen.select("_h", key, F.row_number().over(Window.orderBy("_h", key)).alias("cid"))
    return chosen.join(F.broadcast(numbered), ["_h", key]).select("cid", "vector")
