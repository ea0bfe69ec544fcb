"""Residual codec: centroid codes plus n-bit quantised residuals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import bits, vec
from .kmeans import assign, centroid_matrix, first_of_equals, list_array, matrix, nearest_dot

#: Rows coded or decoded at a time.
ROWS = 10_000


@dataclass(frozen=True)
class Codec:
    cutoffs: tuple[float, ...]
    weights: tuple[float, ...]
    avg_residual: float

    @property
    def nbits(self) -> int:
        return len(self.weights).bit_length() - 1


def check(dim: int, nbits: int, cutoffs: Sequence[float]) -> None:
    if dim % 8:
        raise ValueError("dim must be a multiple of 8")
    if len(cutoffs) != 2**nbits - 1:
        raise ValueError("there must be 2**nbits - 1 cutoffs")


def codes(embeddings: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """embeddings with ``code``: the centroid of the largest inner product."""
    return assign(embeddings, centroids, vector, "dot").withColumnRenamed("cid", "code")


def residuals(coded: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """coded with ``residual``: vector minus its centroid."""
    c = centroids.select(F.col("cid").alias("_cid"), F.col("vector").alias("_vector"))
    return coded.join(c, F.col("code") == F.col("_cid")).withColumn("residual", vec.sub(vector, "_vector")).drop("_cid", "_vector")


def probabilities(nbits: int) -> tuple[list[float], list[float]]:
    """Quantiles of the cutoffs and of the weights."""
    n = 2**nbits
    return [i / n for i in range(1, n)], [(i + 0.5) / n for i in range(n)]


def entries(residual_rows: DataFrame) -> DataFrame:
    return residual_rows.select(F.explode("residual").alias("x"))


def _counted(prefixes: np.ndarray, have: int, bits: int):
    """Entries by the first ``bits`` bits of their order, of those whose first ``have`` bits are among the prefixes; and the sum of their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0.0
        for batch in batches:
            x = batch.column(0).flatten().drop_null().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            size += float(np.abs(x).sum())
            b = x.view(np.uint64)
            # Bits that are in order as the numbers are.
            b = np.where(b >> np.uint64(63), ~b, b | np.uint64(1 << 63))
            if have:
                b = b[np.isin(b >> np.uint64(64 - have), prefixes)]
            found, n = np.unique(b >> np.uint64(64 - bits), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, found]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts), pa.array(np.where(np.arange(len(keys)) == 0, size, 0.0))], ["k", "n", "a"])

    return run


def _quantiles(rows: DataFrame, at: Sequence[float]) -> tuple[list[float], float]:
    """Exact interpolated quantiles of all entries of an array column, and the mean of their sizes.

    Entries are counted by the first 24 bits of their order, then those that
    share such bits with a wanted one by all 64: no task holds them all.
    """
    total, mean, have, left, places = 0, 0.0, 0, 0, {}
    while have < 64:
        bits = 24 if not have else 64 if left <= 1 << 20 else have + 20
        prefixes = np.array(sorted({p for p, _ in places.values()}), np.uint64)
        grouped = rows.mapInArrow(_counted(prefixes, have, bits), "k long, n long, a double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).toArrow()
        keys, n = grouped["k"].to_numpy().view(np.uint64), grouped["n"].to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        if not have:
            total = int(n.sum())
            if not total:
                raise ValueError("no residuals to fit a codec on")
            mean = float(grouped["a"].to_numpy().sum()) / total
            places = {r: (0, r) for p in at for r in (math.floor(p * (total - 1)), math.ceil(p * (total - 1)))}
        left, found = 0, {}
        for r, (prefix, offset) in places.items():
            inside = keys >> np.uint64(bits - have) == np.uint64(prefix) if have else np.ones(len(keys), bool)
            some, ends = keys[inside], np.cumsum(n[inside])
            i = int(np.searchsorted(ends, offset, side="right"))
            found[r] = (int(some[i]), offset - (int(ends[i - 1]) if i else 0))
            left += int(n[inside][i])
        places, have = found, bits
    b = np.array([p for p, _ in places.values()], np.uint64)
    values = dict(zip(places, np.where(b >> np.uint64(63), b & np.uint64((1 << 63) - 1), ~b).view(np.float64).tolist()))
    out = []
    for p in at:
        place = p * (total - 1)
        a, b = values[math.floor(place)], values[math.ceil(place)]
        out.append(a if a == b else (math.ceil(place) - place) * a + (place - math.floor(place)) * b)
    return out, mean


def fit(residual_rows: DataFrame, nbits: int, exact: bool = True) -> Codec:
    """Cutoffs and weights as quantiles over all entries of all residuals.

    exact interpolates over the full multiset, whatever its size. Otherwise
    percentile_approx.
    """
    at, mid = probabilities(nbits)
    if exact:
        q, a = _quantiles(residual_rows.select("residual"), at + mid)
        return Codec(tuple(q[: len(at)]), tuple(q[len(at) :]), a)
    found = F.percentile_approx("x", at + mid, 100_000)
    row = entries(residual_rows).agg(found.alias("q"), F.avg(F.abs("x")).alias("a")).first()
    if row["q"] is None:
        raise ValueError("no residuals to fit a codec on")
    return Codec(tuple(row["q"][: len(at)]), tuple(row["q"][len(at) :]), row["a"])


def bucket_index(x: Column, cutoffs: Column) -> Column:
    """Number of cutoffs strictly below x: a value equal to a cutoff goes to the lower bucket."""
    return F.size(F.filter(cutoffs, lambda c: c < x))


def bucket_indices(values: Column, cutoffs: Sequence[float]) -> Column:
    cuts = F.array(*[F.lit(float(c)) for c in cutoffs])
    return F.transform(values, lambda x: bucket_index(x, cuts))


def binarize_expression(residual: Column, codec: Codec, dim: int) -> Column:
    """Packed bytes of a residual as one SQL expression: its definition, step by step, for tests and small tables."""
    check(dim, codec.nbits, codec.cutoffs)
    return bits.pack(bits.bit_planes(bucket_indices(residual, codec.cutoffs), codec.nbits))


def binarize(residual: Column, codec: Codec, dim: int) -> Column:
    """Packed bytes of a residual, whole Arrow batches at a time. A null stays null."""
    check(dim, codec.nbits, codec.cutoffs)

    @F.pandas_udf(BinaryType())
    def packed(rows: pd.Series) -> pd.Series:
        there = rows.notna()
        values = np.stack(rows[there].tolist()) if there.any() else np.zeros((0, dim))
        data = pack_matrix(np.searchsorted(np.asarray(codec.cutoffs), values, side="left"), codec.nbits)
        return pd.Series([r.tobytes() for r in data], index=rows.index[there], dtype=object).reindex(rows.index).where(there, None)

    return packed(residual)


def decompress_residuals(data: Column, codec: Codec) -> Column:
    """Residual values (bucket weights) from packed bytes."""
    weights = F.array(*[F.lit(float(w)) for w in codec.weights])
    return F.transform(bits.from_planes(bits.unpack(data), codec.nbits), lambda i: F.get(weights, i))


def pack_matrix(values: np.ndarray, nbits: int) -> np.ndarray:
    """(rows, dim) small integers to (rows, dim * nbits / 8) bytes."""
    if values.size and (values.min() < 0 or values.max() >= 1 << nbits):
        raise ValueError(f"values must be in 0..{(1 << nbits) - 1}")
    planes = (values[:, :, None] >> np.arange(nbits)) & 1
    return np.packbits(planes.reshape(len(values), -1).astype(np.uint8), axis=1, bitorder="little")


def unpack_matrix(data: np.ndarray, nbits: int) -> np.ndarray:
    planes = np.unpackbits(data, axis=1, bitorder="little")
    if planes.shape[1] % nbits:
        raise ValueError("the bits are no multiple of nbits")
    return (planes.reshape(len(data), -1, nbits) << np.arange(nbits)).sum(2)


def _compressed(model, position: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (cids, centroids), codec = model.value
        cuts = np.asarray(codec.cutoffs)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                x = matrix(part.column(position))
                rows = nearest_dot(x, centroids)
                data = pack_matrix(np.searchsorted(cuts, x - centroids[rows], side="left"), codec.nbits)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), pa.array(cids[rows].astype(np.int32)), pa.array([r.tobytes() for r in data], pa.binary())], [*(part.schema.names[k] for k in keep), "code", "residual"]
                )

    return run


def compress(embeddings: DataFrame, centroids: DataFrame, codec: Codec, vector: str = "embedding") -> DataFrame:
    """embeddings with the vector replaced by code and packed residual; one map-only pass."""
    found = first_of_equals(*centroid_matrix(centroids))
    check(found[1].shape[1], codec.nbits, codec.cutoffs)
    model = embeddings.sparkSession.sparkContext.broadcast((found, codec))
    keep = [i for i, c in enumerate(embeddings.columns) if c != vector]
    kinds = [f"`{embeddings.columns[i]}` {embeddings.dtypes[i][1]}" for i in keep]
    return embeddings.mapInArrow(_compressed(model, embeddings.columns.index(vector), keep), ", ".join([*kinds, "code int", "residual binary"]))


def decode_rows(code: np.ndarray, data: np.ndarray, cids: np.ndarray, centroids: np.ndarray, codec: Codec) -> np.ndarray:
    """(rows, dim) unit vectors from codes and packed residuals."""
    at = np.searchsorted(cids, code)
    if len(code) and (at.max(initial=0) >= len(cids) or (cids[np.minimum(at, len(cids) - 1)] != code).any()):
        raise ValueError("a code has no centroid")
    v = centroids[at] + np.asarray(codec.weights)[unpack_matrix(data, codec.nbits)]
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + vec.EPS)


def byte_matrix(column: pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1) if data else np.zeros((0, 0), np.uint8)


def _decompressed(model, code: int, residual: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (cids, centroids), codec = model.value
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                v = decode_rows(part.column(code).to_numpy(), byte_matrix(part.column(residual)), cids, centroids, codec)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), list_array(v)], [*(part.schema.names[k] for k in keep), "embedding"])

    return run


def decompress(compressed: DataFrame, centroids: DataFrame, codec: Codec) -> DataFrame:
    """compressed with code and residual replaced by the unit vector they stand for."""
    model = compressed.sparkSession.sparkContext.broadcast((centroid_matrix(centroids), codec))
    names = compressed.columns
    keep = [i for i, c in enumerate(names) if c not in ("code", "residual")]
    kinds = [f"`{names[i]}` {compressed.dtypes[i][1]}" for i in keep]
    return compressed.mapInArrow(_decompressed(model, names.index("code"), names.index("residual"), keep), ", ".join([*kinds, "embedding array<double>"]))
