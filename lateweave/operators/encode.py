"""Encoding token ids into unit vectors, and masking, flattening and normalising them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..functions import vec
from . import tokenize


class Encoder(Protocol):
    """What turns ids into vectors; shipped to the workers, so it loads heavy parts on first use."""

    dim: int

    def vectors(self, ids: np.ndarray, attention: np.ndarray) -> np.ndarray:
        """(texts, tokens, dim) float32 for a batch of padded ids (texts, tokens) and their attention mask."""
        ...


class HashEncoder:
    """Deterministic stand-in for a neural model: a token's vector is drawn from its id, whatever stands around it.

    MaxSim then measures soft lexical overlap. It reproduces the dataflow, not
    the quality, of a trained model.
    """

    def __init__(self, dim: int = 128) -> None:
        self.dim = dim

    def vectors(self, ids: np.ndarray, attention: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = ids.astype(np.uint64)[..., None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, self.dim + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
            for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(mul)
            h ^= h >> np.uint64(31)
        return (h >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - np.float32(1)


def unit_rows(v: np.ndarray) -> np.ndarray:
    return (v / (np.linalg.norm(v, axis=1, keepdims=True) + np.float32(vec.EPS))).astype(np.float32)


def _encode(encoder: Encoder, size: int, skip: Sequence[int]):
    """(key, ids, number of attended ids) to a row per token that isn't skipped; ``size`` texts at a time go through the encoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop = np.asarray(skip, np.int64)
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            length, attended = np.diff(ends, prepend=0), batch.column(2).to_numpy()
            # Texts of about one length stand together, so that there is little padding.
            order = np.argsort(length, kind="stable")
            for i in range(0, len(order), size):
                some = order[i : i + size]
                n = length[some]
                if not n.max():
                    continue
                at = np.arange(n.max())[None]
                there = at < n[:, None]
                ids = np.zeros(there.shape, np.int64)
                ids[there] = flat[np.repeat((ends - length)[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                v = encoder.vectors(ids, at < attended[some][:, None])
                keep = there & ~np.isin(ids, drop)
                text, pos = np.nonzero(keep)
                rows = unit_rows(v[keep])
                rows = pa.ListArray.from_arrays(np.arange(len(text) + 1, dtype=np.int32) * encoder.dim, pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some[text])), pa.array((pos + 1).astype(np.int32)), rows], [batch.schema.names[0], "pos", "embedding"])

    return run


def encode_passages(passages: DataFrame, encoder: Encoder, config: RetrievalConfig, tokens: tokenize.Tokens | None = None) -> DataFrame:
    """(pid, pos, embedding) of the tokens that the skiplist leaves; a map-only pass over (pid, text)."""
    ids = passages.select("pid", tokenize.document_ids(F.col("text"), config.doc_maxlen, config.doc_token_id, tokens).alias("ids"))
    skip = tokenize.skip_ids(config.mask_punctuation, tokens)
    return ids.select("pid", "ids", F.size("ids")).mapInArrow(_encode(encoder, config.index_bsize, skip), "pid long, pos int, embedding array<float>")


def encode_queries(queries: DataFrame, encoder: Encoder, config: RetrievalConfig, tokens: tokenize.Tokens | None = None) -> DataFrame:
    """(qid, qpos, embedding): exactly query_maxlen vectors for each query, masks included.

    The encoder attends to the masks only with attend_to_mask_tokens.
    """
    ids = queries.select("qid", tokenize.query_ids(F.col("text"), config.query_maxlen, config.query_token_id, tokens).alias("ids"))
    mask = (tokens or tokenize.HashTokens()).special("[MASK]")
    attended = F.size("ids") if config.attend_to_mask_tokens else F.size(F.array_remove("ids", mask))
    return ids.select("qid", "ids", attended).mapInArrow(_encode(encoder, config.index_bsize, ()), "qid long, qpos int, embedding array<float>")


def doclens(passages: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(pid, doclen), passages without a token included."""
    counts = embeddings.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    return passages.select("pid").join(counts, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).cast("int").alias("doclen"))


def clear_masked(embedding: Column, keep: Column, dim: int) -> Column:
    """Zero vectors where the mask is false."""
    return F.when(keep, vec.doubles(embedding)).otherwise(vec.zeros(dim))


def flatten(docs: DataFrame, vectors: str = "vectors") -> DataFrame:
    """(pid, pos, embedding) from one array of vectors per document; positions from 1."""
    return docs.select("pid", F.posexplode(vectors).alias("p", "embedding")).select("pid", (F.col("p") + 1).alias("pos"), "embedding")


def remove_masked(embeddings: DataFrame) -> DataFrame:
    return embeddings.where("keep").drop("keep")
