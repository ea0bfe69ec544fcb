"""Flat token files: writing them, and counting documents' tokens by a separator scan.

A flat file is nothing but token ids of one width, every document closed by an
end-of-document id; there is no index. The scan splits files into blocks that
tasks read on their own by byte range, finds the end ids of a block in one
vectorised comparison, and stitches documents that cross blocks by a prefix
scan over narrow block rows: the last end before a block and the number of ends
before it are a running maximum and a running sum.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialize, scratch, small_batches
from .encoders import encoder

TOKENIZER = "byte_bpe_50k.json"
#: The first id past the vocabulary: 50256, its own end of text, may stand inside a text.
END_ID = 50257
DTYPE = "<u2"
BLOCK_BYTES = 8 << 20


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(folder: str, end_id: int, dtype: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, largest = encoder(tokenizer), np.iinfo(np.dtype(dtype)).max
        # Each attempt has a file of its own; only the file of the attempt whose rows count is listed.
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        out, done = None, 0
        try:
            for batch in batches:
                if not len(batch):
                    continue
                if out is None:
                    store, inner = _opened(path)
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(inner)
                for text in batch.column(1):
                    ids = encode(text.as_py() or "")
                    if len(ids) and (int(ids.max()) > largest or bool((ids == end_id).any())):
                        raise ValueError("a token id is the end id or does not fit the file's width")
                    out.write(np.append(ids, np.uint32(end_id)).astype(dtype).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(batch)), pa.array(np.arange(done, done + len(batch))), batch.column(0)], ["path", "number", "key"]
                )
                done += len(batch)
        finally:
            if out is not None:
                out.close()

    return run


def write_flat(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", end_id: int = END_ID, dtype: str = DTYPE, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write every document's ids and the end id to flat files below ``folder``, one file per input partition.

    Returns (path, number, key): which document is the number-th of which file.
    The rows are a written table, so that the files are written once. A null
    or empty text is the end id alone.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return materialize(rows.mapInArrow(lean(_writer(folder, end_id, dtype, tokenizer)), f"path string, number long, key {kind}"), "token-manifest")


def flat_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length in bytes) of the .bin files of a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")


def _blocks(end_id: int, dtype: str):
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = _opened(path)
                with store.open_input_file(inner) as f:
                    f.seek(start)
                    ids = np.frombuffer(f.read(size), dtype)
                ends = np.flatnonzero(ids == end_id) + start // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block], pa.int64()), pa.array([start // width + len(ids)], pa.int64()), pa.array([ends.astype(np.int64)], pa.list_(pa.int64()))],
                    ["path", "block", "stop", "ends"],
                )

    return run


def scan(files: DataFrame, *, end_id: int = END_ID, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of flat token files.

    files: (path, length in bytes). Returns path, number (from 0 in its file),
    start (token offset), n_tokens (without the end id) and closed. Tokens
    after a file's last end id are a document with closed = false; an empty
    file has no documents; a length that is no multiple of the token's width
    raises an error. Two neighbouring end ids hold an empty document between
    them.
    """
    width = np.dtype(dtype).itemsize
    step = max(width, block_bytes // width * width)
    odd = F.when(F.col("length") % width != 0, F.raise_error(F.concat(F.lit("length is no multiple of the token width: "), F.col("path"))).cast("long"))
    files = files.select("path", F.coalesce(odd, F.col("length")).alias("length")).where("length > 0")
    at = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / step))).alias("block"))
    at = at.select("path", "block", (F.col("block") * step).alias("start"), F.least(F.lit(step).cast("long"), F.col("length") - F.col("block") * step).alias("size"))
    spark = files.sparkSession
    at = at.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = materialize(at.mapInArrow(lean(_blocks(end_id, dtype)), "path string, block long, stop long, ends array<long>"), "token-blocks")

    narrow = found.select("path", "block", "stop", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = narrow.select(
        "path", "block", "stop", F.coalesce(F.max("last").over(before), F.lit(-1)).alias("prev"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.greatest(F.coalesce(F.max("last").over(before), F.lit(-1)), F.coalesce("last", F.lit(-1))).alias("final"), (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("n")).alias("total"),
        F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull().alias("is_last"),
    )
    whole = found.join(carried.select("path", "block", "prev", "base"), ["path", "block"])
    whole = whole.select("path", "prev", "base", F.posexplode("ends").alias("k", "end"), "ends")
    start = F.coalesce(F.get("ends", F.col("k") - 1), F.col("prev")) + 1
    closed = whole.select("path", (F.col("base") + F.col("k")).alias("number"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = carried.where(F.col("is_last") & (F.col("stop") - 1 > F.col("final")))
    return closed.unionByName(rest.select("path", F.col("total").alias("number"), (F.col("final") + 1).alias("start"), (F.col("stop") - F.col("final") - 1).alias("n_tokens"), F.lit(False).alias("closed")))


def document_token_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write docs to flat files in the shared folder and scan those.

    Returns key, path, number (from 0 in its file), start (token offset there)
    and n_tokens of every row. A null or empty text has 0 tokens; a special
    token's string in a text is that token; repeated rows and null keys are
    counted like any others; texts of any length are taken; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    listed = write_flat(docs, folder, key=key, text=text)
    if listed.isEmpty():
        return listed.select(F.col("key").alias(key), "path", "number", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    # The files of attempts that failed are on disk too, but are not listed.
    used = listed.select("path").distinct()
    sizes = flat_files(spark, folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length")
    files = used.join(sizes, F.regexp_extract(used["path"], "[^/]+$", 0) == sizes["name"]).select("path", "length")
    return listed.join(scan(files, block_bytes=block_bytes), ["path", "number"]).select(F.col("key").alias(key), "path", "number", "start", "n_tokens")
