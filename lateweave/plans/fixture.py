"""The embeddings table read as token vectors, and the matching DuckDB fragments.

eid = vec_id + 1; eight vectors make a passage; every 16th vector is a
centroid; four vectors from every 50th on are a query's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NBITS = 2
NPROBE = 2
DIGITS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        (v + 1).alias("eid"), (F.floor(v / 8) + 1).alias("pid"), (v % 8 + 1).cast("int").alias("pos"), F.col("embedding")
    )


def cent(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").where(v % 16 == 0).select((F.floor(v / 16) + 1).cast("int").alias("cid"), F.col("embedding").cast("array<double>").alias("vector"))


def query_vectors(spark: SparkSession, sf_dir: str, queries: int | None = None) -> DataFrame:
    """Every row whose vec_id is divisible by 50 begins a query (qid: its vec_id) of four vectors; with ``queries``, the first so many."""
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").where(v % 50 < 4)
    rows = rows.select((v - v % 50).alias("qid"), (v % 50 + 1).cast("int").alias("qpos"), F.col("embedding"))
    return rows if queries is None else rows.where(F.col("qid") < 50 * queries)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("pid"), "text")


TOK = "tok AS (SELECT vec_id + 1 AS eid, vec_id // 8 + 1 AS pid, (vec_id % 8 + 1)::INTEGER AS pos, embedding::DOUBLE[] AS v FROM embeddings)"
CENT = "cent AS (SELECT (vec_id // 16 + 1)::INTEGER AS cid, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id % 16 = 0)"
CODES = f"""{TOK}, {CENT},
codes AS (SELECT eid, pid, pos, v, cid AS code, c FROM (
  SELECT *, row_number() OVER (PARTITION BY eid ORDER BY list_inner_product(v, c) DESC, cid) AS rn FROM tok, cent) WHERE rn = 1),
res AS (SELECT eid, pid, pos, code, c, list_transform(range(1, len(v) + 1), lambda i: v[i] - c[i]) AS r FROM codes)"""
CUTS = f"""{CODES},
codec AS (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS cuts, quantile_cont(x, [0.125, 0.375, 0.625, 0.875]) AS w, avg(abs(x)) AS a FROM (SELECT unnest(r) AS x FROM res)),
buck AS (SELECT eid, pid, code, c, list_transform(r, lambda x: len(list_filter(cuts, lambda t: t < x))::INTEGER) AS b FROM res, codec)"""
#: The hexadecimal bytes of a bucket list: four 2-bit values to a byte, least significant first.
HEXED = "array_to_string(list_transform(range(0, len(b) // 4), lambda j: lpad(lower(to_hex(b[4 * j + 1] + 4 * b[4 * j + 2] + 16 * b[4 * j + 3] + 64 * b[4 * j + 4])), 2, '0')), '')"
DECODED = f"""{CUTS},
raw AS (SELECT eid, pid, list_transform(range(1, len(b) + 1), lambda i: c[i] + w[b[i] + 1]) AS u FROM buck, codec),
deco AS (SELECT eid, pid, list_transform(u, lambda x: x / (sqrt(list_inner_product(u, u)) + 1.1920928955078125e-07)) AS d FROM raw)"""


def queries_cte(n: int | None = None) -> str:
    some = "" if n is None else f" AND vec_id < {50 * n}"
    return f"q AS (SELECT vec_id - vec_id % 50 AS qid, (vec_id % 50 + 1)::INTEGER AS qpos, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 < 4{some})"


def probe_cte(n: int | None = None) -> str:
    return f"""{queries_cte(n)},
probe AS (SELECT * FROM (SELECT qid, qpos, cid, list_inner_product(q, c) AS score,
  row_number() OVER (PARTITION BY qid, qpos ORDER BY list_inner_product(q, c) DESC, cid)::INTEGER AS rank FROM q, cent) WHERE rank <= {NPROBE}),
cand AS (SELECT DISTINCT qid, pid FROM probe JOIN codes ON cid = code)"""


def search_cte(k: int, n: int | None = None) -> str:
    return f"""{DECODED}, {probe_cte(n)},
ms AS (SELECT qid, pid, sum(m) AS score FROM (
  SELECT cand.qid, deco.pid, qpos, max(list_inner_product(q, d)) AS m FROM cand JOIN deco USING (pid) JOIN q ON q.qid = cand.qid GROUP BY ALL) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid)::INTEGER AS rank FROM ms) WHERE rank <= {k})"""


#: Token strings of documents as in operators.tokenize.
TOKENS = r"""toks AS (SELECT doc_id + 1 AS pid, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t FROM documents)"""
TOKEN_ID = "(('0x' || substr(md5(x), 1, 7))::BIGINT % 1048576 + 1000)::INTEGER"
