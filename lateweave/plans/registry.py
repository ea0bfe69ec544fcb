"""Queries of the retrieval engine and their DuckDB counterparts, by operator group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..functions import bits, vec
from ..indexer import Indexer
from ..indexer import write as write_index
from ..operators import codec as coding
from ..operators import encode, evaluate, kmeans, planning, ranking, tokenize
from ..searcher import Searcher, hydrate
from ..shared import scratch
from ..sources import checkpoint, store
from ..sources import passages as readers
from . import fixture as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_DEFAULT = RetrievalConfig()
DOC_MAXLEN, QUERY_MAXLEN, TOP = _DEFAULT.doc_maxlen, _DEFAULT.query_maxlen, 10


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def rounded(c: str) -> F.Column:
    return F.round(c, fx.DIGITS).alias(c)


def entries(df: DataFrame, array: str, *keys: str) -> DataFrame:
    """One row per array entry: keys, i (from 1), x (rounded)."""
    return df.select(*keys, F.posexplode(array).alias("p", "e")).select(*keys, (F.col("p") + 1).alias("i"), (F.round("e", fx.DIGITS) + 0.0).alias("x"))


def sql_entries(source: str, array: str, *keys: str) -> str:
    cols = ", ".join(keys)
    return f"SELECT {cols}, i::INTEGER AS i, round({array}[i], {fx.DIGITS}) + 0.0 AS x FROM {source}, LATERAL (SELECT unnest(range(1, len({array}) + 1)) AS i)"


# Sources


@query("SELECT doc_id + 1 AS pid, length(text)::INTEGER AS chars, md5(text) AS digest FROM documents")
def scan_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.passages(spark, sf_dir).select("pid", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def _lines(spark: SparkSession, rows: DataFrame, key: str) -> str:
    """A folder with one text file of the rows' only string column, in order of the key."""
    path = scratch(spark, "lines")
    rows.coalesce(1).sortWithinPartitions(key).drop(key).write.text(path)
    return path


@query("SELECT row_number() OVER (ORDER BY p_partkey) AS pid, p_name AS text FROM part")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.lines(spark, _lines(spark, fx.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey"))


@query("SELECT p_partkey::BIGINT AS pid, p_name AS text FROM part")
def tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name").alias("line"))
    return readers.tsv(spark, _lines(spark, rows, "p_partkey"))


@query("SELECT doc_id AS pid, md5(text) AS digest FROM documents")
def tsv_pid_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = fx.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\t", F.col("doc_id").cast("string"), "text").alias("line"))
    return line.select(F.split("line", "\t", 2)[0].cast("long").alias("pid"), F.md5(readers.strip_pid(F.col("line")).cast("binary")).alias("digest"))


@query("SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'document' AS kind, text FROM documents UNION ALL SELECT 'item', text FROM benchmark) GROUP BY kind")
def concatenate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (fx.table(spark, sf_dir, t).select(F.lit(k).alias("kind"), "text") for t, k in (("documents", "document"), ("benchmark", "item")))
    return readers.concatenated([a, b]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(r"""SELECT source, kind, nullif(lower(regexp_extract(kind, '^(\S+?)Tokenizer(Fast)?$', 1)), '') AS family
FROM (SELECT DISTINCT source, source || CASE WHEN doc_id % 3 = 0 THEN 'TokenizerFast' WHEN doc_id % 3 = 1 THEN 'Tokenizer' ELSE 'Model' END AS kind FROM documents)""")
def tokenizer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("doc_id") % 3 == 0, "TokenizerFast").when(F.col("doc_id") % 3 == 1, "Tokenizer").otherwise("Model")
    rows = fx.table(spark, sf_dir, "documents").select("source", F.concat("source", end).alias("kind")).distinct()
    return rows.select("source", "kind", checkpoint.tokenizer_type_column(F.col("kind")).alias("family"))


# Tokenisation


@query(f"WITH {fx.TOKENS} SELECT pid, i::INTEGER AS i, {fx.TOKEN_ID} AS token_id FROM (SELECT pid, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS i FROM toks)")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(fx.passages(spark, sf_dir).select("pid", tokenize.token_ids(F.col("text")).alias("a")))


_IDS = f"ids AS (SELECT pid, list_concat([101], list_transform(t, lambda x: {fx.TOKEN_ID}), [102]) AS a FROM toks)"
_CUT = f"cut AS (SELECT pid, a[1:{DOC_MAXLEN - 1}] AS a FROM ids)"
_MARKED = "marked AS (SELECT pid, list_concat(a[1:1], [2], a[2:]) AS a FROM cut)"


def _unnested(source: str) -> str:
    return f"SELECT pid, i::INTEGER AS i, a[i]::INTEGER AS token_id FROM {source}, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)"


def _exploded(df: DataFrame) -> DataFrame:
    return df.select("pid", F.posexplode("a").alias("p", "token_id")).select("pid", (F.col("p") + 1).alias("i"), F.col("token_id").cast("int").alias("token_id"))


@query(f"WITH {fx.TOKENS}, {_IDS}, {_CUT} {_unnested('cut')}")
def doc_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokenize.token_ids(F.col("text"), DOC_MAXLEN - 2)
    return _exploded(fx.passages(spark, sf_dir).select("pid", tokenize.truncate(tokenize.with_ends(ids), DOC_MAXLEN - 1).alias("a")))


@query(f"WITH {fx.TOKENS}, {_IDS}, {_CUT}, {_MARKED} {_unnested('marked')}")
def marker_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(fx.passages(spark, sf_dir).select("pid", tokenize.document_ids(F.col("text"), DOC_MAXLEN).alias("a")))


_QTOKS = "toks AS (SELECT item_id AS pid, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]') AS t FROM benchmark)"
_MASKED = f"""padded AS (SELECT pid, list_concat(a, list_transform(range({QUERY_MAXLEN}), lambda k: 0))[1:{QUERY_MAXLEN - 1}] AS a FROM ids),
masked AS (SELECT pid, list_transform(list_concat(a[1:1], [1], a[2:]), lambda x: CASE WHEN x = 0 THEN 103 ELSE x END) AS a FROM padded)"""


@query(f"WITH {_QTOKS}, {_IDS}, {_MASKED} {_unnested('masked')}")
def query_pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pid"), tokenize.query_ids(F.col("text"), QUERY_MAXLEN).alias("a")))


_PUNCT = ", ".join("'" + x.replace("'", "''") + "'" for x in tokenize.skiplist(True))


@query(f"WITH {fx.TOKENS} SELECT pid, len(t)::INTEGER AS tokens, len(list_filter(t, lambda x: x NOT IN ({_PUNCT})))::INTEGER AS kept FROM toks")
def punct_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fx.passages(spark, sf_dir).select("pid", tokenize.token_strings(F.col("text")).alias("t"))
    return ids.select("pid", F.size("t").alias("tokens"), F.size(F.filter("t", lambda x: ~x.isin(*tokenize.skiplist(True)))).alias("kept"))


@query(f"WITH {fx.TOKENS}, {_IDS}, {_CUT}, {_MARKED}, skip AS (SELECT list_append(list_transform([{_PUNCT}], lambda x: {fx.TOKEN_ID}), 0) AS s) SELECT pid, len(list_filter(a, lambda x: NOT list_contains(s, x)))::INTEGER AS doclen FROM marked, skip")
def doclens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fx.passages(spark, sf_dir).select("pid", tokenize.document_ids(F.col("text"), DOC_MAXLEN).alias("ids"))
    return ids.select("pid", F.size(F.filter("ids", lambda x: ~x.isin(*tokenize.skip_ids(True)))).alias("doclen"))


# Vectors


@query(f"WITH {fx.TOK}, n AS (SELECT eid, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1.1920928955078125e-07)) AS v FROM tok) {sql_entries('n', 'v', 'eid')}")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(fx.tok(spark, sf_dir).select("eid", vec.normalize("embedding").alias("v")), "v", "eid")


@query(f"WITH {fx.TOK}, n AS (SELECT eid, CASE WHEN pos % 3 = 0 THEN list_transform(v, lambda x: 0.0::DOUBLE) ELSE v END AS v FROM tok) {sql_entries('n', 'v', 'eid')}")
def clear_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(fx.tok(spark, sf_dir).select("eid", encode.clear_masked(F.col("embedding"), F.col("pos") % 3 != 0, 64).alias("v")), "v", "eid")


@query("SELECT vec_id // 8 + 1 AS pid, (vec_id % 8 + 1)::INTEGER AS pos, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def flatten_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.tok(spark, sf_dir).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("pos", "embedding"))).alias("s")).select("pid", F.transform("s", lambda x: x["embedding"]).alias("vectors"))
    return encode.flatten(docs).select("pid", "pos", F.round(F.get("embedding", F.lit(0)).cast("double"), fx.DIGITS).alias("first"))


@query("SELECT vec_id + 1 AS eid, vec_id // 8 + 1 AS pid FROM embeddings WHERE (vec_id % 8 + 1) % 3 <> 0")
def remove_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.remove_masked(fx.tok(spark, sf_dir).withColumn("keep", F.col("pos") % 3 != 0)).select("eid", "pid")


# Planning


@query("""WITH n AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'))) AS a FROM documents)
SELECT n, round(a, 5) AS avg_doclen, least(25000, 1 + n)::BIGINT AS chunksize, ceil(n / least(25000, 1 + n))::BIGINT AS num_chunks, least(1 + floor(16 * sqrt(120 * n)), n)::BIGINT AS sample,
 pow(2, floor(log2(16 * sqrt(n * a))))::BIGINT AS num_partitions FROM n""")
def plan_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = fx.passages(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokenize.token_strings(F.col("text")))).alias("a")).first()
    p = planning.plan(row["n"], row["a"], 1 << 40)
    out = (row["n"], round(row["a"], 5), p["chunksize"], p["num_chunks"], planning.sample_size(row["n"]), p["num_partitions"])
    return spark.createDataFrame([out], "n long, avg_doclen double, chunksize long, num_chunks long, sample long, num_partitions long")


@query("""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS pid FROM lineitem)
SELECT pid::BIGINT AS pid FROM l ORDER BY md5('0/' || pid), pid LIMIT (SELECT least(1 + floor(16 * sqrt(120 * count(*))), count(*))::BIGINT FROM l)""")
def sample_pids_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the one table that is larger than its sample."""
    pids = fx.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("pid"))
    return planning.sample_pids_by_hash(pids, planning.sample_size(pids.count()))


@query("""WITH t AS (SELECT vec_id + 1 AS eid, row_number() OVER (ORDER BY md5('0/' || (vec_id + 1)), vec_id) AS r FROM embeddings), n AS (SELECT greatest(1, floor(least(50000, 0.05 * count(*)))) AS h FROM embeddings)
SELECT eid, r <= h AS heldout FROM t, n""")
def heldout_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.tok(spark, sf_dir).select("eid")
    train, held = planning.heldout_split(t, planning.heldout_size(t.count()))
    return train.withColumn("heldout", F.lit(False)).unionByName(held.withColumn("heldout", F.lit(True)))


@query("SELECT c AS chunk_id, n AS num_embeddings, (1 + coalesce(sum(n) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS embedding_offset FROM (SELECT vec_id // 100 + 1 AS c, count(*) AS n FROM embeddings GROUP BY 1)")
def embedding_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = fx.tok(spark, sf_dir).groupBy((F.floor((F.col("eid") - 1) / 100) + 1).alias("chunk_id")).agg(F.count(F.lit(1)).alias("num_embeddings"))
    return planning.offsets(chunks)


@query("WITH d AS (SELECT vec_id // 8 + 1 AS pid, count(*) AS n FROM embeddings WHERE (vec_id // 8) % 5 <> 0 GROUP BY 1) SELECT row_number() OVER (ORDER BY pid, j) AS eid, pid FROM d, LATERAL (SELECT unnest(range(n)) AS j)")
def emb2pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = fx.tok(spark, sf_dir).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    return ranking.emb2pid(every.select("pid", F.when((F.col("pid") - 1) % 5 == 0, 0).otherwise(F.col("n")).cast("int").alias("doclen")))


# K-means

_KTOK = f"{fx.TOK}, {fx.CENT}"
_L2 = "list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c)"
_DIST = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
_MEANS = """means{k} AS (SELECT cent.cid, list(coalesce(m, 0.0) ORDER BY i) AS c FROM {c} cent CROSS JOIN range(1, 65) r(i)
  LEFT JOIN (SELECT cid, j, avg(v[j]) AS m FROM a{k}, range(1, 65) s(j) GROUP BY ALL) x ON x.cid = cent.cid AND x.j = i GROUP BY cent.cid)"""


def _assign_cte(k: int, source: str) -> str:
    return f"a{k} AS (SELECT eid, v, cid FROM (SELECT eid, v, cid, row_number() OVER (PARTITION BY eid ORDER BY {_L2}, cid) AS rn FROM tok, {source}) WHERE rn = 1)"


@query(f"WITH {_KTOK} SELECT eid, cid, round({_DIST}, 5) AS distance FROM tok, cent")
def l2_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.distances(fx.tok(spark, sf_dir).select("eid", "embedding"), fx.cent(spark, sf_dir)).select("eid", "cid", rounded("distance"))


@query(f"WITH {_KTOK}, {_assign_cte(0, 'cent')} SELECT eid, cid FROM a0")
def assign_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign(fx.tok(spark, sf_dir), fx.cent(spark, sf_dir)).select("eid", "cid")


@query(f"WITH {_KTOK}, {_assign_cte(0, 'cent')}, {_MEANS.format(k=0, c='cent')} {sql_entries('means0', 'c', 'cid')}")
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(kmeans.step(fx.tok(spark, sf_dir), fx.cent(spark, sf_dir)), "vector", "cid")


@query(f"WITH {_KTOK}, {_assign_cte(0, 'cent')}, {_MEANS.format(k=0, c='cent')} SELECT round(max(abs(a.c[i] - b.c[i])), 5) AS delta FROM cent a JOIN means0 b USING (cid), range(1, 65) r(i)")
def kmeans_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = fx.cent(spark, sf_dir)
    return kmeans.delta(first, kmeans.step(fx.tok(spark, sf_dir), first)).select(rounded("delta"))


@query(f"WITH {_KTOK}, " + ", ".join(f"{_assign_cte(k, 'cent' if k == 0 else f'means{k - 1}')}, {_MEANS.format(k=k, c='cent')}" for k in range(3)) + f" {sql_entries('means2', 'c', 'cid')}")
def kmeans_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(kmeans.fit(fx.tok(spark, sf_dir), fx.cent(spark, sf_dir), max_iters=3, tol=0.0)[0], "vector", "cid")


# Codec


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.codes(fx.tok(spark, sf_dir), fx.cent(spark, sf_dir))


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.residuals(_coded(spark, sf_dir), fx.cent(spark, sf_dir))


def _codec(spark: SparkSession, sf_dir: str) -> coding.Codec:
    return coding.fit(_residuals(spark, sf_dir), fx.NBITS)


def _compressed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, coding.Codec]:
    codec = _codec(spark, sf_dir)
    return coding.compress(fx.tok(spark, sf_dir), fx.cent(spark, sf_dir), codec), codec


@query(f"WITH {fx.CODES} SELECT eid, code FROM codes")
def codes_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).select("eid", "code")


@query(f"WITH {fx.CODES} {sql_entries('res', 'r', 'eid')}")
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(_residuals(spark, sf_dir), "residual", "eid")


def _numbered(spark: SparkSession, values: tuple[float, ...]) -> DataFrame:
    return spark.createDataFrame([(i + 1, round(x, fx.DIGITS) + 0.0) for i, x in enumerate(values)], "i int, x double")


@query(f"WITH {fx.CUTS} SELECT i::INTEGER AS i, round(cuts[i], 5) + 0.0 AS x FROM codec, range(1, 4) r(i)")
def bucket_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, _codec(spark, sf_dir).cutoffs)


@query(f"WITH {fx.CUTS} SELECT i::INTEGER AS i, round(w[i], 5) + 0.0 AS x FROM codec, range(1, 5) r(i)")
def bucket_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, _codec(spark, sf_dir).weights)


@query(f"WITH {fx.CUTS} SELECT round(a, 5) AS avg_residual FROM codec")
def avg_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.entries(_residuals(spark, sf_dir)).agg(F.round(F.avg(F.abs("x")), fx.DIGITS).alias("avg_residual"))


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = _codec(spark, sf_dir)
    return _residuals(spark, sf_dir).select("eid", coding.bucket_indices(F.col("residual"), codec.cutoffs).alias("b"))


_HEX = f"WITH {fx.CUTS} SELECT eid, {fx.HEXED} AS bytes FROM buck"


@query(f"WITH {fx.CUTS} SELECT eid, array_to_string(b, '') AS buckets FROM buck")
def bucket_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir).select("eid", F.array_join(F.col("b").cast("array<string>"), "").alias("buckets"))


@query(f"WITH {fx.CUTS} SELECT eid, array_to_string(flatten(list_transform(b, lambda x: [x & 1, x >> 1])), '') AS planes FROM buck")
def bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir).select("eid", F.array_join(bits.bit_planes(F.col("b"), fx.NBITS).cast("array<string>"), "").alias("planes"))


@query(f"WITH {fx.CUTS} SELECT eid, array_to_string(b, '') AS buckets FROM buck")
def unbinarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _buckets(spark, sf_dir).select("eid", bits.bit_planes(F.col("b"), fx.NBITS).alias("planes")).select("eid", bits.from_planes(F.col("planes"), fx.NBITS).alias("b"))
    return back.select("eid", F.array_join(F.col("b").cast("array<string>"), "").alias("buckets"))


@query(_HEX)
def pack_bits_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir).select("eid", F.lower(bits.pack_hex(bits.bit_planes(F.col("b"), fx.NBITS))).alias("bytes"))


@query(f"WITH {fx.CUTS} SELECT eid, array_to_string(flatten(list_transform(b, lambda x: [x & 1, x >> 1])), '') AS planes FROM buck")
def unpack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    compressed, _ = _compressed(spark, sf_dir)
    return compressed.select("eid", F.array_join(bits.unpack(F.col("residual")).cast("array<string>"), "").alias("planes"))


@query(_HEX)
def binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = _codec(spark, sf_dir)
    return _residuals(spark, sf_dir).select("eid", F.lower(F.hex(coding.binarize(F.col("residual"), codec, 64))).alias("bytes"))


@query(f"WITH {fx.CUTS} SELECT eid, pid, code, {fx.HEXED} AS bytes FROM buck")
def compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    compressed, _ = _compressed(spark, sf_dir)
    return compressed.select("eid", "pid", "code", F.lower(F.hex("residual")).alias("bytes"))


@query(f"WITH {fx.CUTS}, x AS (SELECT eid, list_transform(b, lambda i: w[i + 1]) AS v FROM buck, codec) {sql_entries('x', 'v', 'eid')}")
def decompress_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    compressed, codec = _compressed(spark, sf_dir)
    return entries(compressed.select("eid", coding.decompress_residuals(F.col("residual"), codec).alias("v")), "v", "eid")


@query(f"WITH {fx.DECODED} SELECT eid, i::INTEGER AS i, round(d[i], 4) + 0.0 AS x FROM deco, LATERAL (SELECT unnest(range(1, len(d) + 1)) AS i)")
def decompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    compressed, codec = _compressed(spark, sf_dir)
    rows = coding.decompress(compressed.select("eid", "code", "residual"), fx.cent(spark, sf_dir), codec)
    return rows.select("eid", F.posexplode("embedding").alias("p", "e")).select("eid", (F.col("p") + 1).alias("i"), (F.round(F.col("e").cast("double"), 4) + 0.0).alias("x"))


# Index


@query(f"WITH {fx.CODES} SELECT cid, coalesce(string_agg(eid::VARCHAR, ',' ORDER BY eid), '') AS eids FROM cent LEFT JOIN codes ON cid = code GROUP BY cid")
def build_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    ivf = ranking.build_ivf(_coded(spark, sf_dir), fx.cent(spark, sf_dir).count())
    return ivf.select("cid", F.array_join(F.col("eids").cast("array<string>"), ",").alias("eids"))


@query(f"WITH {fx.CODES} SELECT cid, count(eid)::INTEGER AS len FROM cent LEFT JOIN codes ON cid = code GROUP BY cid")
def ivf_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.build_ivf(_coded(spark, sf_dir), fx.cent(spark, sf_dir).count()).select("cid", "len")


# Search


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.probe(fx.query_vectors(spark, sf_dir), fx.cent(spark, sf_dir), fx.NPROBE)


def _search(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """The best passages of the first n queries, or of all."""
    compressed, codec = _compressed(spark, sf_dir)
    centroids, queries = fx.cent(spark, sf_dir), fx.query_vectors(spark, sf_dir, n)
    candidates = ranking.retrieve(ranking.probe(queries, centroids, fx.NPROBE), _coded(spark, sf_dir))
    rows = ranking.gather(compressed, candidates).select("qid", "pid", "code", "residual")
    return ranking.top_k(ranking.maxsim(rows, queries, (centroids, codec)), TOP, "qid")


@query(f"WITH {fx.CODES}, {fx.probe_cte()} SELECT qid, qpos, rank, cid, round(score, 5) AS score FROM probe")
def topk_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir).select("qid", "qpos", "rank", "cid", rounded("score"))


@query(f"WITH {fx.CODES}, {fx.probe_cte()} SELECT DISTINCT cid, eid FROM probe JOIN codes ON cid = code")
def cids_to_eids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cids = _probe(spark, sf_dir).select("cid").distinct()
    return _coded(spark, sf_dir).select(F.col("code").alias("cid"), "eid").join(cids, "cid").select("cid", "eid")


@query(f"WITH {fx.CODES}, {fx.probe_cte()} SELECT qid, pid FROM cand")
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.retrieve(_probe(spark, sf_dir), _coded(spark, sf_dir))


@query(f"WITH {fx.CUTS}, {fx.probe_cte()} SELECT qid, pid, eid, code, {fx.HEXED} AS bytes FROM cand JOIN buck USING (pid)")
def gather_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    compressed, _ = _compressed(spark, sf_dir)
    rows = ranking.gather(compressed, ranking.retrieve(_probe(spark, sf_dir), _coded(spark, sf_dir)))
    return rows.select("qid", "pid", "eid", "code", F.lower(F.hex("residual")).alias("bytes"))


@query(f"WITH {fx.TOK}, {fx.queries_cte()} SELECT qid, pid, round(sum(m), 5) AS score FROM (SELECT qid, pid, qpos, max(list_inner_product(q, v)) AS m FROM tok, q GROUP BY ALL) GROUP BY ALL")
def maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = fx.query_vectors(spark, sf_dir)
    # A stated query set against all rows.
    rows = fx.tok(spark, sf_dir).select("pid", "embedding")
    return ranking.maxsim_of_passages(rows, ranking.query_vectors(queries.toArrow())).select("qid", "pid", rounded("score"))


@query(f"WITH {fx.search_cte(TOP, 1)} SELECT rank, pid, round(score, 4) AS score FROM hits")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, 1).select("rank", "pid", F.round("score", 4).alias("score"))


@query(f"WITH {fx.search_cte(TOP)} SELECT qid, rank, pid, round(score, 4) AS score FROM hits")
def search_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).select("qid", "rank", "pid", F.round("score", 4).alias("score"))


@query(f"WITH {fx.search_cte(TOP)} SELECT qid, rank, pid, source, md5(text) AS digest FROM hits JOIN documents ON doc_id + 1 = pid")
def hydrate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("pid"), "source", "text")
    return hydrate(_search(spark, sf_dir), docs).select("qid", "rank", "pid", "source", F.md5(F.col("text").cast("binary")).alias("digest"))


# A stored index: the embeddings table with the fixture's centroids and codec, written and read as any index.

_CHUNK = 25


def stored_index(spark: SparkSession, sf_dir: str) -> str:
    """The path of a fresh one."""
    compressed, codec = _compressed(spark, sf_dir)
    centroids, path = fx.cent(spark, sf_dir), scratch(spark, "stored")
    store.save_config(spark, path, RetrievalConfig(dim=64, nbits=fx.NBITS, nprobe=fx.NPROBE, chunksize=_CHUNK, index_path=path))
    store.save_codec(spark, path, centroids, codec)
    pids = compressed.select("pid").distinct()
    plan = {"chunksize": _CHUNK, "num_documents": pids.count(), "num_partitions": centroids.count()}
    write_index(spark, path, compressed.select("pid", "pos", "code", "residual"), pids, plan)
    return path


@query(f"WITH {fx.search_cte(TOP)} SELECT qid, rank, pid, round(score, 4) AS score FROM hits")
def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Searcher(spark, stored_index(spark, sf_dir)).search_vectors(fx.query_vectors(spark, sf_dir), TOP)
    return found.select("qid", "rank", "pid", F.round("score", 4).alias("score"))


@query(f"WITH {fx.CUTS} SELECT eid, pid, code, {fx.HEXED} AS bytes, ((pid - 1) // {_CHUNK} + 1)::INTEGER AS chunk_id FROM buck")
def load_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.load_compressed(spark, stored_index(spark, sf_dir))
    return rows.select("eid", "pid", "code", F.lower(F.hex("residual")).alias("bytes"), "chunk_id")


@query(f"WITH {fx.CODES} SELECT eid, code FROM codes")
def load_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.load_codes(spark, stored_index(spark, sf_dir))


@query(f"WITH {fx.CODES} SELECT code, eid, pid FROM codes")
def load_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.load_postings(spark, stored_index(spark, sf_dir)).select("code", "eid", "pid")


@query("SELECT vec_id // 8 + 1 AS pid, count(*)::INTEGER AS doclen FROM embeddings GROUP BY 1")
def load_doclens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.load_doclens(spark, stored_index(spark, sf_dir))


@query(f"""WITH d AS (SELECT DISTINCT vec_id // 8 + 1 AS pid FROM embeddings), c AS (SELECT (pid - 1) // {_CHUNK} + 1 AS c, min(pid) - 1 AS a, count(*) AS p FROM d GROUP BY 1),
e AS (SELECT (vec_id // 8) // {_CHUNK} + 1 AS c, count(*) AS n FROM embeddings GROUP BY 1)
SELECT c::INTEGER AS chunk_id, a AS passage_offset, p AS num_passages, n::BIGINT AS num_embeddings, (1 + coalesce(sum(n) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS embedding_offset
FROM c JOIN e USING (c)""")
def load_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.load_chunks(spark, stored_index(spark, sf_dir)).select("chunk_id", "passage_offset", "num_passages", "num_embeddings", "embedding_offset")


@query(f"WITH c AS (SELECT DISTINCT (vec_id // 8) // {_CHUNK} + 1 AS c FROM embeddings) SELECT c::INTEGER AS chunk_id, 10 * c AS mark FROM c")
def save_chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored_index(spark, sf_dir)
    store.save_chunk_metadata(spark, path, "mark", store.load_chunks(spark, path).select("chunk_id", (F.col("chunk_id") * 10).cast("long").alias("mark")))
    return store.chunk_metadata(spark, path, "mark")


@query(f"WITH {fx.CUTS} SELECT 'centroid ' || cid AS part, i::INTEGER AS i, round(c[i], 5) + 0.0 AS x FROM cent, range(1, 65) r(i) UNION ALL SELECT 'cutoffs', i::INTEGER, round(cuts[i], 5) + 0.0 FROM codec, range(1, 4) r(i) UNION ALL SELECT 'weights', i::INTEGER, round(w[i], 5) + 0.0 FROM codec, range(1, 5) r(i)")
def load_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids, codec = store.load_codec(spark, stored_index(spark, sf_dir))
    rows = entries(centroids, "vector", "cid").select(F.concat(F.lit("centroid "), "cid").alias("part"), "i", "x")
    for name, values in (("cutoffs", codec.cutoffs), ("weights", codec.weights)):
        rows = rows.unionByName(_numbered(spark, values).withColumn("part", F.lit(name)))
    return rows


@query(f"SELECT {fx.NBITS}::INTEGER AS nbits, 64 AS dim, {_CHUNK} AS chunksize, count(*) AS num_embeddings, count(DISTINCT vec_id // 8) AS num_documents, ceil(count(DISTINCT vec_id // 8) / {_CHUNK})::BIGINT AS num_chunks FROM embeddings")
def load_config_and_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored_index(spark, sf_dir)
    config, plan = store.load_config(spark, path), store.load_record(spark, path, "plan")
    row = (config.nbits, config.dim, config.chunksize, plan["num_embeddings"], plan["num_documents"], plan["num_chunks"])
    return spark.createDataFrame([row], "nbits int, dim int, chunksize int, num_embeddings long, num_documents long, num_chunks long")


@query(f"""WITH c AS (SELECT DISTINCT (vec_id // 8) // {_CHUNK} + 1 AS c FROM embeddings)
SELECT unnest(['config', 'plan', 'codec', 'centroids', 'doclens', 'chunks', 'compressed', 'ivf']) AS part, true AS present UNION ALL SELECT 'chunk ' || c, true FROM c""")
def check_index_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.check_complete(spark, stored_index(spark, sf_dir))


# Evaluation


#: Longest common subsequence of every two different names by bit-parallel additions, a character of the first at a time.
_LCS = """WITH RECURSIVE names AS (SELECT n_nationkey AS k, n_name AS s FROM nation),
pairs AS (SELECT a.k AS a_key, b.k AS b_key, a.s AS a, b.s AS b, (1::HUGEINT << length(b.s)) - 1 AS whole FROM names a JOIN names b ON a.k <> b.k),
steps AS (SELECT a_key, b_key, a, b, whole, 0 AS i, whole AS v FROM pairs
  UNION ALL SELECT a_key, b_key, a, b, whole, i + 1, ((v + (v & m)) | (v & (whole - m))) & whole FROM (
    SELECT *, coalesce(list_sum(list_transform(range(1, length(b) + 1), lambda j: CASE WHEN substr(b, j::INTEGER, 1) = substr(a, (i + 1)::INTEGER, 1) THEN 1::HUGEINT << (j - 1)::INTEGER ELSE 0::HUGEINT END)), 0)::HUGEINT AS m
    FROM steps WHERE i < length(a))),
lcs AS (SELECT a_key, b_key, round(1.0 - (length(b) - bit_count(v)) / least(length(a), length(b)), 6)::DOUBLE AS distance FROM steps WHERE i = length(a))"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(f"{x}_key"), F.col("n_name").alias(x)) for x in "ab")
    pairs = a.join(b, F.col("a_key") != F.col("b_key"))
    return pairs.select("a_key", "b_key", F.round(evaluate.lcs_distance_udf("a", "b"), 6).alias("distance"))


@query(f"{_LCS} SELECT a_key, b_key, distance FROM lcs")
def lcs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir)


@query(f"{_LCS} SELECT a_key AS qid, min(distance) AS distance FROM lcs GROUP BY a_key")
def best_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_distance(_names(spark, sf_dir).withColumnRenamed("a_key", "qid"))


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, want): the passage that a query is made of."""
    return fx.query_vectors(spark, sf_dir).select("qid", (F.floor(F.col("qid") / 8) + 1).alias("want")).distinct()


@query(f"""WITH {fx.search_cte(TOP)}, want AS (SELECT DISTINCT qid, qid // 8 + 1 AS pid FROM q)
SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.qid = want.qid AND h.pid = want.pid AND rank <= 5) THEN 1.0 ELSE 0.0 END)::DOUBLE AS success FROM want""")
def success_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _own(spark, sf_dir).join(_search(spark, sf_dir).where("rank <= 5"), "qid", "left").select("qid", F.when(F.col("pid") == F.col("want"), 0.0).otherwise(1.0).alias("distance"))
    return evaluate.success_rate(evaluate.best_distance(hits))


@query()
def success_at_k_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success@5 by the LCS distance of the found texts from that of the query's own passage."""
    docs = fx.passages(spark, sf_dir)
    hits = _own(spark, sf_dir).join(_search(spark, sf_dir).where("rank <= 5").select("qid", "pid"), "qid", "left")
    texts = hits.join(docs, "pid", "left").join(docs.select(F.col("pid").alias("want"), F.col("text").alias("own")), "want", "left")
    return evaluate.success_rate(evaluate.best_distance(texts.select("qid", evaluate.lcs_distance_udf("text", "own").alias("distance"))))


# Encoding by the hash encoder: the signs of its numbers, whose arithmetic modulo 2 ** 64 SQL can repeat

_DIM = 8
_CONFIG = RetrievalConfig(dim=_DIM)


def _times(a: str, c: int) -> str:
    """SQL for a * c modulo 2 ** 64 in halves of 32 bits."""
    low, high, half, all_ = c & 0xFFFFFFFF, c >> 32, "4294967295::HUGEINT", "18446744073709551615::HUGEINT"
    return f"(((({a}) & {half}) * {low}::HUGEINT + ((((({a}) >> 32) * {low}::HUGEINT + (({a}) & {half}) * {high}::HUGEINT) & {half}) << 32)) & {all_})"


def _signs(ids: str) -> str:
    """SQL of tables that end in signs (token_id, bits): bit j - 1 is set where the j-th number is above 0."""
    mask = "18446744073709551615::HUGEINT"
    return f"""uniq AS (SELECT DISTINCT token_id FROM {ids}),
s0 AS (SELECT token_id, j, ({_times('token_id::HUGEINT', 0x9E3779B97F4A7C15)} + {_times('j::HUGEINT', 0xD1B54A32D192ED03)}) & {mask} AS h FROM uniq, range(1, {_DIM + 1}) r(j)),
s1 AS (SELECT token_id, j, xor(h, h >> 30) AS h FROM s0), s2 AS (SELECT token_id, j, {_times('h', 0xBF58476D1CE4E5B9)} AS h FROM s1),
s3 AS (SELECT token_id, j, xor(h, h >> 27) AS h FROM s2), s4 AS (SELECT token_id, j, {_times('h', 0x94D049BB133111EB)} AS h FROM s3),
signs AS (SELECT token_id, sum(CASE WHEN (xor(h, h >> 31) >> 40) > 8388608 THEN 1 << (j - 1)::INTEGER ELSE 0 END)::BIGINT AS bits FROM s4 GROUP BY token_id)"""


def _signed(rows: DataFrame, key: str) -> DataFrame:
    """Vectors and a sum of their signs that depends on their positions."""
    bits = sum((F.when(F.get("embedding", F.lit(j)) > 0, F.lit(1 << j)).otherwise(0) for j in range(1, _DIM)), F.when(F.get("embedding", F.lit(0)) > 0, F.lit(1)).otherwise(0))
    return rows.select(key, rows.columns[1], bits.alias("b")).groupBy(key).agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.col(rows.columns[1]) * F.col("b")).alias("signs"))


_SKIP = f"skip AS (SELECT list_append(list_transform([{_PUNCT}], lambda x: {fx.TOKEN_ID}), 0) AS s)"


@query(f"""WITH {fx.TOKENS}, {_IDS}, {_CUT}, {_MARKED}, {_SKIP}, each AS (SELECT pid, i, token_id FROM ({_unnested('marked')}), skip WHERE NOT list_contains(s, token_id)), {_signs('each')}
SELECT pid, count(*) AS vectors, sum(i * bits)::BIGINT AS signs FROM each JOIN signs USING (token_id) GROUP BY pid""")
def encode_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(encode.encode_passages(fx.passages(spark, sf_dir), encode.HashEncoder(_DIM), _CONFIG), "pid")


@query(f"""WITH {_QTOKS}, {_IDS}, {_MASKED}, each AS ({_unnested('masked')}), {_signs('each')}
SELECT pid AS qid, count(*) AS vectors, sum(i * bits)::BIGINT AS signs FROM each JOIN signs USING (token_id) GROUP BY pid""")
def encode_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return _signed(encode.encode_queries(items, encode.HashEncoder(_DIM), _CONFIG), "qid")


# A whole index with k-means: no SQL form


def _built(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "index")
    Indexer(spark, RetrievalConfig(index_path=path), fx.passages(spark, sf_dir)).index()
    return path


@query()
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50 is searched by its own text in an index of all documents; qid is its doc_id."""
    queries = fx.table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "text")
    return Searcher(spark, _built(spark, sf_dir)).search_many(queries, 3).select("qid", "rank", "pid", F.round("score", 3).alias("score"))
