"""Steps whose cost must grow no faster than their input, on small tables."""

import hashlib
import random
import re
import time
from itertools import accumulate

import numpy as np
from pyspark.sql import functions as F

from lateweave.operators import codec as coding
from lateweave.operators import evaluate, kmeans, planning
from lateweave.plans import registry
from lateweave.searcher import Searcher

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_a_sample_sorts_only_the_border_of_its_hashes(spark):
    rows = spark.range(1, 50_001, numPartitions=4).withColumnRenamed("id", "pid")
    found = planning.sample_pids_by_hash(rows, 20_000)
    assert all(int(n) < 100 for n in re.findall(r"(?:limit=|Limit )(\d+)", plan(found)))
    want = sorted(range(1, 50_001), key=lambda p: hashlib.md5(f"0/{p}".encode()).hexdigest())[:20_000]
    assert sorted(r["pid"] for r in found.collect()) == sorted(want)
    # Copies of one key are rows of one hash; more than there are, and none.
    same = spark.createDataFrame([(7,)] * 9 + [(8,)], "pid long")
    assert planning.sample_pids_by_hash(same, 5).count() == 5 and planning.sample_pids_by_hash(same, 99).count() == 10
    assert planning.sample_pids_by_hash(same.where("pid < 0"), 5).count() == 0


def test_maxsim_reads_every_passage_once(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = registry.maxsim(spark, DATA)
    assert "BroadcastNestedLoopJoin" not in plan(df) and "CartesianProduct" not in plan(df)
    v = np.array([x for _, x in sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect())], np.float64)
    want = {(q, p + 1): (v[8 * p : 8 * p + 8] @ v[q : q + 4].T).max(0).sum() for q in range(0, len(v), 50) for p in range(-(-len(v) // 8))}
    try:
        # Passages that lie in several batches, and products in blocks.
        for size in (old, "3", "8", "20"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {(r["qid"], r["pid"]): r["score"] for r in registry.maxsim(spark, DATA).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_equal_points_are_one_weighted_point(spark):
    rng = np.random.default_rng(5)
    kinds = rng.normal(size=(30, 8)).astype(np.float32)
    points = spark.createDataFrame([(i, kinds[k].tolist()) for i, k in enumerate(rng.integers(0, 30, 400))], "eid long, embedding array<float>").cache()
    first = kmeans.first_centroids(points, 40)
    some = kmeans.distinct(points)
    assert some.count() == 30
    a, b = (np.array([r["vector"] for r in kmeans.fit(p, first, count=n, max_iters=3, tol=0.0)[0].orderBy("cid").collect()]) for p, n in ((points, None), (some, "n")))
    assert a.shape == (40, 8) and np.allclose(a, b)


def test_many_queries_make_no_rows_of_candidates(spark, monkeypatch):
    vectors, searcher = registry.fx.query_vectors(spark, DATA), Searcher(spark, registry.stored_index(spark, DATA))
    whole = {(r["qid"], r["rank"], r["pid"], round(r["score"], 9)) for r in searcher.search_vectors(vectors, 4).collect()}
    monkeypatch.setattr("lateweave.searcher.FEW_VECTORS", 5)
    many = searcher.search_vectors(vectors, 4)
    assert "Join" not in plan(many)
    assert {(r["qid"], r["rank"], r["pid"], round(r["score"], 9)) for r in many.collect()} == whole


def test_lcs_of_long_texts_is_its_definition():
    rng = random.Random(3)
    for n, m in ((0, 4), (1, 1), (7, 40), (65, 64), (130, 90)):
        a, b = ("".join(rng.choice("abcé\U0001f600") for _ in range(k)) for k in (n, m))
        row = [0] * (m + 1)
        for c in a:
            row = [0, *accumulate((max(row[j + 1], row[j] + 1 if b[j] == c else 0) for j in range(m)), max)]
        assert evaluate.lcs_length(a, b) == evaluate.lcs_length(b, a) == row[-1]
    a, b = ("".join(rng.choices("abcdefgh ", k=20_000)) for _ in range(2))
    began = time.process_time()
    assert 8_000 < evaluate.lcs_length(a, b) < 20_000
    assert time.process_time() - began < 0.5


def test_a_chunk_is_written_by_one_task(spark):
    path = registry.stored_index(spark, DATA)
    files = spark.read.parquet(f"{path}/compressed").select("chunk_id", F.input_file_name().alias("f")).distinct().groupBy("chunk_id").count()
    assert {r["count"] for r in files.collect()} == {1}


def test_a_codec_is_fitted_without_one_buffer_of_all_entries(spark, monkeypatch):
    monkeypatch.setattr(coding.F, "percentile", None)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=999), np.zeros(300), -rng.random(50) * 1e-9, [5.0, -7.0]])
    rows = spark.createDataFrame([(part.tolist(),) for part in np.array_split(x, 50)], "residual array<double>")
    codec = coding.fit(rows, 2)
    assert np.allclose(codec.cutoffs + codec.weights, np.quantile(x, [0.25, 0.5, 0.75, 0.125, 0.375, 0.625, 0.875]), rtol=1e-12, atol=0)
    assert np.isclose(codec.avg_residual, np.abs(x).mean())
