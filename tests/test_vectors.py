import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lateweave.functions import bits, vec
from lateweave.operators import codec as coding
from lateweave.operators import kmeans, planning


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*x, kind="double"):
    return F.array(*[F.lit(v) for v in x]).cast(f"array<{kind}>")


def test_normalize_keeps_zero_vectors(spark):
    assert value(spark, vec.normalize(arr(0.0, 0.0))) == [0.0, 0.0]
    assert math.isclose(sum(x * x for x in value(spark, vec.normalize(arr(3.0, 4.0)))), 1.0, abs_tol=1e-6)


def test_dot_and_distance(spark):
    assert value(spark, vec.dot(arr(1.0, 2.0), arr(3.0, 4.0))) == 11.0
    assert value(spark, vec.l2sq(arr(1.0, 2.0), arr(3.0, 4.0))) == 8.0


def test_bucket_of_an_equal_value_is_the_lower(spark):
    assert value(spark, coding.bucket_indices(arr(1.0, 6.0, 3.0, 12.0, 5.0), [0.0, 5.0, 10.0, 15.0])) == [1, 2, 1, 3, 1]


def test_bits_round_trip(spark):
    values = arr(0, 1, 2, 3, 3, 2, 1, 0, kind="int")
    planes = bits.bit_planes(values, 2)
    assert value(spark, planes) == [0, 0, 1, 0, 0, 1, 1, 1, 1, 1, 0, 1, 1, 0, 0, 0]
    assert value(spark, bits.from_planes(planes, 2)) == [0, 1, 2, 3, 3, 2, 1, 0]
    assert value(spark, bits.unpack(bits.pack(planes))) == value(spark, planes)
    assert value(spark, bits.pack_hex(arr(*[1, 0] * 8, kind="int"))) == "5555"


def test_numpy_and_sql_bit_layouts_agree(spark):
    values = np.random.default_rng(1).integers(0, 8, (5, 16))
    packed = coding.pack_matrix(values, 3)
    assert (coding.unpack_matrix(packed, 3) == values).all()
    for row, data in zip(values.tolist(), packed):
        assert value(spark, bits.pack(bits.bit_planes(arr(*row, kind="int"), 3))) == bytearray(data.tobytes())


def test_bit_errors(spark):
    with pytest.raises(Exception, match="values must be in"):
        value(spark, bits.bit_planes(arr(4, kind="int"), 2))
    with pytest.raises(Exception, match="multiple of 8"):
        value(spark, bits.pack(arr(1, 0, 1, kind="int")))
    with pytest.raises(ValueError):
        coding.check(12, 2, [0.0, 1.0, 2.0])
    with pytest.raises(ValueError):
        coding.check(16, 2, [0.0])


def test_codec_quantiles(spark):
    rows = spark.createDataFrame([([i / 1000 for i in range(1001)],)], "residual array<double>")
    codec = coding.fit(rows, 2)
    assert np.allclose(codec.cutoffs, [0.25, 0.5, 0.75])
    assert np.allclose(codec.weights, [0.125, 0.375, 0.625, 0.875])


def test_compress_then_decompress_is_near(spark):
    rng = np.random.default_rng(2)
    centroids = rng.normal(size=(4, 16))
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    x = centroids[rng.integers(0, 4, 60)] + rng.normal(size=(60, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(centroids)], "cid int, vector array<double>")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "eid long, embedding array<float>")
    codec = coding.fit(coding.residuals(coding.codes(df, c), c), 4)
    compressed = coding.compress(df, c, codec)
    assert compressed.columns == ["eid", "code", "residual"]
    back = {r["eid"]: r["embedding"] for r in coding.decompress(compressed, c, codec).collect()}
    assert max(np.abs(np.array(back[i]) - x[i]).max() for i in range(60)) < 0.05


def test_kmeans_points_as_clusters(spark):
    points = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(8)], "eid long, embedding array<double>")
    first = kmeans.first_centroids(points, 8)
    centroids, turns, converged = kmeans.fit(points, first)
    assert converged and turns == 1
    assert kmeans.assign(points, centroids).select("cid").distinct().count() == 8


def test_kmeans_empty_cluster_becomes_zero(spark):
    points = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.2])], "eid long, embedding array<double>")
    c = spark.createDataFrame([(1, [1.0, 1.0]), (2, [9.0, 9.0])], "cid int, vector array<double>")
    got = {r["cid"]: r["vector"] for r in kmeans.step(points, c).collect()}
    assert np.allclose(got[1], [1.0, 1.1]) and got[2] == [0.0, 0.0]


def test_dimension_mismatch():
    with pytest.raises(ValueError):
        kmeans.nearest_l2(np.zeros((2, 3)), np.zeros((2, 4)))


@pytest.mark.parametrize("n,avg,k", [(10, 178.28572, 512), (1000, 233.2516, 4096), (141431, 62.15259, 32768)])
def test_number_of_clusters(n, avg, k):
    assert planning.plan(n, avg, 10**9)["num_partitions"] == k


def test_offsets(spark):
    chunks = spark.createDataFrame([(1, 3), (2, 5), (3, 2)], "chunk_id int, num_embeddings long")
    assert [r["embedding_offset"] for r in planning.offsets(chunks).orderBy("chunk_id").collect()] == [1, 4, 9]


def test_heldout_and_samples(spark):
    assert planning.heldout_size(10) == 1 and planning.heldout_size(10**9) == 50_000
    t = spark.range(100).withColumnRenamed("id", "eid")
    train, held = planning.heldout_split(t, 5)
    assert train.count() == 95 and held.count() == 5 and train.intersect(held).isEmpty()
    pids = planning.sample_pids(spark, 10, seed=3).collect()
    assert len({r["pid"] for r in pids}) == len(pids) <= 10
    assert value(spark, planning.head(arr(1, 2, 3))) == [1.0, 2.0] and value(spark, planning.head(F.array().cast("array<int>"))) == []
