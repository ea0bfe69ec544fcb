import dataclasses
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lateweave.config import RetrievalConfig
from lateweave.indexer import Indexer
from lateweave.operators import codec as coding
from lateweave.operators import encode, evaluate, kmeans, ranking, tokenize
from lateweave.plans import registry
from lateweave.searcher import Searcher, hydrate
from lateweave.sources import passages, store
from lateweave.streaming.append import append_stream

DATA = "/root/testdata/sf0.001"
TEXTS = ["The quick brown fox jumps over the lazy dog.", "A pipeline of Spark jobs, scheduled nightly.", "Bread needs flour, water, salt and time.", "", "Foxes are quick; dogs are lazy.", "Time flies like an arrow, fruit flies like a banana."]
CONFIG = RetrievalConfig(dim=32, doc_maxlen=24, query_maxlen=8, chunksize=2, kmeans_niters=3)


def ids(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_marker(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<int>")
    assert ids(spark, tokenize.add_marker(a(7, 8, 9), 2)) == [7, 2, 8, 9]
    assert ids(spark, tokenize.add_marker(a(7), 2)) == [7, 2]
    assert ids(spark, tokenize.add_marker(a(), 2)) == [2]


def test_query_has_exact_length_and_masks(spark):
    got = ids(spark, tokenize.query_ids(F.lit("two words"), 8))
    assert len(got) == 8 and got[:2] == [tokenize.CLS, tokenize.QUERY_MARK] and got[-1] == tokenize.MASK
    assert ids(spark, tokenize.query_attention(F.lit("two words"), 8, False)) == [True] * 5 + [False] * 3
    assert ids(spark, tokenize.query_ids(F.lit("a " * 50), 8))[-1] != tokenize.SEP


def test_document_truncation_loses_the_end(spark):
    assert len(ids(spark, tokenize.document_ids(F.lit("a " * 100), 24))) == 24
    assert ids(spark, tokenize.document_ids(F.lit(None).cast("string"), 24)) == [tokenize.CLS, tokenize.DOC_MARK, tokenize.SEP]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rstill two\nthree")
    assert [(r["pid"], r["text"]) for r in passages.lines(spark, str(tmp_path / "a.txt")).orderBy("pid").collect()] == [(1, "one"), (2, "two\rstill two"), (3, "three")]
    (tmp_path / "b.tsv").write_text('5\ta "quoted\tfield\n6\tplain\n')
    assert [(r["pid"], r["text"]) for r in passages.tsv(spark, str(tmp_path / "b.tsv")).orderBy("pid").collect()] == [(5, 'a "quoted\tfield'), (6, "plain")]


def test_emb2pid_skips_empty_passages(spark):
    lens = spark.createDataFrame([(1, 3), (2, 0), (3, 2)], "pid long, doclen int")
    assert [(r["eid"], r["pid"]) for r in ranking.emb2pid(lens).orderBy("eid").collect()] == [(1, 1), (2, 1), (3, 1), (4, 3), (5, 3)]


def test_ivf_keeps_empty_clusters(spark):
    coded = spark.createDataFrame([(1, 2), (2, 1), (3, 2)], "eid long, code int")
    assert [(r["cid"], r["eids"], r["len"]) for r in ranking.build_ivf(coded, 3).orderBy("cid").collect()] == [(1, [2], 1), (2, [1, 3], 2), (3, [], 0)]


def test_maxsim_literal(spark):
    rows = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (0, 2, [0.5, 0.5])], "qid long, pid long, embedding array<double>")
    queries = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.0, 0.5])], "qid long, qpos int, embedding array<double>")
    assert {r["pid"]: r["score"] for r in ranking.maxsim(rows, queries).collect()} == {1: 1.5, 2: 0.75}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "idx")
    config = dataclasses.replace(CONFIG, index_path=path)
    assert Indexer(spark, config, TEXTS).index() is True
    return path, config


def test_index_and_search(spark, built):
    path, config = built
    assert Indexer(spark, config, TEXTS).index() is None
    pids, scores = Searcher(spark, path).search("lazy quick fox", 3)
    assert set(pids[:2]) == {1, 5} and scores == sorted(scores, reverse=True)
    many = passages.strings(spark, ["bread flour", "banana arrow"]).withColumnRenamed("pid", "qid")
    found = Searcher(spark, path).search_many(many, 1)
    assert {r["qid"]: r["pid"] for r in found.collect()} == {1: 3, 2: 6}
    assert hydrate(found, passages.strings(spark, TEXTS)).count() == 2


def test_stored_tables(spark, built):
    path, config = built
    assert store.load_config(spark, path) == config
    assert store.load_doclens(spark, path).count() == len(TEXTS)
    assert [r["passage_offset"] for r in store.chunk_metadata(spark, path, "passage_offset").collect()] == [0, 2, 4]
    compressed = store.load_compressed(spark, path)
    n = compressed.count()
    assert [r["eid"] for r in compressed.orderBy("eid").collect()] == list(range(1, n + 1))
    assert store.is_complete(spark, path)
    with pytest.raises(FileNotFoundError):
        Searcher(spark, path + "-none")
    with pytest.raises(FileNotFoundError):
        store.load_codec(spark, path + "-none")


def test_stream_appends_once(spark, built, tmp_path):
    path, _ = built
    passages.strings(spark, TEXTS[:2]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pid long, text string").parquet(str(tmp_path / "in"))
    append_stream(stream, path, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("pid").distinct().count() == 2


def test_index_queries_cover_the_documents(spark, monkeypatch):
    paths, built_by = [], registry._built
    monkeypatch.setattr(registry, "_built", lambda *a: paths.append(built_by(*a)) or paths[-1])
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = registry.index_roundtrip(spark, DATA).collect()
    assert {r["qid"] for r in got} == {r["doc_id"] for r in docs.where("doc_id % 50 = 0").collect()}
    assert {r["pid"] for r in spark.read.parquet(f"{paths[0]}/doclens").collect()} == {r["doc_id"] + 1 for r in docs.collect()}
    assert store.load_config(spark, paths[0]) == RetrievalConfig(index_path=paths[0])
    assert store.is_complete(spark, paths[0])


def test_distances_of_all_embeddings(spark):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect())
    v = np.array([x for _, x in rows], np.float64)
    want = ((v[:, None] - v[None, ::16]) ** 2).sum(2)
    got = registry.QUERIES["l2_distances"](spark, DATA).toArrow().sort_by([("eid", "ascending"), ("cid", "ascending")])
    assert got.num_rows == want.size and np.allclose(got["distance"].to_numpy().reshape(want.shape), want, atol=2e-5)


def plain_ids(text):
    found = re.findall(r"\w+|[^\w \t\n\x0b\f\r]", text.lower())
    return [int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % 1048576 + 1000 for t in found]


def listed(spark, name):
    got = {}
    for r in registry.QUERIES[name](spark, DATA).orderBy("pid", "i").collect():
        got.setdefault(r["pid"], []).append(r["token_id"])
    return got


def test_whole_texts_and_default_lengths(spark):
    ids = {r["doc_id"] + 1: plain_ids(r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert max(map(len, ids.values())) > 300 and listed(spark, "token_ids") == ids
    cut = {k: [101, *v, 102][:299] for k, v in ids.items()}
    marked = {k: [v[0], 2, *v[1:]] for k, v in cut.items()}
    assert listed(spark, "doc_truncate") == cut and listed(spark, "marker_insert") == marked
    skip = {*(x for c in tokenize.skiplist(True) for x in plain_ids(c)), 0}
    doclens = {k: sum(x not in skip for x in v) for k, v in marked.items()}
    assert {r["pid"]: r["doclen"] for r in registry.doclens(spark, DATA).collect()} == doclens
    assert {r["pid"]: r["vectors"] for r in registry.encode_passages(spark, DATA).collect()} == doclens
    items = {r["item_id"]: plain_ids(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    padded = {k: [101, 1, *v, 102, *[103] * 32] for k, v in items.items()}
    assert listed(spark, "query_pad_mask") == {k: v[:32] for k, v in padded.items()}
    assert {r["vectors"] for r in registry.encode_queries(spark, DATA).collect()} == {32}


def test_every_query_is_searched(spark):
    v = np.array([x for _, x in sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect())], np.float64)
    compressed, codec = registry._compressed(spark, DATA)
    rows = coding.decompress(compressed.select("eid", "code", "residual"), registry.fx.cent(spark, DATA), codec).collect()
    decoded = np.array([x for _, x in sorted((r["eid"], r["embedding"]) for r in rows)])
    codes, want = (v @ v[::16].T).argmax(1), {}
    for q in range(0, len(v), 50):
        near = np.unique(np.argsort(-(v[q : q + 4] @ v[::16].T), axis=1, kind="stable")[:, :2])
        pids = sorted({int(e) // 8 + 1 for e in np.flatnonzero(np.isin(codes, near))})
        scores = {p: (decoded[8 * p - 8 : 8 * p] @ v[q : q + 4].T).max(0).sum() for p in pids}
        want[q] = sorted(pids, key=lambda p: -scores[p])[:10]
    for name in ("search_batched", "search_stored"):
        got = {}
        for r in registry.QUERIES[name](spark, DATA).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["pid"])
        assert got == want and len(got) == 10
    texts = {r["doc_id"] + 1: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    near = [min(evaluate.lcs_distance(texts[p], texts[q // 8 + 1]) for p in got[q][:5]) < 0.33 for q in got]
    assert registry.success_at_k_lcs(spark, DATA).first()["success"] == pytest.approx(np.mean(near))


def test_search_reads_only_the_partitions_it_needs(spark, monkeypatch):
    monkeypatch.setattr(store, "POSTINGS", 20)
    path = registry.stored_index(spark, DATA)
    searcher, vectors = Searcher(spark, path), registry.fx.query_vectors(spark, DATA, 1)
    parts = spark.read.parquet(f"{path}/ivf").select("codes").distinct().count()
    assert parts > 10

    def read(df, name):
        """Partitions that the scan of a table names."""
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        scan = next(x for x in plan.split("\n\n") if re.search(rf"Location: \S+ \[.*/{name}", x))
        return re.search(r"PartitionFilters: \[(.*)\]", scan)[1]

    candidates = searcher.candidates(vectors)
    assert "codes" in read(candidates, "ivf") and 0 < len(re.findall(r"\d+", read(candidates, "ivf").partition("IN")[2])) <= 8
    rows = searcher.embeddings(candidates)
    assert "chunk_id" in read(rows, "compressed")
    whole = ranking.retrieve(ranking.probe(vectors, searcher.centroids, 2), searcher.postings)
    assert {tuple(r) for r in candidates.collect()} == {tuple(r) for r in whole.collect()}


def test_many_queries_are_searched_in_parts(spark, monkeypatch):
    from lateweave import searcher

    path = registry.stored_index(spark, DATA)
    vectors = registry.fx.query_vectors(spark, DATA)

    def found():
        return {(r["qid"], r["rank"], r["pid"], round(r["score"], 9)) for r in Searcher(spark, path).search_vectors(vectors, 3).collect()}

    whole = found()
    assert len(whole) == 30
    monkeypatch.setattr(searcher, "FEW_CANDIDATES", 5)
    assert found() == whole
    monkeypatch.setattr(searcher, "FEW_VECTORS", 5)
    for queries, named in ((4096, 10_000), (3, 10_000), (3, 1)):
        monkeypatch.setattr(searcher, "QUERIES", queries)
        monkeypatch.setattr(searcher, "NAMED", named)
        assert found() == whole
    assert Searcher(spark, path).search_vectors(vectors.limit(0), 3).count() == 0


def test_products_in_blocks_give_the_same(monkeypatch):
    rng = np.random.default_rng(0)
    x, c = rng.integers(-3, 4, (57, 8)).astype(float), rng.integers(-3, 4, (41, 8)).astype(float)
    dots, dist = x @ c.T, ((x[:, None] - c[None]) ** 2).sum(2)
    order = np.argsort(-dots, axis=1, kind="stable")
    for points, numbers in ((1000, 1 << 22), (10, 70), (7, 7)):
        monkeypatch.setattr(kmeans, "POINTS", points)
        monkeypatch.setattr(kmeans, "NUMBERS", numbers)
        assert (kmeans.nearest_dot(x, c) == dots.argmax(1)).all() and (kmeans.nearest_l2(x, c) == dist.argmin(1)).all()
        for k in (1, 3, 41):
            rows, scores = kmeans.best_dot(x, c, k)
            assert (rows == order[:, :k]).all() and np.array_equal(scores, np.take_along_axis(dots, rows, 1))


def test_lines_of_several_pieces_are_numbered_in_order(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "c").mkdir()
    want = []
    for name, n in (("a", 300), ("b", 7), ("c", 900)):
        rows = [f"{name} {i} " + "x" * (i % 17) for i in range(n)]
        want += rows
        (tmp_path / "c" / f"{name}.txt").write_text("\n".join(rows) + "\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        got = passages.lines(spark, str(tmp_path / "c")).orderBy("pid").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["pid"], r["text"]) for r in got] == [(i + 1, t) for i, t in enumerate(want)]


class Recorder:
    """An encoder that notes what it is given."""

    dim = 8

    def __init__(self, folder):
        self.folder = folder

    def vectors(self, ids, attention):
        import uuid

        np.savez(f"{self.folder}/{uuid.uuid4().hex}", ids=ids, attention=attention)
        return np.ones((*ids.shape, 8), np.float32)


def given(folder):
    return [dict(np.load(f)) for f in sorted(folder.glob("*.npz"))]


def test_settings_of_documents_and_queries(spark, tmp_path):
    texts = passages.strings(spark, [f"{'word ' * i}." for i in range(10)]).coalesce(1)
    config = RetrievalConfig(dim=8, doc_maxlen=9, index_bsize=4, doc_token_id="[unused0]", mask_punctuation=False)
    rows = encode.encode_passages(texts, Recorder(str(tmp_path)), config).collect()
    batches = given(tmp_path)
    assert sorted(len(b["ids"]) for b in batches) == [2, 4, 4]
    assert all((b["ids"][:, 1] == tokenize.QUERY_MARK).all() and (b["attention"] == (b["ids"] != 0)).all() and b["ids"].shape[1] <= 9 for b in batches)
    # Ends, marker, words and the dot, cut to nine.
    assert Counter(r["pid"] for r in rows) == {i + 1: min(9, i + 4) for i in range(10)}
    for attend in (False, True):
        folder = tmp_path / f"q{attend}"
        folder.mkdir()
        config = RetrievalConfig(dim=8, query_maxlen=8, index_bsize=100, query_token_id="[unused1]", attend_to_mask_tokens=attend)
        assert encode.encode_queries(texts.withColumnRenamed("pid", "qid"), Recorder(str(folder)), config).count() == 80
        (batch,) = given(folder)
        assert (batch["ids"][:, 1] == tokenize.DOC_MARK).all() and batch["ids"].shape == (10, 8)
        assert (batch["attention"] == (True if attend else batch["ids"] != tokenize.MASK)).all()
    with pytest.raises(ValueError, match="special token"):
        encode.encode_queries(texts.withColumnRenamed("pid", "qid"), Recorder(""), RetrievalConfig(query_token_id="[none]"))
    with pytest.raises(ValueError, match="rank"):
        RetrievalConfig(rank=1)


def test_binarize_is_its_definition(spark):
    codec = coding.Codec((-0.5, 0.0, 0.5), (-0.7, -0.2, 0.2, 0.7), 0.4)
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.choice([-0.5, -0.4, 0.0, 0.1, 0.5, 0.9], 16)]) for i in range(50)] + [(99, None)], "i int, r array<double>")
    both = rows.select(coding.binarize(F.col("r"), codec, 16).alias("a"), coding.binarize_expression(F.col("r"), codec, 16).alias("b"), "r")
    assert all(x["a"] == x["b"] if x["r"] else x["a"] is None for x in both.collect())


def test_config_round_trip():
    c = dataclasses.replace(CONFIG, chunksize=None)
    assert RetrievalConfig.from_json(c.to_json()) == c
    with pytest.raises(ValueError):
        RetrievalConfig.from_json('{"nonsense": 1}')


def test_lcs(spark):
    assert evaluate.lcs_length("abcbdab", "bdcaba") == 4
    assert evaluate.lcs_distance("", "x") == 1.0 and evaluate.lcs_distance("abc", "xabcx") == 0.0


def test_no_passages_and_no_queries(spark):
    none = spark.createDataFrame([], "pid long, text string")
    assert encode.encode_passages(none, encode.HashEncoder(32), CONFIG).count() == 0
