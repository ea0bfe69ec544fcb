import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lateweave.config import RetrievalConfig
from lateweave.indexer import Indexer
from lateweave.operators import encode
from lateweave.searcher import Searcher
from lateweave.sources import checkpoint, passages

from . import onnx_file


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "tokenizer_config.json").write_text(json.dumps({"tokenizer_class": "BertTokenizerFast", "do_lower_case": True}))
    (tmp_path / "artifact.metadata").write_text(json.dumps({"dim": 16}))
    (tmp_path / "vocab.txt").write_text("\n".join(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "hello", "wor", "##ld", "!"]))
    return str(tmp_path)


def test_names():
    assert checkpoint.tokenizer_type("BertTokenizer") == checkpoint.tokenizer_type("BertTokenizerFast") == "bert"
    with pytest.raises(ValueError):
        checkpoint.tokenizer_type("Bert")


def test_type_column(spark):
    rows = spark.createDataFrame([("GPT2TokenizerFast",), ("nothing",), (None,)], "n string")
    assert [r["k"] for r in rows.select(checkpoint.tokenizer_type_column(F.col("n")).alias("k")).collect()] == ["gpt2", None, None]


def test_folder(spark, folder, tmp_path):
    config = checkpoint.load_local(folder, "config")
    assert config["dim"] == 16 and checkpoint.tokenizer_type(config["tokenizer_class"]) == "bert"
    tokens = checkpoint.load_local(f"{folder}:tokenizer")
    rows = spark.createDataFrame([("Hello world!",), ("",), (None,)], "t string")
    assert [r["x"] for r in rows.select(tokens.ids(F.col("t"), 10).alias("x")).collect()] == [[5, 6, 7, 8], [], []]
    assert [r["x"] for r in rows.select(tokens.ids(F.col("t"), 2).alias("x")).collect()] == [[5, 6], [], []]
    assert tokens.special("[CLS]") == 2 and tokens.of("!?") == [8]
    with pytest.raises(ValueError, match="special token"):
        tokens.special("[unused7]")
    for missing in (lambda: checkpoint.tokenizer_config(str(tmp_path / "none")), lambda: checkpoint.load_local(folder, "model"), lambda: checkpoint.load_local(folder)):
        with pytest.raises(FileNotFoundError):
            missing()
    with pytest.raises(ValueError):
        checkpoint.load_local(folder, "other")


def test_an_index_by_a_local_model(spark, folder, tmp_path):
    """Tokenizer and model of the configured folder, from building an index to searching it."""
    words = ["fox", "lazy", "dog", "bread", "flour", "water", "is", "the", ".", "[unused0]", "[unused1]"]
    vocab = [*(tmp_path / "vocab.txt").read_text().split("\n"), *words]
    (tmp_path / "vocab.txt").write_text("\n".join(vocab))
    table = np.random.default_rng(1).normal(size=(len(vocab), 16))
    (tmp_path / "model.onnx").write_bytes(onnx_file.model(table))
    tokens, encoder = checkpoint.load_local(folder)
    got = encoder.vectors(np.array([[2, 5, 0], [2, 3, 4]]), np.array([[1, 1, 0], [1, 1, 1]], bool))
    want = table.astype(np.float32)[[[2, 5, 0], [2, 3, 4]]] * np.array([[1, 1, 0], [1, 1, 1]])[..., None]
    assert np.allclose(got, want)
    config = RetrievalConfig(dim=16, checkpoint=folder, index_path=str(tmp_path / "index"), doc_maxlen=12, query_maxlen=6, nprobe=8, kmeans_niters=4, nbits=4)
    texts = ["the fox is lazy.", "the dog is lazy.", "bread is flour.", "hello world!"]
    assert Indexer(spark, config, texts).index()
    rows = encode.encode_passages(passages.strings(spark, texts), encoder, config, tokens).where("pid = 1").orderBy("pos").collect()
    # [CLS], marker, the words, [SEP]; the dot is skipped.
    ids = [2, vocab.index("[unused1]"), *map(vocab.index, ("the", "fox", "is", "lazy")), 3]
    assert [r["pos"] for r in rows] == [1, 2, 3, 4, 5, 6, 8] and np.allclose([r["embedding"] for r in rows], table[ids] / np.linalg.norm(table[ids], axis=1)[:, None], atol=1e-5)
    searcher = Searcher(spark, str(tmp_path / "index"))
    assert [searcher.search(q, 1)[0] for q in ("lazy fox", "flour bread", "hello world")] == [[1], [3], [4]]
    with pytest.raises(ValueError, match="dimensions"):
        Indexer(spark, RetrievalConfig(dim=8, checkpoint=folder, index_path=str(tmp_path / "other")), texts)
