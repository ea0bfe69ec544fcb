"""Local model folders: tokenizer configuration, metadata, WordPiece tokenizer and an ONNX encoder; what a configuration's checkpoint stands for.

Everything heavy is opened once per Python worker, on first use. Only what is
asked for has to be there; a missing file is named in the error.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..config import HASH_ENCODER, RetrievalConfig
from ..operators.encode import Encoder, HashEncoder
from ..operators.tokenize import HashTokens, Tokens

TYPE = r"(\S+?)Tokenizer(Fast)?$"


def _json(folder: str, name: str) -> dict[str, Any]:
    path = os.path.join(folder, name)
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def tokenizer_config(folder: str) -> dict[str, Any]:
    return _json(folder, "tokenizer_config.json")


def artifact_metadata(folder: str) -> dict[str, Any]:
    """What a trained folder says of itself; ``dim`` among it."""
    return _json(folder, "artifact.metadata")


def tokenizer_type(name: str) -> str:
    """bert of BertTokenizerFast."""
    found = re.match(TYPE, name)
    if not found:
        raise ValueError(f"no tokenizer class: {name}")
    return found[1].lower()


def tokenizer_type_column(name: Column) -> Column:
    """As tokenizer_type(), for a column; null where the name is no tokenizer class."""
    kind = F.lower(F.regexp_extract(name, TYPE, 1))
    return F.when(kind != "", kind)


@functools.lru_cache(maxsize=2)
def wordpiece(folder: str):
    """The folder's WordPiece tokenizer: tokenizer.json if there is one, else vocab.txt."""
    from tokenizers import BertWordPieceTokenizer, Tokenizer

    whole, vocab = (os.path.join(folder, x) for x in ("tokenizer.json", "vocab.txt"))
    if os.path.isfile(whole):
        return Tokenizer.from_file(whole)
    if not os.path.isfile(vocab):
        raise FileNotFoundError(vocab)
    return BertWordPieceTokenizer(vocab, lowercase=bool(tokenizer_config(folder).get("do_lower_case", True)))


class WordPieceTokens:
    """The ids of a folder's tokenizer, in place of those of hashed tokens."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def ids(self, text: Column, most: int) -> Column:
        folder = self.folder

        @F.pandas_udf(ArrayType(IntegerType()))
        def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokenizer = wordpiece(folder)
            for part in texts:
                found = tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)
                yield pd.Series([x.ids[: max(0, most)] for x in found], index=part.index, dtype=object)

        return ids(text)

    def special(self, token: str) -> int:
        found = wordpiece(self.folder).token_to_id(token)
        if found is None:
            raise ValueError(f"no special token {token} in {self.folder}")
        return found

    def of(self, signs: Iterable[str]) -> list[int]:
        found = map(wordpiece(self.folder).token_to_id, signs)
        return [x for x in found if x is not None]


@functools.lru_cache(maxsize=2)
def _session(path: str):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])


class OnnxEncoder:
    """An exported model with its projection: inputs ids, attention mask and, if it asks for them, token types; output (texts, tokens, dim)."""

    def __init__(self, path: str, dim: int) -> None:
        self.path, self.dim = path, dim

    def vectors(self, ids: np.ndarray, attention: np.ndarray) -> np.ndarray:
        session = _session(self.path)
        given = (ids.astype(np.int64), attention.astype(np.int64), np.zeros(ids.shape, np.int64))
        return session.run(None, dict(zip((x.name for x in session.get_inputs()), given)))[0].astype(np.float32)


def load_local(folder: str, item: str = "") -> Any:
    """config, tokenizer or model of a local folder, also as folder:item; without an item (tokenizer, model)."""
    head, _, last = folder.rpartition(":")
    if not item and head and last in ("config", "tokenizer", "model"):
        folder, item = head, last
    if item == "config":
        return {**tokenizer_config(folder), **artifact_metadata(folder)}
    if item == "tokenizer":
        wordpiece(folder)
        return WordPieceTokens(folder)
    if item == "model":
        path = os.path.join(folder, "model.onnx")
        if not os.path.isfile(path):
            raise FileNotFoundError(path)
        return OnnxEncoder(path, int(artifact_metadata(folder)["dim"]))
    if item:
        raise ValueError(f"no such item: {item}")
    return load_local(folder, "tokenizer"), load_local(folder, "model")


def load(config: RetrievalConfig) -> tuple[Tokens, Encoder]:
    """Tokenizer and encoder of a configuration's checkpoint; an error if the model's dimension is not the configuration's."""
    if config.checkpoint == HASH_ENCODER:
        return HashTokens(), HashEncoder(config.dim)
    tokens, encoder = load_local(config.checkpoint)
    if encoder.dim != config.dim:
        raise ValueError(f"the model in {config.checkpoint} has {encoder.dim} dimensions, the configuration {config.dim}")
    return tokens, encoder
