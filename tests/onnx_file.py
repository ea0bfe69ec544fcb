"""A small ONNX model written by hand: a table row for each id, zeroed where the attention mask is 0."""

from __future__ import annotations

import numpy as np


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _node(op: str, inputs: list[str], output: str, attribute: bytes = b"") -> bytes:
    return _bytes(1, b"".join(_bytes(1, x) for x in inputs) + _bytes(2, output) + _bytes(4, op) + (_bytes(5, attribute) if attribute else b""))


def _tensor(name: str, values: np.ndarray, kind: int) -> bytes:
    return _bytes(5, b"".join(_number(1, d) for d in values.shape) + _number(2, kind) + _bytes(8, name) + _bytes(9, values.tobytes()))


def _value(field: int, name: str, kind: int, dims: list[str]) -> bytes:
    shape = b"".join(_bytes(1, _bytes(2, d)) for d in dims)
    return _bytes(field, _bytes(1, name) + _bytes(2, _bytes(1, _number(1, kind) + _bytes(2, shape))))


def model(table: np.ndarray) -> bytes:
    to_float = _bytes(1, "to") + _number(3, 1) + _number(20, 2)
    graph = (
        _node("Gather", ["table", "input_ids"], "rows")
        + _node("Cast", ["attention_mask"], "mask", to_float)
        + _node("Unsqueeze", ["mask", "last"], "column")
        + _node("Mul", ["rows", "column"], "out")
        + _bytes(2, "lookup")
        + _tensor("table", table.astype("<f4"), 1)
        + _tensor("last", np.array([2], "<i8"), 7)
        + _value(11, "input_ids", 7, ["texts", "tokens"])
        + _value(11, "attention_mask", 7, ["texts", "tokens"])
        + _value(12, "out", 1, ["texts", "tokens", "dim"])
    )
    return _number(1, 8) + _bytes(7, graph) + _bytes(8, _bytes(1, "") + _number(2, 13))
