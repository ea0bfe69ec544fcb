"""Vectorised 64-bit hashes of words, one array operation per step over a whole text."""

from __future__ import annotations

import numpy as np

_M1, _M2, BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 .. n, modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))]) for x in (BASE, inverse))


_POWERS = powers(1 << 18)


def word_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of a text's words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and each word's last two bytes (uint16)."""
    h, tail, _ = hash_bytes((text or "").encode("utf-8", "surrogatepass"))
    return h, tail


def hash_bytes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes(), and where the words start."""
    with np.errstate(over="ignore"):
        return _hashed(np.frombuffer(text, np.uint8))


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.ones(len(data) + 2, bool)
    np.less_equal(data - np.uint8(9), 4, out=space[1:-1])
    space[1:-1] |= data == 32
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, stop = edge[::2], edge[1::2]
    low = data + ((data - np.uint8(65)) <= 25) * np.uint8(32)
    # A byte's power is its place in a block of the table's length; a word that crosses blocks is added up by itself.
    size = len(_POWERS[0]) - 1
    power = _POWERS[0][: len(data)] if len(data) <= size else np.resize(_POWERS[0][:size], len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low + np.uint64(1)) * power, out=total[1:])
    hashes = mix((total[stop] - total[start]) * _POWERS[1][start % size] + (stop - start).astype(np.uint64))
    for i in np.flatnonzero(start // size != (stop - 1) // size) if len(data) > size else ():
        word, value = low[start[i] : stop[i]] + np.uint64(1), np.uint64(0)
        for k in range(0, len(word), size):
            part = word[k : k + size]
            value = value + (part * _POWERS[0][: len(part)]).sum(dtype=np.uint64) * np.uint64(pow(int(BASE), k, 1 << 64))
        hashes[i] = mix(np.array([value + np.uint64(len(word))]))[0]
    last = low[stop - 1].astype(np.uint16)
    before = np.where(stop - start > 1, low[np.maximum(stop - 2, 0)], np.uint8(0)) if len(start) else last
    return hashes, before.astype(np.uint16) * np.uint16(256) + last, start
