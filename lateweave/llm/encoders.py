"""Public tokenizer files, opened once per Python worker."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

#: Vocabularies that are there as ranks too, which a faster library reads: (file of ranks, special token).
RANKED = {"byte_bpe_50k.json": ("byte_bpe_50k.tiktoken", "<|endoftext|>")}
#: Characters that the faster library is given at a time; its pattern engine gives up on a million blanks.
PART = 400_000
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def locate(file: str) -> str:
    """A path as it is; a bare file name as the public tokenizers' file of that name."""
    if os.path.dirname(file):
        return file
    import public_tokenizers

    return public_tokenizers.path(file)


def _whole(path: str) -> Callable[[str], list[int]]:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def _ranked(path: str) -> Callable[[str], list[int]]:
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut only before a blank that follows no white space, where no token goes on."""
    at = 0
    while len(text) - at > size:
        last = deque(_CUT.finditer(text, at + 1, at + size), maxlen=1)
        found = last[0] if last else _CUT.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


@functools.lru_cache(maxsize=4)
def encoder(file: str) -> Callable[[str], np.ndarray]:
    """text -> ids (uint32), no special token added at the ends.

    file: a .json of tokenizers, a .tiktoken rank file or a .model of
    sentencepiece. A .json decides about special tokens' strings inside a text;
    to the others they are ordinary text. A .json whose vocabulary is there as
    ranks gives the ids of the tokenizers library by a faster one; the library
    itself takes pieces with a special token, and runs too long for the other.
    """
    path = locate(file)
    if path.endswith(".tiktoken"):
        ranked = _ranked(path)
        return lambda text: np.asarray([x for part in parts(text) for x in ranked(part)], np.uint32)
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: np.asarray(pieces.encode(text), np.uint32)
    if file not in RANKED:
        whole = _whole(path)
        return lambda text: np.asarray(whole(text), np.uint32)
    ranks, special = RANKED[file]
    ranked, opened = _ranked(locate(ranks)), functools.cache(lambda: _whole(path))

    def ids(text: str) -> np.ndarray:
        if len(text) <= PART and special not in text:
            return np.asarray(ranked(text), np.uint32)
        found = [(opened() if special in x or len(x) > PART else ranked)(x) for x in parts(text)]
        return np.concatenate([np.asarray(x, np.uint32) for x in found])

    return ids
