"""Tokenisation: texts to token ids with special tokens, markers, truncation and masks.

The default tokenizer is made of built-in functions only; any object with its
three methods takes its place (see sources.checkpoint for one that reads a
vocabulary).
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of the special tokens.
PAD, QUERY_MARK, DOC_MARK, UNK, CLS, SEP, MASK = 0, 1, 2, 100, 101, 102, 103
SPECIAL = {"[PAD]": PAD, "[unused0]": QUERY_MARK, "[unused1]": DOC_MARK, "[UNK]": UNK, "[CLS]": CLS, "[SEP]": SEP, "[MASK]": MASK}
FIRST_ID, VOCABULARY = 1000, 1 << 20

#: Runs of letters, digits and _, or single other characters.
PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def token_strings(text: Column) -> Column:
    """Lower-cased tokens of a text; null: none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PATTERN), 0)


def token_id(token: Column) -> Column:
    """Stable id of a token string from its md5: above the special ids."""
    return (F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("long") % VOCABULARY + FIRST_ID).cast("int")


def token_ids(text: Column, most: int | None = None) -> Column:
    """Ids of a text's tokens; with ``most``, of its first tokens alone: the others are not hashed."""
    found = token_strings(text)
    return F.transform(found if most is None else F.slice(found, 1, max(0, most)), token_id)


class Tokens(Protocol):
    """What turns texts into ids."""

    def ids(self, text: Column, most: int) -> Column:
        """Ids (ARRAY<INT>) of the first ``most`` tokens, without special ones; of a null text none."""
        ...

    def special(self, token: str) -> int:
        """Id of a special token; an error if there is none of that name."""
        ...

    def of(self, signs: Iterable[str]) -> list[int]:
        """Ids of the tokens among these that the vocabulary has."""
        ...


class HashTokens:
    """Ids from the md5 of token strings, beside fixed ids of special tokens: no vocabulary is needed."""

    def ids(self, text: Column, most: int) -> Column:
        return token_ids(text, most)

    def special(self, token: str) -> int:
        if token not in SPECIAL:
            raise ValueError(f"no special token {token}; there are {', '.join(SPECIAL)}")
        return SPECIAL[token]

    def of(self, signs: Iterable[str]) -> list[int]:
        return [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) % VOCABULARY + FIRST_ID for x in signs]


def with_ends(ids: Column) -> Column:
    return F.concat(F.array(F.lit(CLS)), ids, F.array(F.lit(SEP)))


def add_marker(ids: Column, marker: int) -> Column:
    """The marker as second element; of an empty array the marker alone."""
    return F.concat(F.slice(ids, 1, 1), F.array(F.lit(marker)), F.slice(ids, 2, F.greatest(F.size(ids), F.lit(1))))


def truncate(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, length)


def fit_length(ids: Column, length: int, pad: int = PAD) -> Column:
    """Cut or padded at the end to exactly this length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def document_ids(text: Column, doc_maxlen: int, marker: str = "[unused1]", tokens: Tokens | None = None) -> Column:
    """Ids of a document with ends and marker, cut to doc_maxlen: a long text loses its end token."""
    t = tokens or HashTokens()
    head = F.array(F.lit(t.special("[CLS]")), F.lit(t.special(marker)))
    return truncate(F.concat(head, t.ids(text, doc_maxlen - 2), F.array(F.lit(t.special("[SEP]")))), doc_maxlen)


def query_ids(text: Column, query_maxlen: int, marker: str = "[unused0]", tokens: Tokens | None = None) -> Column:
    """Exactly query_maxlen ids: with ends and marker, cut, and filled up with masks in place of pads."""
    t = tokens or HashTokens()
    head = F.array(F.lit(t.special("[CLS]")), F.lit(t.special(marker)))
    return fit_length(F.concat(head, t.ids(text, query_maxlen - 2), F.array(F.lit(t.special("[SEP]")))), query_maxlen, t.special("[MASK]"))


def query_attention(text: Column, query_maxlen: int, attend_to_mask_tokens: bool) -> Column:
    """Attention mask beside query_ids() of the default tokenizer."""
    real = F.least(F.size(token_strings(text)) + 3, F.lit(query_maxlen))
    return F.transform(F.sequence(F.lit(1), F.lit(query_maxlen)), lambda i: F.lit(attend_to_mask_tokens) | (i <= real))


def skiplist(mask_punctuation: bool) -> tuple[str, ...]:
    """Token strings left out of documents: the 32 ASCII punctuation signs, or none. Pads are always left out."""
    return tuple(string.punctuation) if mask_punctuation else ()


def skip_ids(mask_punctuation: bool, tokens: Tokens | None = None) -> list[int]:
    """Ids left out of documents."""
    t = tokens or HashTokens()
    return [*t.of(skiplist(mask_punctuation)), t.special("[PAD]")]


def keep_mask(ids: Column, skip: Iterable[int]) -> Column:
    return F.transform(ids, lambda x: ~x.isin(*skip))
