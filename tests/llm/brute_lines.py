"""Brute force for line deduplication: every run against every earlier place."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def dedup(docs: list[tuple[int, str]], min_words: int = 50) -> dict[int, str]:
    """Texts left. docs: distinct keys."""
    seen: dict[tuple[str, ...], tuple[int, int]] = {}
    parsed = []
    for key, text in sorted(docs):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if WORD.search(x)]
        parsed.append((key, lines, at))
        for a in range(len(at)):
            n = 0
            for b in range(a, len(at)):
                n += len(WORD.findall(lines[at[b]]))
                if n >= min_words:
                    seen.setdefault(tuple(lines[i].strip(" \t\n\x0b\x0c\r") for i in at[a : b + 1]), (key, a))
    out = {}
    for key, lines, at in parsed:
        gone: set[int] = set()
        for a in range(len(at)):
            n = 0
            for b in range(a, len(at)):
                n += len(WORD.findall(lines[at[b]]))
                if n >= min_words and seen[tuple(lines[i].strip(" \t\n\x0b\x0c\r") for i in at[a : b + 1])] < (key, a):
                    gone.update(range(at[a], [*at, len(lines)][b + 1]))
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out
