"""Brute force for decontamination: every window of every item against every document, in plain Python."""

from __future__ import annotations

import regex

from lateweave.llm.decontamination import UNITS, LeakParams

NAME = regex.compile(r"(?<=[\p{Ll}\p{N},;:] )\p{Lu}[\p{L}\p{M}]+")
NUMBER = r"\p{N}+(?:[.,:/]\p{N}+)*"
UNIT = regex.compile(rf"{NUMBER}( ?)(?i:{'|'.join(sorted(UNITS, key=lambda u: -len(u)))})(?![\p{{L}}\p{{N}}])")
PLAIN = regex.compile(r"[^\p{L}\p{N}\s]+")


def words(text: str, marked: bool) -> list[str]:
    """The text's words without punctuation, or with placeholders in place of names, numbers and units."""
    text = text.replace("\x01", "")
    if marked:
        text = NAME.sub("\x01n", text)
        text = UNIT.sub("\x01d\\1\x01u", text)
        text = regex.sub(NUMBER, "\x01d", text)
        text = regex.sub(r"[^\p{L}\p{N}\s\x01]+", "", text)
    else:
        text = PLAIN.sub("", text)
    return [w for w in regex.split(r"[\x20\x09-\x0D]+", text.lower()) if w]


def coverage(text: str | None, item: str | None, p: LeakParams = LeakParams()) -> tuple[int, int]:
    """(covered words, words) of an item in a text."""
    t, o, bt, bo = (words(x or "", m) for x in (text, item) for m in (True, False))
    size = min(p.window, len(bt))
    hits: dict[int, list[tuple[int, bool]]] = {}
    for k in range(len(bt) - size + 1) if bt else ():
        part = bt[k : k + size]
        literal = sum("\x01" not in w for w in part)
        exact = literal < p.min_literal
        own, theirs, want = (o, bo, bo[k : k + size]) if exact else (t, bt, part)
        for at in range(len(own) - size + 1):
            if own[at : at + size] == want:
                hits.setdefault(at - k, []).append((k, not exact and literal < size))
    covered: set[int] = set()
    for shift, found in hits.items():
        values: dict[str, set[str]] = {}
        pairs = [(k, bo[j], o[j + shift]) for k, slotted in found if slotted for j in range(k, k + size) if "\x01" in bt[j]]
        for _, a, b in pairs:
            values.setdefault(a, set()).add(b)
        gone = {k for k, a, b in pairs if len(values[a]) > 1 and a != b}
        covered |= {j for k, _ in found if k not in gone for j in range(k, k + size)}
    return len(covered), len(bt)
