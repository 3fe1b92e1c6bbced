"""Folding a text for matching while keeping, for each character of the result, its place in the original text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np

from attesta.functions.text import DASHES, DOUBLE, DROPPED, SINGLE, SPELLINGS

_MARKS = {**dict.fromkeys(SINGLE, "'"), **dict.fromkeys(DOUBLE, '"'), **dict.fromkeys(DASHES, "-"), **dict.fromkeys(DROPPED, "")}
_MARKS |= {c: str(n) for n, c in enumerate("०१२३४५६७८९")}


def _plain(found: re.Match) -> str:
    """One character in its compatibility form, marks and digits made alike, in lower case."""
    return "".join(_MARKS.get(c, c.lower()) for c in (found[0] if found[0] in _MARKS else unicodedata.normalize("NFKC", found[0])))


#: Level 1: what is found, and what stands in its place. The order counts.
_LEVEL1: list[tuple[re.Pattern, str | Callable]] = [
    (re.compile(r"[^\x00-\x40\x5b-\x7f]"), _plain),
    (re.compile(r"-[ \t]*\n[ \t]*"), ""),
    *((re.compile(pattern), value) for pattern, value in SPELLINGS),
    (re.compile(r"(?<=[0-9]),(?=[0-9])"), ""),
    (re.compile(r"\s+"), " "),
    (re.compile(r"^ | $"), ""),
]
_LEVEL2 = [(re.compile(r"(?:[^\w]|_)+"), " "), (re.compile(r"^ | $"), "")]


def folded(text: str, level: int = 1) -> tuple[str, np.ndarray]:
    """The text folded to level 1 or 2, and the place in ``text`` from which each of its characters comes; what replaces a run comes from its first place."""
    at = np.arange(len(text), dtype=np.int64)
    for pattern, value in _LEVEL1 + (_LEVEL2 if level == 2 else []):
        parts, places, done = [], [], 0
        for m in pattern.finditer(text):
            new = value if isinstance(value, str) else value(m)
            parts += (text[done : m.start()], new)
            places += (at[done : m.start()], np.full(len(new), at[m.start()] if m.start() < len(at) else 0))
            done = m.end()
        if parts:
            text, at = "".join([*parts, text[done:]]), np.concatenate([*places, at[done:]])
    return text, at


def located(text: str, words: str, level: int = 1) -> tuple[int, int] | None:
    """Where ``words`` first stand in ``text`` at a level: [start, end) in characters of the original text; None where they do not stand."""
    held, at = folded(text, level)
    sought = folded(words, level)[0]
    first = held.find(sought) if sought else -1
    return (int(at[first]), int(at[first + len(sought) - 1]) + 1) if first >= 0 else None
