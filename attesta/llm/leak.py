"""Passages of evaluation items inside a training corpus, by pigeonhole edit matching.

A passage is any run of ``span`` consecutive words of an item. Within an error budget of ``errors`` word edits, a passage still holds one of its
``errors + 1`` pieces unedited, so every item is cut into consecutive pieces of such a length that each passage contains at least ``errors + 1`` whole
pieces. Exact hits of pieces in a document are found by hash; around each hit Myers' bit-parallel distance tells whether a passage of the item ends there
within the budget.

The items are the small side: their pieces are sent to all executors, after a check of their size. The corpus is read once, is never shuffled, and only
documents with a passage leave the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.lookalike import fold, repairs, replaced

#: Items of more characters in all than this are refused; they would be sent to every executor.
MOST_ITEM_CHARS = 64_000_000
_DROP = regex.compile(r"[^\p{L}\p{M}\p{Nd}\s]+")
_ASCII_DROP = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and not chr(c).isspace())
_ASCII_TABLE = str.maketrans("", "", _ASCII_DROP)


def words(text: str, known: frozenset[str] | None = None) -> list[str]:
    """The words of a text in its consistent form and lower case: split at white space, of each only letters, marks and digits kept, empty ones dropped.

    A word with look-alike letters takes its repaired spelling if that is among the ``known`` words (None: in any case).
    """
    text = fold(text)
    if text.isascii():
        return text.translate(_ASCII_TABLE).lower().split()
    if spelled := repairs(text):
        text = replaced(text, spelled if known is None else {w: x for w, x in spelled.items() if not known.isdisjoint(words(x))})
    return _DROP.sub("", text.lower()).split()


def myers_ends(pattern: np.ndarray | list[int], text: list[int], most: int) -> list[tuple[int, int]]:
    """(end, distance) for each place in text where the pattern ends within ``most`` edits (insertions, deletions, replacements of words).

    Myers' algorithm: one Python integer holds a column of the distance matrix, a bit for each word of the pattern.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[int, int] = {}
    for i, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << i
    plus, minus, score, out = full, 0, m, []
    for at, word in enumerate(text):
        eq = masks.get(word, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (~(across | plus) & full), plus & across
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        eq |= minus
        plus, minus = down | (~(eq | up) & full), up & eq
        if score <= most:
            out.append((at + 1, score))
    return out


def piece_length(span: int, errors: int) -> int:
    """The greatest length for which every run of span words contains errors + 1 whole pieces."""
    for length in range(span, 0, -1):
        if (span - length + 1) // length >= errors + 1:
            return length
    raise ValueError(f"{errors} errors are too many for passages of {span} words")


_MIX = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive ids."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ ids[i : i + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Items:
    """All items, ready to be searched: word numbers, item texts in these numbers, the sorted hashes of their pieces with (item, place), and the items that are
    shorter than a passage by their number of words, as sorted hashes of the whole with the item."""

    span: int
    errors: int
    number: dict[str, int]
    ids: list[np.ndarray]
    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, texts: list[str], span: int, errors: int) -> Items:
        length = piece_length(span, errors)
        number: dict[str, int] = {}
        ids = [np.array([number.setdefault(w, len(number) + 1) for w in words(t)], np.uint64) for t in texts]
        hashes, owner, place = [], [], []
        for i, own in enumerate(ids):
            # The last piece may begin anywhere, so that no passage at the end of an item goes without one.
            starts = np.unique([*range(0, max(0, len(own) - length + 1), length), max(0, len(own) - length)]) if len(own) >= span else []
            if len(starts):
                hashes.append(run_hashes(own, length)[starts])
                owner.append(np.full(len(starts), i))
                place.append(starts)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        hashes, owner, place = join(hashes, np.uint64), join(owner, np.int64), join(place, np.int64)
        order = np.argsort(hashes, kind="stable")
        short = {}
        for n in sorted({len(own) for own in ids} & set(range(1, span))):
            whole = np.array([i for i, own in enumerate(ids) if len(own) == n])
            forms = np.concatenate([run_hashes(ids[i], n) for i in whole])
            by_form = np.argsort(forms, kind="stable")
            short[n] = forms[by_form], whole[by_form]
        return cls(span, errors, number, ids, hashes[order], owner[order], place[order], short)

    def search(self, text: str) -> dict[int, tuple[int, int]]:
        """For each item of which the text holds a passage: (least edits, words of the longest run that stands in both without any edit)."""
        own = words(text, self.number.keys())
        length = piece_length(self.span, self.errors)
        doc = np.fromiter(map(self.number.get, own, [0] * len(own)), np.uint64, len(own))
        found = self._short_items(doc)
        if len(own) < self.span - self.errors:
            return found
        h = run_hashes(doc, length)
        first = np.searchsorted(self.hashes, h)
        hits = np.nonzero(self.hashes[np.minimum(first, len(self.hashes) - 1)] == h)[0] if len(self.hashes) else []
        ends: dict[tuple[int, int], int] = {}  # of the exact runs on each diagonal of each item
        for at in hits:
            k = first[at]
            while k < len(self.hashes) and self.hashes[k] == h[at]:
                item, place = int(self.owner[k]), int(self.place[k])
                k += 1
                if place < ends.get((item, at - place), 0) and (self.errors == 0 or item in found and found[item][0] == 0):
                    continue  # the same exact run
                self._verify(item, place, int(at), doc, found, ends)
        return found

    def _short_items(self, doc: np.ndarray) -> dict[int, tuple[int, int]]:
        found = {}
        for n, (forms, owners) in self.short.items():
            h = run_hashes(doc, n) if len(doc) >= n else forms[:0]
            first, last = np.searchsorted(forms, h), np.searchsorted(forms, h, side="right")
            for at in np.nonzero(last > first)[0]:
                for i in owners[first[at] : last[at]].tolist():
                    if i not in found and np.array_equal(self.ids[i], doc[at : at + n]):
                        found[i] = (0, n)
        return found

    def _verify(self, item: int, place: int, at: int, doc: np.ndarray, found: dict, ends: dict) -> None:
        ids, span, errors = self.ids[item], self.span, self.errors
        a, b, x, y = place, at, place, at
        while a > 0 and b > 0 and ids[a - 1] == doc[b - 1]:
            a, b = a - 1, b - 1
        while x < len(ids) and y < len(doc) and ids[x] == doc[y]:
            x, y = x + 1, y + 1
        ends[item, at - place] = x
        edits = 0 if x - a >= span else errors + 1
        if edits and errors:
            low = max(0, place + 1 - span)
            region, near = ids[low : place + span].tolist(), doc[max(0, at - span - errors) : at + span + errors].tolist()
            there = set(near)
            met = [0]
            for word in region:
                met.append(met[-1] + (word in there))
            # A passage within the budget has all but ``errors`` of its words in the neighbourhood.
            for start in range(min(place, len(ids) - span) - low + 1):
                if met[start + span] - met[start] >= span - errors:
                    edits = min([edits, *(d for _, d in myers_ends(region[start : start + span], near, errors))])
        if edits <= errors:
            before = found.get(item, (edits, 0))
            found[item] = (min(before[0], edits), max(before[1], x - a))


def leaked_items(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, span: int = 13, errors: int = 1) -> DataFrame:
    """(key, item_key, edits, run_words) for each document that holds a passage of an item within the error budget.

    edits is 0 where ``span`` consecutive words of the item stand in the document unchanged; run_words is the longest unchanged run met. Repeated rows give one
    row, null texts and keys none, empty texts have no passages. An item shorter than a passage is one passage, and counts only where it stands as a whole and
    unchanged (run_words then is its length). Items are refused above MOST_ITEM_CHARS characters.
    """
    size = items.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    if size > MOST_ITEM_CHARS:
        raise ValueError(f"the items have {size} characters; give them in parts of at most {MOST_ITEM_CHARS}")
    listed = items.select(item_key, item_text).where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).distinct().collect()
    shared = docs.sparkSession.sparkContext.broadcast((Items.of([r[1] for r in listed], span, errors), [r[0] for r in listed]))
    names = [key, item_key] if key != item_key else [key, f"item_{item_key}"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, keys = shared.value
        for pdf in batches:
            rows = [(k, keys[i], e, n) for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]) for i, (e, n) in ready.search(t).items()]
            yield pd.DataFrame(rows, columns=[*names, "edits", "run_words"])

    schema = T.StructType([T.StructField(names[0], docs.schema[key].dataType), T.StructField(names[1], items.schema[item_key].dataType), T.StructField("edits", T.IntegerType()), T.StructField("run_words", T.IntegerType())])
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    return rows.mapInPandas(run, schema).groupBy(*names).agg(F.min("edits").alias("edits"), F.max("run_words").alias("run_words"))
