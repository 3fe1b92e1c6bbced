"""Splitting texts above a size limit into overlapping pieces at natural boundaries, by content-defined chunking.

A rolling hash over the last ``WINDOW`` characters marks landmarks. Each landmark snaps to the nearest end of the best kind (paragraph, then sentence, clause,
word) within ``reach`` characters; these places depend on nearby characters only. From one cut the next is the first such place between the least and the
most size; without one it is the last end of the best kind in that range, and where the text has no end at all the most size. So an edit moves the cuts
next to it, and beyond them the old cuts come back.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters under the rolling hash; short forms after which a full stop ends no sentence.
WINDOW = 24
SHORT_FORMS = "v vs No Nos Rs Sec Art Cl Para Dr Mr Mrs Ms St cf art núm nº Abs Nr bzw"
_SHORT = "|".join(map(regex.escape, SHORT_FORMS.split()))
#: Ends by kind, best first. Each match ends where a piece may end.
ENDS = [
    regex.compile(r"\S(?=[^\S\n]*\n)"),
    regex.compile(rf"(?<!\b(?:{_SHORT}))[.!?।॥…]+[\"'”’»)\]]*(?=\s)"),
    regex.compile(r"[;:,—–](?=\s)"),
    regex.compile(r"\S(?=\s)"),
]
_START = regex.compile(r"(?<=\s)\S")


@dataclass(frozen=True)
class Sizes:
    """most: characters of a piece, overlap included. least: characters between two cuts. every: mean distance of landmarks (a power of two)."""

    most: int = 1200
    overlap: int = 150
    least: int = 500
    every: int = 256
    reach: int = 120

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.most or not 0 < self.least <= self.most - self.overlap:
            raise ValueError(f"no pieces can have these sizes: {self}")


def landmarks(text: str, every: int) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW characters ends in zeros."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.zeros(0, np.int64)
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    h = np.zeros(len(codes) - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        h = h * np.uint64(3) + mixed[i : i + len(h)]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.nonzero((h >> np.uint64(40)) % np.uint64(every) == 0)[0] + WINDOW


def _last(ends: list[list[int]], low: int, high: int) -> int | None:
    """The last end of the best kind in [low, high]."""
    for kind in ends:
        i = bisect_left(kind, high + 1) - 1
        if i >= 0 and kind[i] >= low:
            return kind[i]
    return None


def _nearest(ends: list[list[int]], at: int, reach: int) -> int | None:
    for kind in ends:
        i = bisect_left(kind, at)
        near = [x for x in kind[max(0, i - 1) : i + 1] if abs(x - at) <= reach]
        if near:
            return min(near, key=lambda x: abs(x - at))
    return None


def cuts(text: str, sizes: Sizes) -> list[int]:
    """Ends of the pieces' own parts, the length of the text last. A text within the limit is one piece, an empty one too."""
    n = len(text)
    if n <= sizes.most:
        return [n]
    ends = [[m.end() for m in kind.finditer(text)] for kind in ENDS]
    places = sorted({x for at in landmarks(text, sizes.every) if (x := _nearest(ends, int(at), sizes.reach)) is not None})
    room = sizes.most - sizes.overlap
    out = [0]
    while n - out[-1] > room:
        low, high = out[-1] + sizes.least, out[-1] + room
        i = bisect_left(places, low)
        cut = places[i] if i < len(places) and places[i] <= high else _last(ends, low, high)
        if cut is None:
            cut = _last(ends, out[-1] + 1, high)
        if cut is None:
            cut = high
            while cut > low and (unicodedata.combining(text[cut]) or unicodedata.category(text[cut]) in ("Mn", "Mc", "Me") or text[cut] == "‍"):
                cut -= 1
        out.append(cut)
    return [*out[1:], n]


def pieces(text: str, sizes: Sizes) -> list[tuple[int, int, int]]:
    """(start, own start, end) of each piece; start to own start repeats the end of the piece before, from the beginning of a word where there is one."""
    out, own = [], 0
    for end in cuts(text, sizes):
        start = own
        if own and sizes.overlap:
            low = max(own - sizes.overlap, out[-1][0])
            first = _START.search(text, low, own)
            start = first.start() if first else low
        out.append((start, own, end))
        own = end
    return out


def split_texts(df: DataFrame, text: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """df with one row per piece and the columns piece_no (from 0), piece_count, piece_start, own_start, piece_end (code points, end exclusive), piece_text.

    The parts from own_start to piece_end of a text's pieces, put together, are the text. A null text gives one row with nulls, an empty one an empty piece;
    repeated rows are split alike. A table that already has one of the new columns raises a ValueError. Texts within the limit never leave the JVM.
    """
    new = "piece_no int, piece_count int, piece_start int, own_start int, piece_end int, piece_text string"
    names = [x.split()[0] for x in new.split(", ")]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"the table already has columns {sorted(clash)}")
    size = F.length(text)
    whole = df.where(size.isNull() | (size <= sizes.most))
    shown = F.col(text).isNotNull()
    whole = whole.select("*", *[F.when(shown, x.cast("int")).alias(n) for n, x in zip(names, (F.lit(0), F.lit(1), F.lit(0), F.lit(0), size))], F.col(text).alias("piece_text"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [{"piece_no": i, "piece_start": a, "own_start": b, "piece_end": c} for i, (a, b, c) in enumerate(pieces(t, sizes))])

    cut_up = F.pandas_udf(run, "array<struct<piece_no:int,piece_start:int,own_start:int,piece_end:int>>")
    long = df.where(size > sizes.most).withColumn("_pieces", cut_up(F.col(text)))
    long = long.select("*", F.size("_pieces").alias("piece_count"), F.explode("_pieces").alias("_p")).drop("_pieces")
    long = long.select(*df.columns, "_p.piece_no", "piece_count", "_p.piece_start", "_p.own_start", "_p.piece_end", F.substring(F.col(text), F.col("_p.piece_start") + 1, F.col("_p.piece_end") - F.col("_p.piece_start")).alias("piece_text"))
    return whole.unionByName(long)
