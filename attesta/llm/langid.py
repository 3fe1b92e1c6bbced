"""The language of each document and of each of its segments, by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over all its segmentations into pieces,
found by the forward algorithm; that of a sentence is the product over its words. Piece probabilities are fitted by expectation-maximisation over the same
segmentations, on a bounded sample of labelled documents (``Sample``), twice: the second time without the documents that the first fit finds mislabelled.

Sentences get languages jointly: the best path through a document, where each change of language costs ``CHANGE``; consecutive sentences of one language are
a segment. Confidence is the posterior probability of the language for the words of the segment.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.lookalike import fold, repairs, replaced

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# Spellings of languages (without region tags), and the models, of which two are scripts of one language.
NAMES = {
    "en": "en eng english", "hi": "hi hin hindi", "mr": "mr mar marathi", "fr": "fr fra fre french", "es": "es spa spanish", "pt": "pt por portuguese", "de": "de deu ger german",
}
MODELS = ["en", "hi", "hi-Latn", "mr", "fr", "es", "pt", "de"]
LANGS = [m.split("-")[0] for m in MODELS]
CODE_OF = {name: code for code, names in NAMES.items() for name in names.split()}
CHANGE = 3.0
LONGEST = 40
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_END = re.compile(r"[.!?।॥]+[\"'”’»)\]]*\s+|\s*\n\s*")
_DEVANAGARI = re.compile("[ऀ-ॿ]")


def label_code(label: Column) -> Column:
    """The two-letter code that a label names in any spelling; null for missing and unknown ones."""
    base = F.lower(F.regexp_extract(F.trim(label), r"^([^-_]*)", 1))
    table = F.create_map(*[F.lit(x) for pair in CODE_OF.items() for x in pair])
    return F.try_element_at(table, base)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and headings of a text: parts between ends of sentences and ends of lines."""
    out, start = [], 0
    for m in _END.finditer(text):
        out.append((start, m.end()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def words(part: str) -> list[str]:
    """The letter runs of a part of a text in its consistent form and lower case; overlong ones in parts."""
    if not part.isascii():
        part = fold(part)
        if spelled := repairs(part):
            part = replaced(part, spelled)
    found = _WORD.findall(part.lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def arcs(word: str, number: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(start, end, piece) for every piece in a word marked by a leading word sign. A character that no piece holds is the unknown piece 0."""
    marked, out = "▁" + word, []
    n = len(marked)
    for i in range(n):
        for j in range(i + 1, min(n, i + longest) + 1):
            if (piece := number.get(marked[i:j])) is not None:
                out.append((i, j, piece))
            elif j == i + 1:
                out.append((i, j, 0))
    return out


@dataclass
class Model:
    """Piece numbers and their probabilities by model."""

    number: dict[str, int]
    prob: np.ndarray
    longest: int

    def __post_init__(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(MODELS)), np.float32)

    def score(self, word: str) -> np.ndarray:
        """log P(word) by model: the forward algorithm."""
        n = len(word) + 1
        alpha = np.zeros((n + 1, len(MODELS)))
        alpha[0] = 1
        for i, j, piece in arcs(word, self.number, self.longest):
            alpha[j] += alpha[i] * self.prob[piece]
        return np.log(np.maximum(alpha[n], 1e-290))

    def indices(self, found: list[str]) -> list[int]:
        out = []
        for w in found:
            k = self.known.get(w)
            if k is None:
                k = len(self.known)
                if k == len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.known[w] = k
                self.scores[k] = self.score(w)
            out.append(k)
        return out

    def segments(self, texts: list[str]) -> list[list[tuple[int, int, str, float, int]]]:
        """For each text its segments (start, end, lang, confidence, words)."""
        if len(self.known) > 500_000:
            self.known.clear()
        spans = [sentences(t) for t in texts]
        sizes, index = [], []
        for text, own in zip(texts, spans):
            for a, b in own:
                found = self.indices(words(text[a:b]))
                sizes.append(len(found))
                index += found
        total = np.concatenate([np.zeros((1, len(MODELS))), np.cumsum(self.scores[index], axis=0, dtype=np.float64)])
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        by_sentence = total[ends[1:]] - total[ends[:-1]]
        out, k = [], 0
        for own in spans:
            out.append(_segments(own, by_sentence[k : k + len(own)], sizes[k : k + len(own)]))
            k += len(own)
        return out


def _segments(spans: list[tuple[int, int]], scores: np.ndarray, sizes: list[int]) -> list[tuple[int, int, str, float, int]]:
    if not any(sizes):
        return []
    best = scores.argmax(axis=1)
    told = [best[i] for i, n in enumerate(sizes) if n]
    if all(x == told[0] for x in told):
        path = np.full(len(spans), told[0])
    else:
        value, back = scores[0].copy(), []
        for row in scores[1:]:
            top = int(value.argmax())
            stay = value >= value[top] - CHANGE
            back.append(np.where(stay, np.arange(len(value)), top))
            value = np.where(stay, value, value[top] - CHANGE) + row
        path = np.empty(len(spans), np.int64)
        path[-1] = value.argmax()
        for i in range(len(back) - 1, -1, -1):
            path[i] = back[i][path[i + 1]]
    langs = [LANGS[x] for x in path]
    out, first = [], 0
    for i in range(1, len(spans) + 1):
        if i == len(spans) or langs[i] != langs[first]:
            score = scores[first:i].sum(axis=0)
            p = np.exp(score - score.max())
            sure = sum(x for x, lang in zip(p, LANGS) if lang == langs[first]) / p.sum()
            out.append((spans[first][0], spans[i - 1][1], langs[first], float(sure), int(sum(sizes[first:i]))))
            first = i
    return out


@dataclass(frozen=True)
class Sample:
    """The bound of the training sample: documents of each label, chosen by a seeded hash among those of at most ``chars`` characters, and rounds of
    expectation-maximisation."""

    documents: int = 250
    chars: int = 50_000
    seed: int = 11
    rounds: int = 3


def vocabulary(path: str = PIECES) -> dict[str, int]:
    """Pieces of the public vocabulary that consist of letters and marks, in lower case; number 0 is for all other characters."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = {p.lower() for p in map(sp.id_to_piece, range(sp.get_piece_size())) if p == "▁" or regex.fullmatch(r"▁?[\p{L}\p{M}]+", p)} | {"▁"}
    return {p: i for i, p in enumerate(sorted(kept), 1)}


def fit(counts: list[Counter], number: dict[str, int], rounds: int) -> Model:
    """Piece probabilities from word counts by model. A word of a model adds to its pieces in proportion to the segmentations that hold them."""
    longest = max(map(len, number))
    prob = np.full((len(number) + 1, len(MODELS)), 1 / (len(number) + 1))
    by_word: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(MODELS)))
    for m, own in enumerate(counts):
        for w, n in own.items():
            by_word[w][m] += n
    lattice = [(len(w) + 1, arcs(w, number, longest), n) for w, n in by_word.items()]
    for _ in range(rounds):
        new = np.full_like(prob, 0.01)
        for n, own, weight in lattice:
            alpha, beta = np.zeros((n + 1, len(MODELS))), np.zeros((n + 1, len(MODELS)))
            alpha[0] = beta[n] = 1
            for i, j, piece in own:
                alpha[j] += alpha[i] * prob[piece]
            for i, j, piece in reversed(own):
                beta[i] += beta[j] * prob[piece]
            scale = weight / np.maximum(alpha[n], 1e-290)
            for i, j, piece in own:
                new[piece] += alpha[i] * prob[piece] * beta[j] * scale
        prob = new / new.sum(axis=0)
    return Model(number, prob, longest)


def _counts(rows: list[tuple[str, str]]) -> list[Counter]:
    out = [Counter() for _ in MODELS]
    for code, text in rows:
        latin = code == "hi" and 2 * len(_DEVANAGARI.findall(text)) < len(text.replace(" ", ""))
        out[MODELS.index("hi-Latn" if latin else code)].update(words(text))
    return out


def train(docs: DataFrame, key: str, text: str, label: str, sample: Sample = Sample(), pieces: str = PIECES) -> Model:
    """Fit on at most ``sample.documents`` documents of each label, each of at most ``sample.chars`` characters. Without any such row the languages cannot be told: a ValueError."""
    labelled = docs.select(F.col(key).alias("k"), label_code(F.col(label)).alias("code"), F.length(text).alias("n")).where(F.col("code").isNotNull() & F.col("n").between(1, sample.chars))
    order = Window.partitionBy("code").orderBy(F.xxhash64("k", F.lit(sample.seed)), "k")
    chosen = labelled.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample.documents).select("k", "code")
    rows = [(r[0], r[1]) for r in docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").select("code", "text").collect()]
    if not rows:
        raise ValueError("no labelled documents to learn from")
    rows.sort()
    number = vocabulary(pieces)
    first = fit(_counts(rows), number, 1)
    found = first.segments([t for _, t in rows])
    agreeing = [row for row, own in zip(rows, found) if {s[2] for s in own} == {row[0]}]
    return fit(_counts(agreeing or rows), number, sample.rounds)


def language_segments(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, seg_no, seg_start, seg_end, seg_lang, confidence, seg_words) of every document. Texts that are null or hold no letter have no segments."""
    shared = docs.sparkSession.sparkContext.broadcast((model.number, model.prob, model.longest))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for texts in batches:
            yield pd.Series([[{"a": a, "b": b, "lang": lang, "sure": p, "n": n} for a, b, lang, p, n in found] for found in own.segments(texts.tolist())])

    udf = F.pandas_udf(run, "array<struct<a:int,b:int,lang:string,sure:double,n:int>>")
    rows = docs.where(F.col(text).isNotNull()).select(key, udf(F.col(text)).alias("s")).select(key, F.posexplode("s").alias("seg_no", "s"))
    return rows.select(key, "seg_no", F.col("s.a").alias("seg_start"), F.col("s.b").alias("seg_end"), F.col("s.lang").alias("seg_lang"), F.col("s.sure").alias("confidence"), F.col("s.n").alias("seg_words"))


def document_languages(docs: DataFrame, key: str, text: str, label: str, model: Model) -> DataFrame:
    """docs' key and label with text_lang (the language of most words), confidence (its share of the words times the mean confidence of its segments), langs (all
    languages, sorted) and verdict: missing, wrong, mixed or fine. Texts without letters have no language and the verdict ``empty``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.number, model.prob, model.longest))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for texts in batches:
            rows = []
            for found in own.segments(["" if t is None else t for t in texts.tolist()]):
                size, sure = Counter(), Counter()
                for _, _, lang, p, n in found:
                    size[lang] += n
                    sure[lang] += p * n
                top = min(size, key=lambda x: (-size[x], x)) if size else None
                rows.append((top, sure[top] / max(1, sum(size.values())) if size else None, sorted(size)))
            yield pd.DataFrame(rows, columns=["top", "sure", "langs"])

    udf = F.pandas_udf(run, "top string, sure double, langs array<string>")
    rows = docs.select(key, label, label_code(F.col(label)).alias("code"), udf(F.col(text)).alias("d"))
    verdict = (
        F.when(F.size("d.langs") == 0, "empty")
        .when(F.col(label).isNull() | F.lower(F.trim(label)).isin("", "und"), "missing")
        .when(F.col("code").isNull() | ~F.array_contains("d.langs", F.coalesce("code", F.lit(""))), "wrong")
        .when(F.size("d.langs") > 1, "mixed")
        .otherwise("fine")
    )
    return rows.select(key, label, F.col("d.top").alias("text_lang"), F.col("d.sure").alias("confidence"), F.col("d.langs").alias("langs"), verdict.alias("verdict"))
