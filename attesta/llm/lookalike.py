"""One consistent form of texts that look the same but are made of other characters.

Three layers, each of which maps texts that look the same to the same form:

1. ``fold``: full-width and presentation forms and ligatures become ordinary letters, invisible characters go, accents are composed, each run of
   white space becomes one blank and the ends are trimmed. Raised figures, quotation marks, punctuation and case stay.
2. Script-aware repair of look-alike letters. In each word the letters that exist in one script only decide the script of the word; a word without any
   such letter takes the script of its text (Latin where that has none either). Look-alikes from other scripts are candidates for that script's letter.
3. A candidate is used only where the repaired word exists in the vocabulary of the whole corpus: it is written so somewhere, or at least two different
   spellings lead to it. A word that is nowhere else stays as it is, so names in another alphabet survive and equal texts stay equal.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from attesta.session import cut

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian")
# Letters of the same shape, a class in each cell, in the order of SCRIPTS; "-" where a script has none.
SAME_SHAPE = """
a а - - | c с - - | d ԁ - - | e е - - | h һ - հ | i і - - | j ј ϳ - | l ӏ - - | o о ο օ | p р - - | q ԛ - - | s ѕ - - | v ѵ ν - | w ԝ - - | x х - - | y у - -
A А Α - | B В Β - | C С Ϲ - | E Е Ε - | G Ԍ - - | H Н Η - | I І Ι - | J Ј Ϳ - | K К Κ - | M М Μ - | N - Ν - | O О Ο Օ | P Р Ρ - | Q Ԛ - - | S Ѕ - Տ
T Т Τ - | V Ѵ - - | W Ԝ - - | X Х Χ - | Y Ү Υ - | Z - Ζ - | - П Π - | - Г Γ - | - Ф Φ -
"""
CLASSES = [cell.split() for cell in SAME_SHAPE.replace("\n", "|").split("|") if cell.strip()]
CLASS_OF = {letter: row for row in CLASSES for letter in row if letter != "-"}
#: Texts without any letter of these scripts need no repair.
OTHER_SCRIPTS = r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}]"

# Code points that show nothing.
INVISIBLE = [
    *range(0x00, 0x09), *range(0x0E, 0x1C), *range(0x7F, 0x85), *range(0x86, 0xA0), 0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810),
    *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xFFF9, 0xFFFC),
    *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE1000),
]
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _table() -> dict[int, str | None]:
    """Character by character: invisible ones to nothing; full-width, presentation forms and joined letters to their ordinary letters."""
    out: dict[int, str | None] = {}
    for code in range(0x80, 0x1FFFF):
        kind, _, _ = unicodedata.decomposition(ch := chr(code)).partition(" ")
        if kind in _SAME_LOOK or kind == "<compat>" and unicodedata.category(ch) in ("Lu", "Ll", "Lt", "Lo", "Nl") and ch not in "ſſtµ":
            out[code] = unicodedata.normalize("NFKC", ch)
    return out | dict.fromkeys(INVISIBLE)


TABLE = _table()
_TOUCHED = frozenset(map(chr, TABLE))
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_OTHER = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}]")
_OWN = [regex.compile(rf"[\p{{{s}}}--[{''.join(CLASS_OF)}]]", regex.V1) for s in SCRIPTS]
#: Longest run of characters between white space whose form is remembered, number of forms remembered, and of words that a task remembers to have told.
REMEMBERED_CHARS, REMEMBERED, TOLD = 64, 1 << 17, 1 << 18


def _fold_run(run: str) -> str:
    """Layer 1 for a run of characters without white space."""
    if not run.isascii():
        if not _TOUCHED.isdisjoint(run):
            run = run.translate(TABLE)
        run = unicodedata.normalize("NFC", run)
    elif not run.isprintable():
        run = run.translate(TABLE)
    return " ".join(run.split())


_remembered = lru_cache(REMEMBERED)(_fold_run)


def fold(text: str) -> str:
    """Layer 1 for one text. An empty text stays empty. White space parts a text into runs that fold by themselves; most of them are seen again and again."""
    runs = text.split()
    if text.isascii() and text.isprintable():
        return " ".join(runs)
    return " ".join(filter(None, [_remembered(r) if len(r) <= REMEMBERED_CHARS else _fold_run(r) for r in runs]))


def script_of(text: str) -> int | None:
    """Position in SCRIPTS of the script with most letters of its own, None without such letters; ties go to the first."""
    counts = [len(own.findall(text)) for own in _OWN]
    return counts.index(max(counts)) if any(counts) else None


def repairs(folded: str) -> dict[str, str]:
    """Layer 2: each word of a folded text that holds a look-alike from another script than its own, with its repaired spelling."""
    if not _OTHER.search(folded):
        return {}
    around = script_of(unicodedata.normalize("NFD", folded)) or 0
    found = {}
    for word in set(_WORD.findall(folded)):
        if word.isascii() and around == 0:
            continue
        plain = unicodedata.normalize("NFD", word)
        if CLASS_OF.keys().isdisjoint(plain):
            continue
        script = around if (own := script_of(plain)) is None else own
        fixed = "".join(ch if (row := CLASS_OF.get(ch)) is None else row[script] if row[script] != "-" else next(x for x in row if x != "-") for ch in plain)
        if (fixed := unicodedata.normalize("NFC", fixed)) != word:
            found[word] = fixed
    return found


def replaced(folded: str, words: dict[str, str]) -> str:
    return _WORD.sub(lambda m: words.get(m[0], m[0]), folded) if words else folded


@F.pandas_udf(T.StringType())
def fold_udf(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("fixed", T.StringType())])))
def repairs_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"word": w, "fixed": x} for w, x in repairs(t).items()])


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["_canon"] = [t if m is None else replaced(t, dict(m)) for t, m in zip(pdf["_canon"], pdf["_words"])]
        yield pdf.drop(columns="_words")


def _scan(keys: pa.Schema):
    """One pass over (keys, text): a row for each record with hashes of its text and of its folded text, the latter itself only where it may need repair, and
    a row for each different word. A task tells a word once as long as it remembers it."""
    schema = pa.schema([*keys, pa.field("own", pa.binary()), pa.field("form", pa.binary()), pa.field("folded", pa.string()), pa.field("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[str] = set()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            forms = [None if t is None else fold(t) for t in texts]
            runs = [set() if f is None else set(f.split(" ")) for f in forms]
            every = set().union(*runs)
            suspect = {r for r in every if not r.isascii() and _OTHER.search(r)}
            words = {w for r in every for w in ([r] if r.isalpha() else _WORD.findall(r))} - told
            if len(told) >= TOLD:
                told.clear()
            told |= words
            digest = lambda x: None if x is None else md5(x.encode("utf-8", "surrogatepass")).digest()
            n = len(words)
            columns = [pa.concat_arrays([batch.column(i), pa.nulls(n, f.type)]) for i, f in enumerate(keys)]
            columns += [pa.array([digest(x) for x in side] + [None] * n, pa.binary()) for side in (texts, forms)]
            columns.append(pa.array([None if suspect.isdisjoint(r) else f for r, f in zip(runs, forms)] + [None] * n, pa.string()))
            columns.append(pa.array([None] * len(texts) + sorted(words), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def scanned(rows: DataFrame, text: str) -> DataFrame:
    """rows without the text column but with ``own``, ``form`` (hashes), ``folded`` and ``word``; see _scan."""
    keys = rows.drop(text)
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in keys.schema], *[T.StructField(n, t) for n, t in (("own", T.BinaryType()), ("form", T.BinaryType()), ("folded", T.StringType()), ("word", T.StringType()))]])
    return rows.select(*keys.columns, text).mapInArrow(_scan(to_arrow_schema(keys.schema)), out)


def approved_repairs(seen: DataFrame) -> DataFrame:
    """(form, _words) for each folded text of ``scanned`` rows that needs repair: a map from its words to the repaired ones.

    Few words are ever candidates; only these are looked up in the vocabulary of the corpus.
    """
    spelled = (
        seen.where("folded IS NOT NULL").select("form", "folded").dropDuplicates(["form"])
        .select("form", F.explode(repairs_udf("folded")).alias("r"))
        .select("form", "r.word", "r.fixed")
    )
    ways = spelled.groupBy("fixed").agg(F.min("word").alias("first"), F.max("word").alias("last"))
    known = seen.where("word IS NOT NULL").select(F.col("word").alias("fixed"), F.lit(True).alias("written")).distinct()
    approved = ways.join(known, "fixed", "left").where(F.col("written") | (F.col("first") != F.col("last"))).select("fixed")
    return spelled.join(approved, "fixed").groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("word", "fixed"))).alias("_words"))


def same_look_form(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """df with one more column: the consistent form of a text column, equal for all texts that look the same.

    Null texts give null, empty and blank texts give ''. Repeated rows and all other columns are kept as they are; if df has a column named ``out``,
    a ValueError says so. An empty table gives an empty table. A text of any length is handled within its own row.
    """
    if out in df.columns:
        raise ValueError(f"the table already has a column {out!r}")
    clash = [c for c in df.columns if c in ("_canon", "_form", "_words")]
    if clash:
        raise ValueError(f"reserved column names: {clash}")
    seen = cut(scanned(df.select(F.col(text).alias("_canon")), "_canon").where("folded IS NOT NULL OR word IS NOT NULL"))
    base = df.withColumn("_canon", fold_udf(F.col(text)))
    suspect = F.coalesce(F.col("_canon").rlike(OTHER_SCRIPTS), F.lit(False))
    columns = [F.col(c) for c in df.columns]
    clean = base.where(~suspect).select(*columns, F.col("_canon").alias(out))
    mixed = base.where(suspect).withColumn("_form", F.unhex(F.md5("_canon"))).join(approved_repairs(seen).withColumnRenamed("form", "_form"), "_form", "left").drop("_form")
    schema = df.select(*columns, F.lit("").alias("_canon")).schema
    return clean.unionByName(mixed.mapInPandas(_apply, schema).withColumnRenamed("_canon", out))


def same_look_pairs(records: DataFrame, key: str, text: str, within: str) -> DataFrame:
    """Pairs (within, key_a < key_b) of records of one table whose texts look the same but are not the same characters.

    Texts are read and folded once. They are compared by 128-bit hashes of their form and of their characters. Only different spellings are paired, and each
    spelling then stands for its records, so exact copies, however many, are never paired with each other. Null texts and keys are left out, repeated rows of
    one key count once.
    """
    rows = records.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(within).alias("tab"), F.col(key).alias("key"), F.col(text).alias("own_text"))
    seen = cut(scanned(rows, "own_text"))
    # Texts whose repair was approved change their form; all others keep the one they were read with.
    mixed = seen.where("folded IS NOT NULL").select("form", "folded").dropDuplicates(["form"]).join(approved_repairs(seen), "form")
    mixed = mixed.select("form", F.col("folded").alias("_canon"), "_words").mapInPandas(_apply, "form binary, _canon string")
    renamed = mixed.select(F.col("form").alias("old"), F.unhex(F.md5("_canon")).alias("new"))
    rows = seen.where("own IS NOT NULL").select("tab", "key", "own", "form", F.col("folded").isNotNull().alias("suspect"))
    moved = rows.where("suspect").join(renamed, F.col("form") == F.col("old"), "left").select("tab", "key", "own", F.coalesce("new", "form").alias("form"))
    rows = rows.where("NOT suspect").drop("suspect").unionByName(moved)
    many = rows.groupBy("tab", "form").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo != hi").select("tab", "form")
    rows = cut(rows.join(many, ["tab", "form"], "left_semi").distinct())
    spellings = rows.select("tab", "form", "own").distinct()
    a, b = (spellings.select("tab", "form", F.col("own").alias(f"own_{x}")) for x in "ab")
    pairs = a.join(b, ["tab", "form"]).where("own_a < own_b").select("tab", "own_a", "own_b")
    for x in "ab":
        pairs = pairs.join(rows.select("tab", F.col("own").alias(f"own_{x}"), F.col("key").alias(f"key_{x}")), ["tab", f"own_{x}"])
    return pairs.where("key_a != key_b").select("tab", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()
