"""Text functions as SQL expressions over a column name or expression, so that they stay inside the JVM and run inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell nothing, the first block general English, the second statutory formulas.
STOPWORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does doing down
during each few for from further had has have having he her here hers him his how i if in into is it its itself me more most my nor of on once only or other
ought our ours out over own same she should so some such than that the their theirs them then there these they this those through to too under until up very
was we were what when where which while who whom why will with would you your yours
section sections sub subsection clause act shall may said provided hereby thereof therein thereto whoever person persons india indian state law court case means
includes respect
""".split()
# Words that turn a statement round; words and phrases that narrow it; words about recent change.
NEGATIONS = "not no nor never unless except save without neither".split()
QUALIFIER = (
    r"(?i)\b(unless|except|provided that|save as|save that|subject to|shall not apply|other than|only if|notwithstanding|no obligation|"
    r"does not (?:apply|extend)|nothing in this)\b"
)
RECENT = r"(?i)\b(recent|recently|amended|amendment|new|latest|repealed|struck down|now|currently|as of|today|still in force)\b"
# Endings taken off a word, in this order.
ENDINGS = "ations ation ingly ising izing ings ing able ible edly ed es ly s".split()
# Numbers in words.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "lakh": 100000, "lakhs": 100000, "crore": 10000000,
    "crores": 10000000, "million": 1000000, "billion": 1000000000,
}
# Spellings of references and of versus; quotation marks and dashes.
SPELLINGS = [
    ("§", "section "), (r"\bsec\.\s*", "section "), (r"\bsecs\.\s*", "sections "), (r"\bs\.\s*(?=\d)", "section "), (r"\bart\.\s*", "article "), (r"\bcl\.\s*", "clause "),
    (r"\bsub-?sec\.\s*", "subsection "), (r"\bsub-?s\.\s*", "subsection "), (r"\bvs?\.\s*", "v "), (r"\bversus\b", "v"), (r"\bi\.p\.c\.", "ipc"), (r"\bcr\.p\.c\.", "crpc"),
    (r"\bi\.e\.a\.", "iea"), (r"\ba\.i\.r\.", "air"), (r"\bs\.c\.c\.", "scc"), (r"\bu\.o\.i\.", "uoi"),
]
SINGLE, DOUBLE, DASHES = "‘’‚‛′", "“”„‟″", "‐‑‒–—―−"
# Phrases that a search for narrowing provisions looks for; the form of a case citation; characters of a quote that are checked.
QUALIFIER_SEARCH = r"(?i)(notwithstanding|shall not apply|there shall be no obligation|nothing in this|not be enforceable|provided that|except)"
CASE_CITATION = r"\(\d{4}\)\s*\d+\s*[A-Z]{2,4}\s*\d+"
MOST_QUOTE_CHARS = 600
# Fixed value: where a provision may be split, after a mark that ends a sentence or clause.
SENTENCE_GAP = r"(?<=[.;:—])\s+(?=[A-Z(\d])"
DROPPED = "​‌‍﻿­"


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def tokens(text: str) -> str:
    """Lower-cased runs of letters and digits."""
    return rf"filter(split(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}\\s]+', ' '), '\\s+'), x -> x != '')"


def stem(word: str) -> str:
    cases = " ".join(f"WHEN {word} LIKE '%{e}' AND length({word}) >= {len(e) + 4} THEN left({word}, length({word}) - {len(e)})" for e in ENDINGS)
    return f"CASE WHEN length({word}) <= 4 THEN {word} {cases} ELSE {word} END"


def content_tokens(text: str) -> str:
    """Distinct stems, in order, of the tokens of three or more characters that are no stopwords."""
    return f"array_distinct(transform(filter({tokens(text)}, t -> length(t) >= 3 AND NOT array_contains({_list(STOPWORDS)}, t)), t -> {stem('t')}))"


def _number(word: str) -> str:
    pairs = ", ".join(f"'{w}', '{n}'" for w, n in NUMBER_WORDS.items())
    return f"CASE WHEN {word} RLIKE '^[0-9]+$' THEN regexp_replace({word}, '^0+(?=.)', '') ELSE try_element_at(map({pairs}), {word}) END"


def numeric_tokens(text: str) -> str:
    """Numbers in digits or words as digits, sorted as text."""
    return f"array_sort(filter(transform({tokens(text)}, t -> {_number('t')}), n -> n IS NOT NULL))"


def number_like(word: str) -> str:
    """Whether a token is a number in digits or in words."""
    return f"({_number(word)}) IS NOT NULL"


def sorted_terms(text: str) -> str:
    """All content tokens, repeats among them, in alphabetical order."""
    return f"array_sort(transform(filter({tokens(text)}, t -> length(t) >= 3 AND NOT array_contains({_list(STOPWORDS)}, t)), t -> {stem('t')}))"


def term_set(text: Column) -> Column:
    """The distinct terms of ``sorted_terms``, in near linear time (array_distinct compares all pairs of strings)."""
    return F.filter(text, lambda t, i: (i == 0) | (t != F.try_element_at(text, i)))


def char_ngrams(text: str, n: int = 5) -> str:
    """The 64-bit hashes of the distinct substrings of n characters of the squashed lower-cased text; none for shorter texts. Hashes, as sets of numbers are
    compared in linear time. For texts of the length of a quote."""
    s = rf"trim(regexp_replace(lower({text}), '\\s+', ' '))"
    grams = f"array_distinct(transform(sequence(1, length(s) - {n - 1}), i -> xxhash64(substring(s, i, {n}))))"
    # The text is bound once by the outer lambda; inside the inner one it would be made anew for each place.
    return f"transform(array({s}), s -> CASE WHEN length(s) >= {n} THEN {grams} ELSE CAST(array() AS ARRAY<BIGINT>) END)[0]"


def squash(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[\\s\\x{{A0}}]+', ' '))"


def truncate(text: str, most: int) -> str:
    return f"CASE WHEN length({text}) > {most} THEN concat(left({text}, {most - 1}), '…') ELSE {text} END"


def split_long(text: str, most: int) -> str:
    """The parts of a text of at most ``most`` characters: whole sentences and clauses as long as they fit, and longer ones cut where the room ends.

    A text that fits is its only part, without blanks at its ends; null and blank texts have no parts.
    """
    body = r"regexp_replace(%s, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '')" % text
    state = lambda done, open_: f"named_struct('done', {done}, 'open', {open_})"
    step = f"CASE WHEN a.open = '' THEN {state('a.done', 's')} WHEN length(a.open) + 1 + length(s) > {most} THEN {state('array_append(a.done, a.open)', 's')} ELSE {state('a.done', "concat(a.open, ' ', s)")} END"
    packed = f"aggregate(split(t, {sql_text(SENTENCE_GAP)}), {state('CAST(array() AS ARRAY<STRING>)', "''")}, (a, s) -> {step}, a -> array_append(a.done, a.open))"
    cuts = f"flatten(transform({packed}, p -> transform(sequence(0, (length(p) - 1) div {most}), i -> substring(p, CAST(i * {most} + 1 AS INT), {most}))))"
    parts = f"CASE WHEN t IS NULL OR t = '' THEN CAST(array() AS ARRAY<STRING>) WHEN length(t) <= {most} THEN array(t) ELSE {cuts} END"
    # The text is bound once by the outer lambda.
    return f"transform(array({body}), t -> {parts})[0]"


def level1(text: str) -> str:
    """Folded text for matching: full-width forms, hyphens at line ends, quotes, dashes, digits and spellings of references made alike, in lower case."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    s = f"translate({text}, {sql_text(wide + 'ﬁﬂ' + SINGLE + DOUBLE + DASHES + '०१२३४५६७८९' + DROPPED)}, {sql_text(narrow + 'ﬁﬂ' + chr(39) * 5 + chr(34) * 5 + '-' * 7 + '0123456789')})"
    s = f"replace(replace({s}, 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    s = rf"lower(regexp_replace({s}, '-[ \\t]*\\n[ \\t]*', ''))"
    for pattern, value in SPELLINGS:
        s = f"regexp_replace({s}, {sql_text(pattern)}, '{value}')"
    s = rf"regexp_replace({s}, '(?<=[0-9]),(?=[0-9])', '')"
    return rf"trim(regexp_replace({s}, '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' '))"


def level2(folded: str) -> str:
    """Only the letters and digits of a text of level 1, words apart by one blank."""
    return rf"trim(regexp_replace({folded}, '[^\\p{{L}}\\p{{N}}]+', ' '))"


def negation_count(folded: str) -> str:
    """Words of a text of level 2 that turn a statement round."""
    return f"size(filter(split({folded}, ' '), w -> array_contains({_list(NEGATIONS)}, w)))"


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 1 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def html_to_text(html: str) -> str:
    """The shown text of a page: scripts, styles and comments dropped, ends of blocks as line breaks, common entities decoded."""
    s = f"regexp_replace({html}, {sql_text(r'(?is)<(script|style|noscript)[^>]*>.*?</\1>|<!--.*?-->')}, ' ')"
    s = f"regexp_replace({s}, {sql_text(r'(?i)</(p|div|li|tr|h[1-6]|section|article|blockquote)>|<br[^>]*>')}, '\\n')"
    s = rf"regexp_replace({s}, '<[^>]+>', ' ')"
    for entity, value in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        s = f"replace({s}, '{entity}', {sql_text(value)})"
    parts = rf"split({s}, '(?=&#[0-9]{{1,6}};)')"
    decoded = r"CASE WHEN x RLIKE '^&#[0-9]{1,6};' THEN concat(decode(unhex(lpad(hex(CAST(regexp_extract(x, '^&#([0-9]+);', 1) AS INT)), 8, '0')), 'UTF-32'), regexp_replace(x, '^&#[0-9]+;', '')) ELSE x END"
    s = f"array_join(transform({parts}, x -> {decoded}), '')"
    return rf"trim(regexp_replace(regexp_replace({s}, '[ \\t]+', ' '), '\\n\\s*\\n\\s*\\n+', '\\n\\n'))"


def escaped(words: str) -> str:
    """A phrase as a pattern."""
    return re.escape(words)
