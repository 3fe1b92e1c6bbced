"""References to provisions: parsing, keys, parents, labels, and the acts they belong to.

A key is ``ACT:S12(3)`` for sections and ``ACT:A12(3)(b)`` for articles. The acts come from a table (act_code, unit, names), which is small by nature; its
size is checked before its names go into a pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.session import cut

MOST_ACTS = 5000
# How sections and articles are written, for parsing one reference and for finding all in a text.
SECTION = r"(?i)(?:section|sections|sec\.?|s\.|§)\s*(\d+[A-Z]{0,2})(?:\s*\((\w+)\))?"
ARTICLE = r"(?i)(?:article|art\.?)\s*(\d+[A-Z]?)(?:\s*\((\w+)\))?(?:\s*\((\w+)\))?"
WRITTEN_SECTION = r"(?i)(?:section|sec\.?|s\.|§)\s*\d+[A-Z]{0,2}(?:\s*\(\w+\))?(?:\s*,?\s*of\s+(?:the\s+)?[A-Za-z .]{2,60})?"
WRITTEN_ARTICLE = r"(?i)(?:article|art\.)\s*\d+[A-Z]?(?:\s*\(\w+\))?(?:\s*\(\w+\))?"
WRITTEN_ANY = r"(?i)(section|sec\.|s\.|§|article|art\.)\s*\d"


def act_names(acts: DataFrame) -> list[tuple[str, str]]:
    """(name, act_code), the longest names first."""
    rows = acts.select("act_code", F.explode("names").alias("name")).distinct().limit(MOST_ACTS + 1).collect()
    if len(rows) > MOST_ACTS:
        raise ValueError(f"more than {MOST_ACTS} names of acts")
    return sorted({(r.name.lower(), r.act_code) for r in rows if r.name}, key=lambda x: (-len(x[0]), x))


def _pattern(names: list[str]) -> str:
    """All names in one pattern, by their first character, so that a place in a text is tried against few of them. Names come the longest first."""
    groups: dict[str, list[str]] = {}
    for name in names:
        body = r"\s+".join(map(re.escape, name.split()))
        groups.setdefault(name[0], []).append(body[len(re.escape(name[0])) :] + (r"\b" if name[-1].isalnum() else ""))
    return r"(?<![A-Za-z0-9_])(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in groups.items()) + ")"


def act_code(text: Column, names: list[tuple[str, str]]) -> Column:
    """The act that a text names, by its longest name in it; null without one.

    One pattern finds the names at hand; only of the texts that hold any the longest is told.
    """
    squashed = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[,’']", " "), r"\s+", " "))
    pattern = _pattern([n for n, _ in names])
    code = F.create_map(*[F.lit(x) for n, c in reversed(names) for x in (n, c)])
    # Looked for at each place, as a longer name may begin inside a shorter one.
    found = F.array_distinct(F.transform(F.regexp_extract_all(squashed, F.lit(f"(?=({pattern}))"), 1), lambda x: F.regexp_replace(x, r"\s+", " ")))
    longest = F.aggregate(found, F.lit(""), lambda best, x: F.when((F.length(x) > F.length(best)) | ((F.length(x) == F.length(best)) & (x < best)), x).otherwise(best))
    return F.try_element_at(code, longest)


def parsed(raw: Column, act: Column) -> Column:
    """A written reference as a struct; articles first, then sections, then a bare number after the name of an act (years are no numbers of sections)."""
    article, section = F.regexp_extract(raw, ARTICLE, 1), F.regexp_extract(raw, SECTION, 1)
    plain = F.regexp_replace(raw, r"\b(1[6-9]\d{2}|20\d{2})\b", " ")
    bare = r"(?i)\b(\d+[A-Z]{0,2})(?:\s*\((\w+)\))?"
    is_article, is_section = article != "", section != ""
    number = F.when(is_section, section).when(act.isNotNull(), F.regexp_extract(plain, bare, 1)).otherwise("")
    inner = F.when(is_section, F.regexp_extract(raw, SECTION, 2)).when(act.isNotNull(), F.regexp_extract(plain, bare, 2)).otherwise("")
    return F.struct(
        act.alias("act_code"),
        F.when(is_article, "").otherwise(F.upper(number)).alias("section"),
        F.when(is_article, "").otherwise(inner).alias("subsection"),
        F.upper(article).alias("article"),
        F.regexp_extract(raw, ARTICLE, 2).alias("clause"),
        F.regexp_extract(raw, ARTICLE, 3).alias("sub"),
    )


def ref_key(ref: Column) -> Column:
    """The key of a parsed reference; '' where it names no act or no number."""
    bracket = lambda c: F.when(c != "", F.concat(F.lit("("), c, F.lit(")"))).otherwise("")
    return (
        F.when(ref["act_code"].isNull(), "")
        .when(ref["article"] != "", F.concat(ref["act_code"], F.lit(":A"), ref["article"], bracket(ref["clause"]), bracket(ref["sub"])))
        .when(ref["section"] != "", F.concat(ref["act_code"], F.lit(":S"), ref["section"], bracket(ref["subsection"])))
        .otherwise("")
    )


def parents(key: Column) -> Column:
    """The keys above a key, the nearest first: one bracket off at a time."""
    once = F.regexp_replace(key, r"\(\w+\)$", "")
    twice = F.regexp_replace(once, r"\(\w+\)$", "")
    return F.when(once == key, F.array().cast("array<string>")).when(twice == once, F.array(once)).otherwise(F.array(once, twice))


def label(key: Column) -> Column:
    code, kind, rest = (F.regexp_extract(key, r"^([A-Z]+):([SA])(.+)$", i) for i in (1, 2, 3))
    return F.when(kind == "A", F.concat_ws(" Art. ", code, rest)).when(kind == "S", F.concat_ws(" s.", code, rest)).otherwise(key)


def mentions(df: DataFrame, key: str, text: str, acts: DataFrame, about: str | None = None) -> DataFrame:
    """(key, ref_key): every provision that a text names by number, with the act named right behind it, else anywhere in the text, else in column ``about``;
    and every number right behind the code of an act. Texts without any reference are passed over before the names of acts are looked for."""
    names = act_names(acts)
    codes = "|".join(re.escape(c) for c in sorted({c for _, c in names}, key=lambda c: (-len(c), c)))
    bare = rf"(?i)\b(?:{codes})\s+\d+[A-Z]{{0,2}}\b"
    whole = F.coalesce(act_code(F.col(text), names), *([F.col(about)] if about else []))
    raw = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(WRITTEN_SECTION), 0), F.regexp_extract_all(text, F.lit(WRITTEN_ARTICLE), 0)))
    rows = df.where(F.col(text).rlike(WRITTEN_ANY)).select(key, whole.alias("around"), F.explode(raw).alias("raw"))
    # What a text writes is written again and again; the act behind it is told once for each different one.
    acts_of = rows.select("raw").distinct().select("raw", act_code(F.col("raw"), names).alias("named"))
    rows = rows.join(acts_of, "raw").withColumn("act", F.coalesce("named", "around"))
    found = rows.select(key, ref_key(parsed(F.col("raw"), F.col("act"))).alias("ref_key")).where("ref_key != ''")
    if codes:
        short = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(bare), 0))).alias("raw"))
        found = found.unionByName(short.select(key, F.upper(F.regexp_replace("raw", r"^(\w+)\s+", "$1:S")).alias("ref_key")))
    return found.distinct()


def claim_references(claims: DataFrame, key: str, claim: str, source: str, sources: DataFrame, text: str, acts: DataFrame, given: str | None = None, about: str | None = None) -> DataFrame:
    """(key, ref_key, of_source): the provisions of a claim: those ``given`` (a column of arrays) and those its text names; where it has none, those of its source.

    ``source`` is the key of the source text, in claims as in sources, and ``about`` in both the act that is meant where a text names none; the references of a source are looked for once, however many claims it has. Null texts
    name nothing; a claim without any reference in either text has no row; repeated rows count once.
    """
    own = mentions(claims, key, claim, acts, about)
    if given:
        own = own.unionByName(claims.select(key, F.explode(given).alias("ref_key")).where("ref_key != ''")).distinct()
    own = cut(own)
    rest = claims.select(key, source).distinct().join(own.select(key).distinct(), key, "left_anti")
    told = mentions(sources.join(rest.select(source).distinct(), source, "left_semi"), source, text, acts, about)
    rest = rest.join(told, source).select(key, "ref_key").distinct()
    return own.withColumn("of_source", F.lit(False)).unionByName(rest.withColumn("of_source", F.lit(True)))


def closure(keys: DataFrame, equivalences: DataFrame, key: str = "ref_key") -> DataFrame:
    """(key, alias): a key, its parents, and all that is equivalent to any of these.

    An equivalence is stored once and holds both ways. As the reference table has chains, equivalents are followed until nothing new comes.
    """
    pairs = equivalences.select("a", "b").unionByName(equivalences.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    start = keys.select(F.col(key).alias("root")).where("root IS NOT NULL AND root != ''").distinct()
    out = start.select("root", F.explode(F.concat(F.array("root"), parents(F.col("root")))).alias("alias"))
    step = out
    while True:
        step = cut(step.join(pairs.withColumnRenamed("a", "alias"), "alias").select("root", F.col("b").alias("alias")).join(out, ["root", "alias"], "left_anti").distinct())
        if step.isEmpty():
            break
        out = out.unionByName(step)
    return out.select(F.col("root").alias(key), "alias")
