"""Checking quotes against the text they claim to come from: exact, normalised and fuzzy matching, guards, and their evaluation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.functions.places import located
from attesta.session import kept

# Similarities from which a quote counts as verified and partly verified; Jaccard of tokens below which a window is not compared; slack of widths.
VERIFIED, PARTIAL, PREFILTER, SLACK, LEAST_CHARS = 0.95, 0.75, 0.5, 0.2, 40
THRESHOLDS = (0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 0.99)
# Words by which a quote is looked for in all texts.
PROBE_WORDS = 6


def levels(rows: DataFrame, source: str = "source", quote: str = "quote") -> DataFrame:
    """rows with s1, q1 (level 1) and s2, q2 (level 2) of both texts."""
    # One-element explodes keep the long expressions from being copied into every place that uses them.
    one = F.explode(F.array(F.struct(F.expr(text.level1(source)).alias("s1"), F.expr(text.level1(quote)).alias("q1"))))
    rows = rows.withColumn("l1", one).withColumns({"s1": F.col("l1.s1"), "q1": F.col("l1.q1")}).drop("l1")
    two = F.explode(F.array(F.struct(F.expr(text.level2("s1")).alias("s2"), F.expr(text.level2("q1")).alias("q2"))))
    return rows.withColumn("l2", two).withColumns({"s2": F.col("l2.s2"), "q2": F.col("l2.q2")}).drop("l2")


def tiered(rows: DataFrame, key: str = "quote_id", source: str = "source", quote: str = "quote") -> DataFrame:
    """One row for each quote with its levels and tier: exact, normalized or none."""
    # Little data but much work a row: kept in as many tasks as shuffles have, which adaptive execution would otherwise merge into one.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = levels(rows.select(key, F.col(source).alias("source"), F.col(quote).alias("quote")).repartition(parts, key).dropDuplicates([key]))
    tier = F.when((F.length("q1") > 0) & (F.instr("s1", F.col("q1")) > 0), "exact").when((F.length("q2") > 0) & (F.instr("s2", F.col("q2")) > 0), "normalized").otherwise("none")
    return rows.withColumn("tier", tier)


def near_windows(source: list[str], quote: list[str]) -> Iterator[tuple[int, int, str]]:
    """(width tried, place, words) of the windows of a source that share enough of their different words with a quote; counts move along with the window."""
    n, wanted, tried = len(quote), set(quote), []
    for width in (max(1, math.floor(n * (1 - SLACK))), n, max(1, math.ceil(n * (1 + SLACK)))):
        if width in tried or width > len(source):
            continue
        tried.append(width)
        counts = Counter(source[: width - 1])
        common = len(wanted & counts.keys())
        for at in range(len(source) - width + 1):
            new = source[at + width - 1]
            if counts[new] == 0:
                common += new in wanted
            counts[new] += 1
            if common >= PREFILTER * (len(wanted) + len(counts) - common):
                yield len(tried), at + 1, " ".join(source[at : at + width])
            old = source[at]
            counts[old] -= 1
            if counts[old] == 0:
                del counts[old]
                common -= old in wanted


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [(i, order, at, w, q) for i, (s, q) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) for order, at, w in near_windows(s.split(" "), q.split(" "))]
        i, order, at, w, q = zip(*own) if own else ((),) * 5
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i, pa.int64())), pa.array(order, pa.int32()), pa.array(at, pa.int32()), pa.array(w, pa.string()), pa.array(q, pa.string())], ["k", "order", "at", "w", "q"])


def matched(rows: DataFrame, key: str = "quote_id", source: str = "source", quote: str = "quote") -> DataFrame:
    """(key, tier, similarity, matched): exact where the quote stands in the source at level 1, normalized at level 2, else the most similar run of words.

    Only rows without an exact match go into the fuzzy step: windows of as many words as the quote has, and a fifth less or more, are kept if they share half
    of their words with the quote, and compared by edit distance. Ties go to the narrowest width tried first and the first place. Null or empty texts and
    windows of less than 0.675 give tier none.
    """
    rows = tiered(rows, key, source, quote)
    hit = rows.where("tier != 'none'").select(key, "tier", F.lit(1.0).alias("similarity"), F.when(F.col("tier") == "exact", F.col("q1")).otherwise(F.col("q2")).alias("matched"))
    open_rows = rows.where("tier = 'none'")
    kind = rows.schema[key].dataType.simpleString()
    windows = open_rows.where("s2 != '' AND q2 != ''").select(key, "s2", "q2").mapInArrow(_windows, f"k {kind}, order int, at int, w string, q string").withColumnRenamed("k", key)
    most = F.greatest(F.length("w"), F.length("q"))
    near = windows.withColumn("similarity", 1 - F.levenshtein("w", "q") / most).where(F.col("similarity") >= PARTIAL * 0.9)
    best = near.groupBy(key).agg(F.max_by(F.struct("similarity", "w"), F.struct("similarity", -F.col("order"), -F.col("at"))).alias("b"))
    fuzzy = open_rows.select(key).join(best, key, "left").select(key, F.when(F.col("b").isNull(), "none").otherwise("fuzzy").alias("tier"), F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"), F.col("b.w").alias("matched"))
    return hit.unionByName(fuzzy)


def _run_hashes(words: Column, n: int) -> Column:
    """Hashes of each n consecutive words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))


def elsewhere(wanted: DataFrame, texts: DataFrame, key: str = "quote_id", quote: str = "quote", text_key: str = "chunk_id", body: str = "text") -> DataFrame:
    """(key, found_in, n_texts): the quotes that stand in any of the texts at level 2, the least key of such a text and how many there are.

    A quote is looked for by one run of six words from its inside (its ends may be parts of words), a shorter one by its longest inner word; the runs of all
    texts are hashed and joined with these, and what meets is compared as a whole. Equal texts and equal quotes are compared once. Quotes of less than
    LEAST_CHARS characters at level 2 or of less than three words, null and empty texts are not looked for; repeated rows count once.
    """
    fold = lambda c: F.expr(text.level2(text.level1(c)))
    rows = wanted.select(key, fold(quote).alias("q")).where(F.length("q") >= LEAST_CHARS).distinct().withColumn("words", F.split("q", " ")).where(F.size("words") >= 3)
    inner = F.slice("words", F.lit(2), F.size("words") - 2)
    size = F.when(F.size("words") >= PROBE_WORDS + 2, F.lit(PROBE_WORDS)).otherwise(1)
    runs = F.transform(F.sequence(F.lit(1), F.size("inner") - F.col("size") + 1), lambda i: F.array_join(F.slice("inner", i, F.col("size")), " "))
    longest = F.array_max(F.transform(F.col("runs"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    probes = kept(rows.withColumns({"inner": inner, "size": size}).withColumn("runs", runs).select(key, "q", F.xxhash64(longest).alias("h")))
    # Each different text once, under the hash of its folded form.
    stored = kept(texts.where(F.col(body).isNotNull()).select(F.col(text_key).alias("owner"), fold(body).alias("t")).where("t != ''").withColumn("tid", F.xxhash64("t")))
    one = stored.select("tid", "t").dropDuplicates(["tid", "t"]).withColumn("words", F.split("t", " "))
    hashes = F.array_union(F.when(F.size("words") >= PROBE_WORDS, _run_hashes(F.col("words"), PROBE_WORDS)).otherwise(F.array().cast("array<bigint>")), _run_hashes(F.col("words"), 1))
    near = one.select("tid", F.explode(hashes).alias("h")).join(probes.select("q", "h").distinct(), "h").select("tid", "q").distinct()
    hits = near.join(stored.select("tid", "t", "owner"), "tid").where(F.instr("t", F.col("q")) > 0).groupBy("q").agg(F.min("owner").alias("found_in"), F.count_distinct("owner").alias("n_texts"))
    return probes.select(key, "q").join(hits, "q").select(key, "found_in", "n_texts")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tiers, sources, words = (batch.column(i).to_pylist() for i in (1, 2, 3))
        # Words of a fuzzy match are whole words of level 2.
        found = [located(s, w, 1 if t == "exact" else 2) or (None, None) for t, s, w in zip(tiers, sources, words)]
        start, end = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([None if a is None else s[a:b] for s, (a, b) in zip(sources, found)], pa.string())], ["k", "tier", "start", "end", "shown"])


def in_source(rows: DataFrame, matches: DataFrame, key: str = "quote_id", source: str = "source") -> DataFrame:
    """(key, tier, start, end, shown): where what a quote matched stands in the source as it is written: characters from start up to, not with, end.

    The first place counts. Matches of tier none have no row; start and end are null where compatibility forms that the match keeps apart hide the place.
    """
    texts = rows.select(key, F.col(source).alias("s")).dropDuplicates([key])
    kind = rows.schema[key].dataType.simpleString()
    both = matches.where("tier != 'none'").join(texts, key).select(key, "tier", "s", "matched")
    return both.mapInArrow(_places, f"k {kind}, tier string, start int, end int, shown string").withColumnRenamed("k", key)


def guarded(rows: DataFrame, matches: DataFrame, key: str = "quote_id", quote: str = "quote", source: str = "source", others: DataFrame | None = None) -> DataFrame:
    """matches with guards (those that fire, sorted) and status (verified, partially_verified, rejected) after them. A quote whose source has no text at hand
    fires source_unavailable and nothing else. With the result of ``elsewhere`` as ``others``, quotes that match nothing in their source but stand in another
    text fire wrong_source."""
    quotes = rows.select(key, F.expr(text.level1(quote)).alias("q1"), F.col(source).isNull().alias("unavailable")).dropDuplicates([key])
    both = matches.join(quotes, key)
    astray = F.lit(False)
    if others is not None:
        both, astray = both.join(others.select(key, F.lit(True).alias("astray")), key, "left"), F.coalesce("astray", F.lit(False)) & (F.col("tier") == "none")
    q2 = F.expr(text.level2("q1"))
    found = F.col("tier") != "none"
    short = (F.length(F.coalesce(q2, F.lit(""))) < LEAST_CHARS) & (F.col("tier") != "exact")
    numbers = found & (F.expr(text.numeric_tokens("q1")) != F.expr(text.numeric_tokens("matched")))
    negations = found & (F.expr(text.negation_count(text.level2("q1"))) != F.expr(text.negation_count(text.level2("matched"))))
    guards = F.array_compact(F.array(F.when(negations, "negation_mismatch"), F.when(numbers, "number_mismatch"), F.when(short, "quote_too_short"), F.when(astray, "wrong_source")))
    guards = F.when(F.col("unavailable"), F.array(F.lit("source_unavailable"))).otherwise(guards)
    base = F.when(F.col("tier").isin("exact", "normalized") | (F.col("similarity") >= VERIFIED), "verified").when(F.col("similarity") >= PARTIAL, "partially_verified").otherwise("rejected")
    rejected = F.array_contains("guards", "number_mismatch") | F.array_contains("guards", "quote_too_short") | F.array_contains("guards", "source_unavailable") | (F.col("base") == "rejected")
    demoted = F.array_contains("guards", "negation_mismatch")
    status = F.when(rejected, "rejected").when(demoted & (F.col("base") == "verified"), "partially_verified").when(demoted, "rejected").otherwise(F.col("base"))
    return both.withColumns({"guards": guards, "base": base}).select(key, "tier", F.round("similarity", 4).alias("similarity"), "guards", status.alias("status"))


def sweep(scored: DataFrame, genuine: str = "genuine", similarity: str = "similarity", blocked: str | None = None) -> DataFrame:
    """Precision, recall and F1 of taking a quote as genuine from each of THRESHOLDS on (and, if given, only where ``blocked`` is false). One pass."""
    taken = F.col(similarity) >= F.col("threshold")
    if blocked:
        taken = taken & ~F.col(blocked)
    rows = scored.where(F.col(genuine).isNotNull()).select(genuine, similarity, *([blocked] if blocked else []), F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold"))
    sums = rows.groupBy("threshold").agg(
        F.count_if(taken & F.col(genuine)).alias("tp"), F.count_if(taken & ~F.col(genuine)).alias("fp"), F.count_if(~taken & ~F.col(genuine)).alias("tn"), F.count_if(~taken & F.col(genuine)).alias("fn")
    )
    ratio = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a / b)
    sums = sums.withColumn("precision", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6))
    return sums.withColumn("f1", F.round(F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))), 6))


def covered_share(spans: DataFrame, key: str, start: str, end: str, size: str) -> DataFrame:
    """(key, covered, share): the part of each text that its spans cover together, by merging them in order. The spans of one text are as many as it was given."""
    order = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("reach", F.max(end).over(order))
    fresh = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce("reach", F.lit(0))), F.lit(0))
    return rows.groupBy(key).agg(F.sum(fresh).alias("covered"), F.max(size).alias("size")).select(key, "covered", F.when(F.col("size") > 0, F.round(F.col("covered") / F.col("size"), 6)).otherwise(0.0).alias("share"))
