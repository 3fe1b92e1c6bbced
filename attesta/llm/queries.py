"""Queries over the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import langid, leak, lookalike, mix, neardup, spans, split
from attesta.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("key"), "text")
    quotes = table(spark, sf_dir, "quotes").select(F.lit("quotes").alias("tab"), F.col("quote_id").alias("key"), F.col("quote").alias("text"))
    return lookalike.same_look_pairs(docs.unionByName(quotes), "key", "text", "tab")


def _span_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Provisions are indexed first, quotes come as the next batch."""
    quotes = table(spark, sf_dir, "quotes").withColumn("rec", F.concat(F.lit("quote::"), F.col("quote_id").cast("string")))
    return [spans.parts_of(table(spark, sf_dir, "chunks"), "chunk_id", ["text"]), spans.parts_of(quotes, "rec", ["source", "quote"])]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.record_pairs(*spans.shared_matches(_span_batches(spark, sf_dir), spark))


def p3_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record is shared elsewhere."""
    batches = _span_batches(spark, sf_dir)
    return spans.shared_cover(*spans.shared_matches(batches, spark), batches[0].unionByName(batches[1]))


def p3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of each record that are shared elsewhere, with their place."""
    batches = _span_batches(spark, sf_dir)
    return spans.shared_passages(*spans.shared_matches(batches, spark), batches[0].unionByName(batches[1])).drop("tid")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.pairs_of_records(*neardup.near_duplicates(table(spark, sf_dir, "chunks"), "chunk_id", "text"))
    return pairs.select(F.col("rec_a").alias("chunk_a"), F.col("rec_b").alias("chunk_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each provision."""
    return neardup.groups_of_records(*neardup.near_duplicates(table(spark, sf_dir, "chunks"), "chunk_id", "text")).withColumnRenamed("rec", "chunk_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_texts(table(spark, sf_dir, "chunks").select("chunk_id", "text")).where("piece_count > 1").select("chunk_id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all provisions, with their place in the whole document where the offsets of the provision fit its text."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "doc_id", "text", "char_start", "char_end").dropDuplicates(["chunk_id", "text"])
    fits = F.col("char_end") - F.col("char_start") == F.length("text")
    out = split.split_texts(chunks)
    place = [F.when(fits, F.col("char_start") + F.col(c)).alias(f"doc_{c}") for c in ("piece_start", "piece_end")]
    return out.select("chunk_id", "doc_id", "piece_no", "piece_count", "piece_start", "own_start", "piece_end", *place, "piece_text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("edits = 0 AND run_words >= 13").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also passages with one word changed, with the longest unchanged run."""
    return _leaks(spark, sf_dir)


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.document_languages(docs, "doc_id", "text", "lang", langid.train(docs, "doc_id", "text", "lang"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).where("verdict IN ('missing', 'wrong', 'mixed')").select("doc_id", F.explode("langs").alias("lang"))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document with its confidence, and what is the matter with its label."""
    return _languages(spark, sf_dir).select("doc_id", "lang", "text_lang", F.round("confidence", 6).alias("confidence"), "verdict")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.language_segments(docs, "doc_id", "text", langid.train(docs, "doc_id", "text", "lang"))


def _mixed(spark: SparkSession, sf_dir: str, hold: str = "size") -> tuple[DataFrame, DataFrame]:
    sized = mix.sized_documents(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    arcs = mix.allotments(sized, table(spark, sf_dir, "mix_targets"), hold)
    return mix.selected_documents(sized, arcs), arcs


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each plan, and how often each is used for which source."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("doc", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of each plan."""
    return mix.reached_shares(*_mixed(spark, sf_dir))


def p7_shares_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares where each plan gives up size to hold its shares."""
    return mix.reached_shares(*_mixed(spark, sf_dir, "shares"))


def queries() -> dict:
    return {"p1_found": p1_found, "p3_found": p3_found, "p3_cover": p3_cover, "p3_passages": p3_passages, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_leaks": p6_leaks, "p7_selection": p7_selection, "p7_shares": p7_shares, "p7_shares_held": p7_shares_held, "p8_found": p8_found, "p8_documents": p8_documents, "p8_segments": p8_segments}


# Every 120 characters of every field, by hash and then by themselves.
_SPANS = """WITH fl AS (SELECT DISTINCT chunk_id AS rec, text AS t FROM chunks UNION SELECT 'quote::' || quote_id, source FROM quotes UNION SELECT 'quote::' || quote_id, quote FROM quotes),
 w AS (SELECT rec, substring(t, i, 120) AS s FROM (SELECT rec, t, unnest(range(1, length(t) - 118)) AS i FROM fl WHERE length(t) >= 120)),
 d AS (SELECT DISTINCT rec, s FROM w) SELECT DISTINCT a.rec AS rec_a, b.rec AS rec_b FROM d a JOIN d b ON a.s = b.s AND a.rec < b.rec"""
# White space of Unicode; sets of substrings of 5 characters, counted where they meet.
_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_GRAMS = f"""WITH tx AS (SELECT DISTINCT chunk_id AS c, trim(regexp_replace(lower(text), '{_SPACE}', ' ', 'g')) AS t FROM chunks WHERE text IS NOT NULL),
 g AS (SELECT DISTINCT c, substring(t, i, 5) AS s FROM (SELECT c, t, unnest(range(1, greatest(length(t) - 3, 2))) AS i FROM tx)), n AS (SELECT c, count(*) AS n FROM g GROUP BY c),
 m AS (SELECT a.c AS x, b.c AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.c < b.c GROUP BY 1, 2)
 SELECT x AS chunk_a, y AS chunk_b FROM m JOIN n p ON p.c = x JOIN n q ON q.c = y WHERE k >= 0.8::DOUBLE * (p.n + q.n - k)"""


# Words of documents and items, written without the operator's pieces: full-width forms, joined letters and look-alikes to Latin letters (no text of the
# tables is in a language of another script with look-alikes), then every 13 words in a row.
_LOOKS = [(x, row[0]) for row in lookalike.CLASSES if row[0] != "-" for x in row[1:] if x != "-"]
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_FORM = f"translate(t, '{_WIDE}{''.join(a for a, _ in _LOOKS)}', '{''.join(chr(ord(c) - 0xFEE0) for c in _WIDE).replace(chr(39), chr(39) * 2)}{''.join(b for _, b in _LOOKS)}')"
for _joined, _apart in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
    _FORM = f"replace({_FORM}, '{_joined}', '{_apart}')"
_ALL_WORDS = rf"list_filter(list_transform(string_split_regex(lower(nfc_normalize({_FORM})), '{_SPACE}'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')), lambda x: x <> '')"
_RUNS = f"""WITH tx AS (SELECT 'd' AS tab, doc_id AS k, text AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, text FROM eval_items WHERE text IS NOT NULL),
 w AS (SELECT tab, k, {_ALL_WORDS} AS w FROM tx), r AS (SELECT DISTINCT tab, k, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT tab, k, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13))
 SELECT DISTINCT d.k AS doc_id, i.k AS item_id FROM r d JOIN r i ON d.run = i.run AND d.tab = 'd' AND i.tab = 'i'"""

_HIDDEN = "[" + "".join(rf"\x{{{c:X}}}" for c in lookalike.INVISIBLE) + "]+"
_SAME = rf"""WITH tx AS (SELECT DISTINCT 'documents' AS tab, doc_id AS k, text AS t FROM documents WHERE text IS NOT NULL UNION SELECT 'quotes', quote_id, quote FROM quotes WHERE quote IS NOT NULL),
 f AS (SELECT tab, k, t, trim(regexp_replace(nfc_normalize(regexp_replace({_FORM}, '{_HIDDEN}', '', 'g')), '{_SPACE}', ' ', 'g')) AS form FROM tx)
 SELECT DISTINCT a.tab, a.k AS key_a, b.k AS key_b FROM f a JOIN f b ON a.tab = b.tab AND a.form = b.form AND a.k < b.k AND a.t <> b.t"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _SAME, "p6_found": _RUNS, "p3_found": _SPANS, "p4_found": _GRAMS, "p5_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 1200"}
