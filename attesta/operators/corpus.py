"""The corpus: documents cut into chunks with offsets, their metadata and statistics, and reads of parts of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.functions.filters import all_of, where

# What status, kind of document and state of verification may be.
STATUSES = ["in_force", "applies_to_prior_offences", "repealed", "struck_down", "read_down", "amended"]
DOC_TYPES = ["act", "constitution", "judgment", "rule", "web"]
VERIFICATIONS = ["unverified", "verified", "disputed"]
BROWSED = ("act_code", "doc_type", "status", "doc_id", "section_no")


def one_chunk_each(chunks: DataFrame, *columns: str, key: str = "chunk_id", at: str = "ingested_at", batch: str = "ingest_batch") -> DataFrame:
    """The last delivery of each chunk; of deliveries at one time that of the greatest batch, of equal batches that with the greatest values.

    Only the key, the two that tell the delivery and the asked columns (none: all) are read and travel, once, reduced inside each task first.
    """
    shown = [c for c in columns or chunks.columns if c != key]
    last = chunks.groupBy(key).agg(F.max(F.struct(F.col(at).alias("r0"), F.col(batch).alias("r1"), *[F.col(c).alias(f"c_{c}") for c in shown])).alias("row"))
    return last.select(key, *[F.col(f"row.c_{c}").alias(c) for c in shown])


def document_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and characters of each document."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.min("act_code").alias("act_code"), F.max("seq").alias("last_seq"))


def rollup(chunks: DataFrame, *dimensions: str) -> DataFrame:
    """Rows by each dimension alone, in one pass: (dimension, value, n). Empty and null values count as '—'."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.nullif(F.col(d).cast("string"), F.lit("")), F.lit("—")).alias("value")) for d in dimensions])).alias("p")
    return chunks.select(pairs).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def browse(rows: DataFrame, equal: dict[str, str | None], words: str | None = None, limit: int = 50, offset: int = 0, key: str = "chunk_id") -> DataFrame:
    """A page of rows in the order of their key, filtered by equal values and a text pattern. At most 500 rows a page."""
    if unknown := set(equal) - set(BROWSED):
        raise ValueError(f"no filter for {sorted(unknown)}")
    spec = all_of(*[{f: {"$eq": v}} for f, v in equal.items() if v], {"text": {"$regex": words}} if words else None)
    return rows.where(where(spec)).orderBy(key).offset(max(0, offset)).limit(max(1, min(500, limit)))


def offsets(parts: DataFrame, doc: str = "doc_id", seq: str = "seq", text: str = "text", gap: int = 2) -> DataFrame:
    """start_at and end_at of each part when the parts of a document are joined with ``gap`` characters between them; part_no counts from 0."""
    order = Window.partitionBy(doc).orderBy(seq)
    start = F.coalesce(F.sum(F.length(text) + gap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = parts.withColumn("part_no", F.row_number().over(order) - 1).withColumn("start_at", start.cast("int"))
    return rows.withColumn("end_at", F.col("start_at") + F.length(text))


def carried(parts: DataFrame, doc: str = "doc_id", seq: str = "seq", text: str = "text", most: int = 150) -> DataFrame:
    """with_carry: each part behind the last characters of the part before it in its document."""
    before = F.lag(text).over(Window.partitionBy(doc).orderBy(seq))
    return parts.withColumn("with_carry", F.when(before.isNull(), F.col(text)).otherwise(F.concat(F.lit("…"), F.right(before, F.lit(most)), F.lit(" "), F.col(text))))


def provision_parts(provisions: DataFrame, most: int = 1200, key: str = "chunk_id", text_column: str = "text", heading: str = "heading") -> DataFrame:
    """(key, part_no, n_parts, part, block): provisions longer than ``most`` split at ends of sentences; block is the part below its heading, which numbers the
    parts after the first. Null and blank texts have no parts; a null heading counts as empty and leaves no line."""
    rows = provisions.select(key, F.coalesce(heading, F.lit("")).alias("heading"), F.expr(text.split_long(text_column, most)).alias("parts"))
    rows = rows.select(key, "heading", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part_no", "part"))
    more = F.when(F.col("part_no") > 0, F.format_string(" (continued %d)", F.col("part_no") + 1)).otherwise("")
    line = F.trim(F.concat("heading", more))
    return rows.select(key, "part_no", "n_parts", "part", F.when(line != "", F.concat(line, F.lit("\n"), "part")).otherwise(F.col("part")).alias("block"))


def passages(sources: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, seq, passage): the chunks of the stored texts, cut out by their offsets."""
    rows = sources.select("doc_id", "text", F.explode("chunks").alias("c"))
    return rows.select("doc_id", "c.chunk_id", "c.seq", F.substring(F.col("text"), F.col("c.char_start") + 1, F.col("c.char_end") - F.col("c.char_start")).alias("passage"))


def last_sources(sources: DataFrame, *columns: str) -> DataFrame:
    """doc_id and the asked columns of the last delivery of each stored document, all from one row. Times are compared as times; unreadable ones come first."""
    row = F.max(F.struct(F.col("ingested_at").try_cast("timestamp").alias("r0"), *[F.col(c).alias(f"c_{c}") for c in columns])).alias("row")
    return sources.groupBy("doc_id").agg(row).select("doc_id", *[F.col(f"row.c_{c}").alias(c) for c in columns])


def with_defaults(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks with the metadata of their document as last stored; missing values become '' and the defaults of their column, missing offsets stay null."""
    docs = last_sources(sources, "doc_title", "doc_type", "source_url", "verification_status")
    default = {"doc_type": "act", "verification_status": "unverified", "status": "in_force"}
    filled = {"jurisdiction": "IN", "ingest_batch": "manual"}
    of_chunk = ["act_code", "section_no", "subsection_no", "article_no", "ref_key", "ref_key_alt", "title_path", "heading", "effective_from", "effective_to", "superseded_by", "struck_down_by", "para_no"]
    absent = ["court", "citation_str", "case_name"]
    rows = chunks.join(docs, "doc_id", "left")
    have = set(rows.columns)
    value = lambda c, d="": F.coalesce(F.col(c), F.lit(d)).alias(c) if c in have else F.lit(d).alias(c)
    year = F.coalesce(F.col("case_year").cast("int"), F.lit(0)) if "case_year" in have else F.lit(0)
    place = [F.col(c) if c in have else F.lit(None).cast("int").alias(c) for c in ("char_start", "char_end")]
    return rows.select(
        "chunk_id", "doc_id", "seq", *[value(c) for c in ("doc_title", "source_url", *of_chunk, *absent)], *[value(c, d) for c, d in filled.items()], year.alias("case_year"), *place,
        *[F.coalesce(F.nullif(F.lower(F.trim(F.col(c) if c in have else F.lit(""))), F.lit("")), F.lit(d)).alias(c) for c, d in default.items()],
    )


def provision_label(section: Column, subsection: Column, article: Column, para: Column) -> Column:
    bracket = F.when(subsection != "", F.concat(F.lit("("), subsection, F.lit(")"))).otherwise("")
    return F.when(article != "", F.concat(F.lit("Article "), article, bracket)).when(section != "", F.concat(F.lit("Section "), section, bracket)).when(para != "", F.concat(F.lit("Para "), para))


def source_label(rows: DataFrame) -> Column:
    """Title, provision and heading, as far as there are any; of judgments the case, its citation and paragraph (a case without a name goes by its title), of
    web pages the title or else the address."""
    parts = [F.col("doc_title"), provision_label(F.col("section_no"), F.col("subsection_no"), F.col("article_no"), F.col("para_no")), F.col("heading")]
    case = [F.coalesce(F.nullif("case_name", F.lit("")), "doc_title"), F.col("citation_str"), F.when(F.col("para_no") != "", F.concat(F.lit("para "), "para_no"))]
    joined = lambda xs: F.concat_ws(" — ", *[F.nullif(x, F.lit("")) for x in xs])
    web = F.coalesce(F.nullif("doc_title", F.lit("")), "source_url")
    return F.when(F.col("doc_type") == "judgment", joined(case)).when(F.col("doc_type") == "web", web).otherwise(joined(parts))


def violations(rows: DataFrame) -> DataFrame:
    """(chunk_id, problem) for metadata outside its rules, one row a problem."""
    checks = {
        "status": ~F.col("status").isin(STATUSES),
        "doc_type": ~F.col("doc_type").isin(DOC_TYPES),
        "verification": ~F.col("verification_status").isin(VERIFICATIONS),
        "no_offset": F.col("char_start").isNull() | F.col("char_end").isNull(),
        "no_key": (F.col("ref_key") == "") & (F.col("para_no") == ""),
        "no_title": F.col("doc_title") == "",
        "dates": (F.col("effective_to") != "") & (F.col("effective_from") != "") & (F.col("effective_to") < F.col("effective_from")),
    }
    return rows.select("chunk_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("problem"))


def source_list(sources: DataFrame) -> DataFrame:
    """Each stored document as last delivered: title, type, passages and characters."""
    return last_sources(sources, "doc_title", "doc_type", "chunks", "text").select("doc_id", "doc_title", "doc_type", F.size("chunks").alias("n_chunks"), F.length("text").alias("n_chars"))


def web_id(address: Column) -> Column:
    """The id of a stored web page."""
    return F.concat(F.lit("web::"), F.sha1(address))


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows with one of the wanted ids; ids may repeat."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows that are left when all with one of the ids are deleted. Rows without an id stay."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def known_ids(rows: DataFrame, known: DataFrame, key: str, out: str = "valid") -> DataFrame:
    """rows with a flag that tells whether their id is among the known ones."""
    return rows.join(known.select(key, F.lit(True).alias(out)).distinct(), key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def ingest_totals(chunks: DataFrame, *by: str) -> DataFrame:
    """Documents, chunks and characters, in all or by group."""
    return chunks.groupBy(*by).agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))


def made_ids(parts: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """made_id: the number of each part in its document, in its id."""
    number = F.row_number().over(Window.partitionBy(doc).orderBy(seq)) - 1
    return parts.withColumn("made_id", F.concat(F.col(doc), F.lit("::c"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))))


def read_passages(anchors: DataFrame, chunks: DataFrame, width: int = 1, most: int = 3000) -> DataFrame:
    """(anchor_id, n, passage): each anchor with its neighbours in order, joined, at most ``most`` characters. At most seven chunks meet for one anchor."""
    found = neighbours(anchors, chunks, width).join(chunks.select("chunk_id", "text"), "chunk_id")
    parts = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "text"))).alias("parts"))
    return parts.select("anchor_id", F.size("parts").alias("n"), F.left(F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n"), F.lit(most)).alias("passage"))


def neighbours(anchors: DataFrame, chunks: DataFrame, width: int = 1) -> DataFrame:
    """(anchor_id, chunk_id, seq, is_anchor): the chunks up to ``width`` (0 to 3) places before and after each anchor in its document.

    Each anchor asks for its places, so this is a join on equal (doc_id, seq), not on a range.
    """
    width = max(0, min(3, width))
    asked = anchors.select(F.col("chunk_id").alias("anchor_id"), "doc_id", F.col("seq").alias("at"), F.explode(F.sequence(F.col("seq") - width, F.col("seq") + width)).alias("seq"))
    found = asked.join(chunks.select("chunk_id", "doc_id", "seq"), ["doc_id", "seq"])
    return found.select("anchor_id", "chunk_id", "seq", (F.col("seq") == F.col("at")).alias("is_anchor"))
