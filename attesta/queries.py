"""Registered queries of the core."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import oracles
from attesta.functions import refs, text
from attesta.functions.filters import all_of, where
from attesta.operators import corpus, history, metrics, quotes, retrieve
from attesta.session import cut, kept, shared_dir, table
from attesta.sources import files
from attesta.streaming import events as streams


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = history.replayed_history(table(spark, sf_dir, "status_updates"))
    return versions.select("doc_id", "ref_key", F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss").alias("valid_from"))


def p2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with its values and both ends of its validity."""
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("valid_from", "valid_to")]
    return history.replayed_history(table(spark, sf_dir, "status_updates")).select("doc_id", "ref_key", "version", *history.FIELDS, *shown, "is_current")


def _chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return corpus.one_chunk_each(table(spark, sf_dir, "chunks"), *columns)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


# Corpus


def corpus_documents(spark, sf_dir):
    return corpus.document_stats(_chunks(spark, sf_dir, "doc_id", "text", "act_code", "seq"))


def corpus_rollup(spark, sf_dir):
    return corpus.rollup(_chunks(spark, sf_dir, "act_code", "status", "ref_key_alt"), "act_code", "status", "ref_key_alt")


def corpus_unverified(spark, sf_dir):
    state = F.lower(F.trim(F.coalesce("verification_status", F.lit("unverified"))))
    rows = table(spark, sf_dir, "sources").select("doc_id", "doc_type", state.alias("state")).distinct()
    return rows.groupBy("doc_type").agg(F.count("*").alias("n"), F.count_if(F.col("state") != "verified").alias("unverified"))


def browse_page(spark, sf_dir):
    return corpus.browse(_chunks(spark, sf_dir, "doc_id", "seq", "ref_key", "status", "text"), {"status": "in_force"}, words="section [0-9]+", limit=40, offset=20).select("chunk_id", "doc_id", "seq", "ref_key")


def passage_slices(spark, sf_dir):
    return corpus.passages(table(spark, sf_dir, "sources")).distinct()


def passage_check(spark, sf_dir):
    """Chunks whose text is not the passage that the stored text has at their place."""
    stored = corpus.passages(table(spark, sf_dir, "sources")).select("chunk_id", F.md5("passage").alias("stored")).distinct()
    own = _chunks(spark, sf_dir, "text").select("chunk_id", F.md5("text").alias("own"))
    return own.join(stored, "chunk_id", "left").where("stored IS NULL OR own != stored").select("chunk_id", F.col("stored").isNull().alias("no_source"))


def chunk_offsets(spark, sf_dir):
    return corpus.offsets(_chunks(spark, sf_dir, "doc_id", "seq", "text").where("text IS NOT NULL")).select("chunk_id", "part_no", "start_at", "end_at")


def stale_offsets(spark, sf_dir):
    """Chunks whose stored offsets do not fit the length of their text."""
    rows = _chunks(spark, sf_dir, "char_start", "char_end", "text")
    return rows.where("char_start IS NULL OR char_end IS NULL OR char_end - char_start != length(text)").select("chunk_id", "char_start", "char_end", F.length("text").alias("n_chars"))


def long_provisions(spark, sf_dir):
    """The parts of all provisions that are longer than a chunk may be, each below its heading."""
    parts = corpus.provision_parts(_chunks(spark, sf_dir, "text", "heading")).where("n_parts > 1")
    return parts.select("chunk_id", "part_no", "n_parts", F.length("part").alias("n_chars"), F.md5("block").alias("block_hash"))


def chunk_carry(spark, sf_dir):
    rows = corpus.carried(_chunks(spark, sf_dir, "doc_id", "seq", "text").where("text IS NOT NULL")).select("chunk_id", "with_carry")
    return rows.select("chunk_id", F.md5("with_carry").alias("carry_hash"), F.length("with_carry").alias("n_chars"))


_META = (
    "doc_id", "seq", "act_code", "section_no", "subsection_no", "article_no", "ref_key", "ref_key_alt", "title_path", "heading", "status", "effective_from", "effective_to", "superseded_by",
    "struck_down_by", "para_no", "char_start", "char_end", "ingest_batch",
)


def _metadata(spark, sf_dir):
    return corpus.with_defaults(_chunks(spark, sf_dir, *_META), table(spark, sf_dir, "sources"))


def chunk_metadata(spark, sf_dir):
    rows = _metadata(spark, sf_dir)
    return rows.select("chunk_id", "doc_type", "status", "verification_status", corpus.source_label(rows).alias("label"))


def metadata_violations(spark, sf_dir):
    return corpus.violations(_metadata(spark, sf_dir))


def neighbour_read(spark, sf_dir):
    rows = _chunks(spark, sf_dir, "doc_id", "seq").select("chunk_id", "doc_id", "seq")
    return corpus.neighbours(rows, rows, 1)


def document_order(spark, sf_dir):
    """Titles of all stored documents and acts in the order of their id."""
    acts = table(spark, sf_dir, "acts").select("doc_id", "act_code", "title", F.size("names").alias("n_names"))
    stored = table(spark, sf_dir, "sources").groupBy("doc_id").agg(F.max("act_code").alias("own_code"), F.max("doc_title").alias("own_title"))
    rows = stored.join(acts, "doc_id", "full")
    return rows.select("doc_id", F.coalesce("act_code", "own_code").alias("act_code"), F.coalesce("title", "own_title").alias("title"), F.coalesce("n_names", F.lit(0)).alias("n_names")).orderBy("doc_id")


def source_list(spark, sf_dir):
    return corpus.source_list(table(spark, sf_dir, "sources"))


def web_ids(spark, sf_dir):
    """Ids of the stored pages that have an address."""
    rows = corpus.last_sources(table(spark, sf_dir, "sources"), "source_url").where("source_url != ''")
    return rows.select("doc_id", corpus.web_id(F.col("source_url")).alias("web_id"))


def point_read(spark, sf_dir):
    """The chunks that the stored documents name, by their ids."""
    ids = table(spark, sf_dir, "sources").select(F.explode("chunks.chunk_id").alias("chunk_id"))
    return corpus.by_ids(_chunks(spark, sf_dir, "doc_id", "seq"), ids, "chunk_id")


def deleted_documents(spark, sf_dir):
    """The chunks that stay when all documents of the web are deleted."""
    gone = corpus.last_sources(table(spark, sf_dir, "sources"), "doc_type").where("doc_type = 'web'")
    return corpus.without_ids(_chunks(spark, sf_dir, "doc_id"), gone, "doc_id").select("chunk_id", "doc_id")


def cited_sources(spark, sf_dir):
    """Whether the document that a quote names is stored."""
    rows = table(spark, sf_dir, "quotes").select("quote_id", "doc_id").distinct()
    return corpus.known_ids(rows, table(spark, sf_dir, "sources"), "doc_id").select("quote_id", "doc_id", "valid")


def ingest_totals(spark, sf_dir):
    return corpus.ingest_totals(table(spark, sf_dir, "chunks"), "ingest_batch")


def sign_off(spark, sf_dir):
    """Documents and passages by type and state of verification."""
    state = F.coalesce(F.nullif(F.lower(F.trim("verification_status")), F.lit("")), F.lit("unverified")).alias("state")
    rows = corpus.last_sources(table(spark, sf_dir, "sources"), "doc_type", "verification_status", "chunks").select("doc_type", state, F.size("chunks").alias("n"))
    return rows.groupBy("doc_type", "state").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chunks"))


def chunk_ids(spark, sf_dir):
    return corpus.made_ids(_chunks(spark, sf_dir, "doc_id", "seq")).select("chunk_id", "made_id")


def read_passages(spark, sf_dir):
    rows = _chunks(spark, sf_dir, "doc_id", "seq", "text").where("text IS NOT NULL")
    return corpus.read_passages(rows, rows).select("anchor_id", "n", F.md5("passage").alias("passage_hash"))


def distinct_acts(spark, sf_dir):
    """The acts of the documents with their counts, as one line. There are few acts."""
    rows = table(spark, sf_dir, "documents").where("act_code != ''").groupBy("act_code").agg(F.count("*").alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("act_code", "n"))), lambda x: F.concat_ws(":", x["act_code"], x["n"].cast("string"))), " ")
    return rows.agg(F.count("*").alias("n_acts"), line.alias("counts"))


# Filters


def filter_and_or(spark, sf_dir):
    spec = {"$and": [{"l_shipdate": {"$gte": "1999-01-01"}}, {"$or": [{"l_quantity": {"$lt": 5}}, {"l_discount": {"$gt": 0.08}}]}, {"l_returnflag": {"$in": ["A", "R"]}}]}
    return table(spark, sf_dir, "lineitem").where(where(spec)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")


def filter_not_in(spark, sf_dir):
    spec = all_of({"o_orderpriority": {"$nin": ["5-LOW", "1-URGENT"]}}, None, {"o_totalprice": {"$lte": 50000.0}}, {"o_orderstatus": {"$ne": "F"}})
    return table(spark, sf_dir, "orders").where(where(spec)).select("o_orderkey", "o_custkey", "o_totalprice")


def filter_contains(spark, sf_dir):
    spec = {"$and": [{"text": {"$contains": "shall"}}, {"text": {"$not_contains": "Rs "}}, {"source": {"$eq": "gazette"}}]}
    return table(spark, sf_dir, "documents").where(where(spec)).select("doc_id", "n_chars")


def keyword_regex(spark, sf_dir):
    return retrieve.keyword(_chunks(spark, sf_dir, "text"), "text", pattern=r"licen[cs]e[\s\S]{0,80}months").select("chunk_id")


def keyword_phrase(spark, sf_dir):
    return retrieve.keyword(table(spark, sf_dir, "documents"), "text", phrase="in good faith").select("doc_id")


def qualified_provisions(spark, sf_dir):
    """Provisions that narrow a rule, and those that speak of recent change."""
    rows = _chunks(spark, sf_dir, "text")
    return rows.select("chunk_id", F.col("text").rlike(text.QUALIFIER).alias("qualified"), F.col("text").rlike(text.RECENT).alias("recent")).where("qualified OR recent")


def qualifier_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(text.QUALIFIER_SEARCH)).select("doc_id")


def case_citations(spark, sf_dir):
    """The case citations in all documents."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({text.CASE_CITATION})"), 1))).alias("citation")
    return table(spark, sf_dir, "documents").select("doc_id", found)


# References


def _names(spark, sf_dir):
    return refs.act_names(table(spark, sf_dir, "acts"))


def ref_labels(spark, sf_dir):
    rows = _chunks(spark, sf_dir, "ref_key").where("ref_key IS NOT NULL AND ref_key != ''").select("ref_key").distinct()
    return rows.select("ref_key", refs.label(F.col("ref_key")).alias("label"), F.array_join(refs.parents(F.col("ref_key")), ",").alias("parents"))


def ref_roundtrip(spark, sf_dir):
    """Keys written out as references, parsed again; the act is named by its longest name."""
    acts = table(spark, sf_dir, "acts").select("act_code", F.element_at("names", 1).alias("name"))
    rows = _chunks(spark, sf_dir, "ref_key").where("ref_key != ''").select("ref_key").distinct().withColumn("act_code", F.regexp_extract("ref_key", "^([^:]+):", 1)).join(F.broadcast(acts), "act_code")
    unit = F.when(F.col("ref_key").rlike(":A"), "Article ").otherwise("Section ")
    written = F.concat(unit, F.regexp_replace("ref_key", "^[^:]+:[SA]", ""), F.lit(" of the "), F.initcap("name"))
    rows = rows.withColumn("written", written)
    return rows.select("ref_key", refs.ref_key(refs.parsed(F.col("written"), refs.act_code(F.col("written"), _names(spark, sf_dir)))).alias("parsed_key"))


def ref_mentions(spark, sf_dir):
    return refs.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "acts"), "act_code")


def claim_references(spark, sf_dir):
    """The provisions that each line of a document names, or where it names none, its document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "act_code")
    lines = docs.select("doc_id", "act_code", F.posexplode(F.split("text", "\\n+")).alias("n", "line")).select("doc_id", "act_code", F.concat_ws("#", "doc_id", "n").alias("line_id"), "line")
    return refs.claim_references(lines, "line_id", "line", "doc_id", docs, "text", table(spark, sf_dir, "acts"), about="act_code")


def _keys(spark, sf_dir):
    """All keys that chunks stand under, and both sides of all equivalences."""
    own = _chunks(spark, sf_dir, "ref_key", "ref_key_alt").select(F.explode(F.array("ref_key", "ref_key_alt")).alias("ref_key"))
    paired = table(spark, sf_dir, "equivalences").select(F.explode(F.array("a", "b")).alias("ref_key"))
    return own.unionByName(paired).where("ref_key != ''").distinct()


def alias_closure(spark, sf_dir):
    return refs.closure(_keys(spark, sf_dir), table(spark, sf_dir, "equivalences"))


def ref_lookup(spark, sf_dir):
    return retrieve.lookup(_keys(spark, sf_dir), _chunks(spark, sf_dir, "ref_key", "ref_key_alt"), table(spark, sf_dir, "equivalences"))


# Terms and retrieval


def idf_table(spark, sf_dir):
    return retrieve.idf(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("idf", F.round("idf", 6))


def distinctive_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = docs.where("text IS NOT NULL").count()
    out = retrieve.distinctive(table(spark, sf_dir, "eval_items"), "item_id", "text", retrieve.idf(docs, "doc_id", "text"), n)
    return out.withColumn("idf", F.round("idf", 6))


def content_tokens(spark, sf_dir):
    """The terms of all documents and held-out passages."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("key"), "text")
    items = table(spark, sf_dir, "eval_items").select(F.lit("eval_items").alias("tab"), F.col("item_id").alias("key"), "text")
    return docs.unionByName(items).select("tab", "key", F.explode(F.expr(text.content_tokens("text"))).alias("term")).distinct()


def numeric_tokens(spark, sf_dir):
    return _chunks(spark, sf_dir, "text").select("chunk_id", F.array_join(F.expr(text.numeric_tokens("text")), " ").alias("numbers"))


def ngram_overlap(spark, sf_dir):
    """Jaccard of the character 5-grams of each quote and its source."""
    rows = table(spark, sf_dir, "quotes").select("quote_id", "source", "quote").distinct()
    grams = F.explode(F.array(F.struct(F.expr(text.char_ngrams("source")).alias("a"), F.expr(text.char_ngrams("quote")).alias("b"))))
    return rows.select("quote_id", grams.alias("g")).select("quote_id", F.round(text.jaccard(F.col("g.a"), F.col("g.b")), 6).alias("similarity"))


def level1_hashes(spark, sf_dir):
    rows = table(spark, sf_dir, "quotes").select("quote_id", F.expr(text.level1("quote")).alias("f")).distinct()
    return rows.select("quote_id", F.sha1("f").alias("h1"), F.sha1(F.expr(text.level2("f"))).alias("h2"))


def hash_dedup(spark, sf_dir):
    return retrieve.same_text(_chunks(spark, sf_dir, "text"), "chunk_id", "text")


def query_fingerprints(spark, sf_dir):
    """Each different search once: tool and arguments by hash."""
    rows = table(spark, sf_dir, "events").select("event_type", "props", F.sha1(F.concat_ws(":", "event_type", "props")).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("event_type").alias("event_type"), F.min("props").alias("props"))


def dense_topk(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return retrieve.nearest(rows.where("vec_id % 20 = 0"), rows)


def dense_topk_filtered(spark, sf_dir):
    """Only vectors of the labels 0 to 2 are searched."""
    rows = _vectors(spark, sf_dir)
    return retrieve.nearest(rows.where("vec_id % 20 = 0"), rows.where(F.col("label").between(0, 2)), top=5)


def vector_norms(spark, sf_dir):
    doubled = F.transform("embedding", lambda x: x.cast("double") * 2)
    unit = retrieve.normalised_vector(doubled)
    return _vectors(spark, sf_dir).select("vec_id", F.round(retrieve.dot(unit, unit), 6).alias("norm"), F.round(unit[0], 6).alias("first"))


def _hits(spark, sf_dir):
    """Hits of four routes for each query document: vectors, the act of the query, a phrase, and the documents beside those that vectors find."""
    phrase = F.coalesce(F.col("text").contains("in good faith"), F.lit(False)).alias("has_phrase")
    docs = table(spark, sf_dir, "documents").select("doc_id", "act_code", phrase)
    dense = cut(dense_topk(spark, sf_dir).select("query_id", F.col("vec_id").alias("doc_id"), "similarity"))
    queries = _vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    return retrieve.hits_of_routes(dense, docs, queries)


def fusion_pool(spark, sf_dir):
    return retrieve.fuse(_hits(spark, sf_dir), key="doc_id")


def term_coverage(spark, sf_dir):
    """How much of each quote's terms its source holds."""
    rows = table(spark, sf_dir, "quotes").select("quote_id", "source", "quote").distinct()
    return retrieve.coverage(rows, rows.select("quote_id", "source"), "quote_id", "quote", "source")


def _merged(spark, sf_dir):
    return retrieve.merged(fusion_pool(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text"), key="doc_id")


def pool_merged(spark, sf_dir):
    """The pool without copies and near-duplicates."""
    return _merged(spark, sf_dir).withColumn("duplicates", F.array_join(F.col("duplicates").cast("array<string>"), ","))


def pool_duplicates(spark, sf_dir):
    """Which candidate stands for which others."""
    return _merged(spark, sf_dir).select("query_id", "doc_id", F.explode("duplicates").alias("duplicate"))


def pool_summary(spark, sf_dir):
    return retrieve.pool_summary(fusion_pool(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "act_code"))


def pool_trace(spark, sf_dir):
    """The first twelve candidates of each query with the parts of their score."""
    part = lambda c, w: F.round(F.col(c).cast("double") * retrieve.WEIGHTS[w], 4)
    rows = fusion_pool(spark, sf_dir).where("rank <= 12")
    return rows.select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"), part("dense", "dense").alias("of_dense"), part("ref_hit", "ref").alias("of_ref"), part("exact_hit", "exact").alias("of_exact"), "routes")


def uncovered_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "quotes").select("quote_id", "source", "quote").distinct()
    return retrieve.uncovered(rows, "quote_id", "quote", "source")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion_pool(spark, sf_dir)


# Quotes


def quote_tiers(spark, sf_dir):
    """Quotes that stand in their source as they are or but for punctuation."""
    return quotes.tiered(table(spark, sf_dir, "quotes")).where("tier != 'none'").select("quote_id", "tier")


def quotes_elsewhere(spark, sf_dir):
    """Quotes that do not stand in their source but in a stored passage."""
    lost = quotes.tiered(table(spark, sf_dir, "quotes")).where("tier = 'none'").select("quote_id", "quote")
    return quotes.elsewhere(lost, _chunks(spark, sf_dir, "text"))


def quote_places(spark, sf_dir):
    """Where each quote stands in its source, told in characters of the source as it is written."""
    rows = table(spark, sf_dir, "quotes")
    return quotes.in_source(rows, quotes.matched(rows)).select("quote_id", "tier", "start", "end", F.md5("shown").alias("shown_hash"))


def quote_check(spark, sf_dir):
    rows = table(spark, sf_dir, "quotes")
    matches = kept(quotes.matched(rows))
    others = quotes.elsewhere(rows.join(matches.where("tier = 'none'"), "quote_id", "left_semi"), _chunks(spark, sf_dir, "text"))
    out = quotes.guarded(rows, matches, others=others)
    return out.withColumn("guards", F.array_join("guards", ","))


def quote_guards(spark, sf_dir):
    """Differences in numbers and negations between quote and source."""
    rows = quotes.levels(table(spark, sf_dir, "quotes").dropDuplicates(["quote_id"]))
    same = F.expr(text.numeric_tokens("q1")) == F.expr(text.numeric_tokens("s1"))
    return rows.select("quote_id", same.alias("same_numbers"), F.expr(text.negation_count("q2")).alias("quote_negations"), F.expr(text.negation_count("s2")).alias("source_negations"))


def _checked(spark, sf_dir):
    rows = table(spark, sf_dir, "quotes")
    out = quotes.guarded(rows, quotes.matched(rows)).join(rows.select("quote_id", "genuine").dropDuplicates(["quote_id"]), "quote_id")
    return out.withColumn("blocked", F.array_contains("guards", "number_mismatch") | F.array_contains("guards", "quote_too_short"))


def threshold_sweep(spark, sf_dir):
    return quotes.sweep(_checked(spark, sf_dir), blocked="blocked")


def guard_contribution(spark, sf_dir):
    """Quotes that are not genuine, similar enough, and only refused by a guard."""
    return _checked(spark, sf_dir).where("NOT genuine AND similarity >= 0.95 AND blocked").select("quote_id", "similarity", F.array_join("guards", ",").alias("guards"))


def ngram_sweep(spark, sf_dir):
    """The sweep over n-gram similarity."""
    rows = ngram_overlap(spark, sf_dir).join(table(spark, sf_dir, "quotes").select("quote_id", "genuine").distinct(), "quote_id")
    return quotes.sweep(rows)


def source_cover(spark, sf_dir):
    """The part of each stored text that its chunks cover."""
    rows = table(spark, sf_dir, "sources").select("doc_id", F.length("text").alias("size"), F.explode("chunks").alias("c")).distinct()
    rows = rows.select("doc_id", "size", F.col("c.char_start").alias("s"), F.col("c.char_end").alias("e"))
    return quotes.covered_share(rows, "doc_id", "s", "e", "size")


def evidence_packet(spark, sf_dir):
    """The ranked evidence of each query as one text of numbered blocks. Documents have no status of their own."""
    acts = table(spark, sf_dir, "acts").select("act_code", "title")
    docs = table(spark, sf_dir, "documents").select("doc_id", "act_code", "text", "doc_kind", "source").join(F.broadcast(acts), "act_code", "left")
    rows = fusion_pool(spark, sf_dir).where("rank <= 6").select("query_id", "doc_id", "rank").join(docs, "doc_id", "left")
    label = F.concat_ws(" — ", *[F.nullif(c, F.lit("")) for c in (F.coalesce("title", "source"), F.col("doc_kind"))])
    block = retrieve.evidence_block(F.col("rank"), label, F.lit(None).cast("string"), F.col("text"))
    blocks = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    return blocks.select("query_id", F.array_join(F.transform("blocks", lambda x: x["block"]), "\n\n").alias("packet"))


def quote_cut(spark, sf_dir):
    """How much of each quote is checked."""
    rows = table(spark, sf_dir, "quotes").where("quote IS NOT NULL").select("quote_id", "quote").distinct()
    return rows.select("quote_id", F.md5(F.left("quote", F.lit(text.MOST_QUOTE_CHARS))).alias("cut_hash"), (F.length("quote") > text.MOST_QUOTE_CHARS).alias("truncated"))


# Events


def request_metrics(spark, sf_dir):
    return metrics.totals(_events(spark, sf_dir))


def request_percentiles(spark, sf_dir):
    return metrics.percentiles(_events(spark, sf_dir))


def request_percentiles_by_type(spark, sf_dir):
    return metrics.percentiles(_events(spark, sf_dir), "event_type")


def request_by_type(spark, sf_dir):
    return metrics.by_group(_events(spark, sf_dir), "event_type")


def request_by_class(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("class", F.concat(F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("string"), F.lit("x")))
    return rows.groupBy("class").agg(F.count("*").alias("n"))


def ring_last_n(spark, sf_dir):
    return metrics.last_n(_events(spark, sf_dir), 500).select("event_id", "event_type", "value")


def ring_last_n_by_user(spark, sf_dir):
    return metrics.last_n(_events(spark, sf_dir), 3, "user_id").select("user_id", "age", "event_id")


def window_recent(spark, sf_dir):
    return metrics.totals(metrics.recent(_events(spark, sf_dir), 24 * 60, "2024-01-15 00:00:00"))


def events_since(spark, sf_dir):
    return metrics.since(_events(spark, sf_dir), 5000, "cl", 200).select("event_id", "event_type", "user_id")


def event_numbers(spark, sf_dir):
    return metrics.numbered(_events(spark, sf_dir)).select("event_id", "user_id", "seq")


def user_state(spark, sf_dir):
    return metrics.latest(_events(spark, sf_dir)).select("user_id", "last_type", "last_event", "n")


def top_types(spark, sf_dir):
    return metrics.most_frequent(_events(spark, sf_dir), "event_type")


def reached_types(spark, sf_dir):
    return metrics.reached(_events(spark, sf_dir))


def requests_of_class(spark, sf_dir):
    return metrics.of_class(_events(spark, sf_dir), F.get_json_object("props", "$.k").cast("int"), 3, "CL").select("event_id", "event_type", "user_id")


def failed_users(spark, sf_dir):
    return metrics.in_state(metrics.latest(_events(spark, sf_dir)), "error").select("user_id", "last_event", "n")


def expired_users(spark, sf_dir):
    return metrics.expired(metrics.latest(_events(spark, sf_dir)), 60, "2024-01-30 00:00:00").select("user_id", "last_event")


def hourly_windows(spark, sf_dir):
    return metrics.per_window(_events(spark, sf_dir))


def user_sessions(spark, sf_dir):
    return metrics.sessions(_events(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def capped_details(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", metrics.capped(F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","props":'), F.col("props"), F.lit("}")), 34).alias("detail"))


def redacted_details(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", metrics.redacted(F.create_map(F.lit("Token"), F.col("props"), F.lit("type"), F.col("event_type")), most=4).alias("m"))
    return rows.select("event_id", F.col("m")["Token"].alias("token"), F.col("m")["type"].alias("type"))


def run_log_roundtrip(spark, sf_dir):
    """Runs of each user written to the log by day and listed again."""
    folder = f"{shared_dir(spark)}/runs-{uuid4().hex}"
    state = metrics.latest(_events(spark, sf_dir))
    runs = state.select(F.col("user_id").cast("string").alias("id"), F.date_format("last_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("recordedAt"), F.col("last_type").alias("status"), F.struct(F.concat(F.lit("last event "), F.col("last_event").cast("string")).alias("text")).alias("input"))
    files.append_runs(runs, folder)
    return files.list_runs(spark, folder, 100).select("id", "recordedAt", "status", "preview", "events")


def stream_windows(spark, sf_dir):
    """The hourly windows kept up by a stream, open ones among them: all come out with each step, so none is ever dropped."""
    out = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    rows = streams.drained(streams.windowed(streams.event_stream(spark, sf_dir)), out, "complete")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).select("window_start", "event_type", "n", "errors", "total")


def stream_closed_windows(spark, sf_dir):
    """The hourly windows that the watermark has closed, each written once; their state is gone."""
    out = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    return streams.drained(streams.windowed(streams.event_stream(spark, sf_dir)), out).select("window_start", "event_type", "n", "errors", "total")


def stream_dedup(spark, sf_dir):
    """Events that are delivered twice come out once."""
    out = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    twice = streams.event_stream(spark, sf_dir).unionByName(streams.event_stream(spark, sf_dir))
    rows = streams.drained(streams.deduplicated(twice), out)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


def stream_user_state(spark, sf_dir):
    out = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    rows = streams.drained(streams.keyed_state(streams.event_stream(spark, sf_dir)), out, "update")
    return rows.groupBy("user_id").agg(F.max_by("last_type", "n").alias("last_type"), F.max_by("last_event", "n").alias("last_event"), F.max("n").alias("n"))


def stream_expired_users(spark, sf_dir):
    """Users whose state the stream has dropped, a day after their last event."""
    out = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    rows = streams.drained(streams.keyed_state(streams.event_stream(spark, sf_dir), 24 * 60), out, "update")
    return rows.where("expired").select("user_id", "n", "last_event", "last_type")


_PLAIN = [
    corpus_documents, corpus_rollup, corpus_unverified, browse_page, passage_slices, passage_check, chunk_offsets, stale_offsets, chunk_carry, chunk_metadata,
    metadata_violations, neighbour_read, document_order, filter_and_or, filter_not_in, filter_contains, keyword_regex, keyword_phrase, qualified_provisions, ref_labels,
    ref_roundtrip, ref_mentions, alias_closure, ref_lookup, idf_table, distinctive_terms, content_tokens, numeric_tokens, ngram_overlap, level1_hashes, hash_dedup,
    query_fingerprints, dense_topk, dense_topk_filtered, vector_norms, fusion_pool, term_coverage, quote_tiers, quote_check, quote_guards, threshold_sweep,
    guard_contribution, ngram_sweep, source_cover, evidence_packet, request_metrics, request_percentiles, request_percentiles_by_type, request_by_type,
    request_by_class, ring_last_n, ring_last_n_by_user, window_recent, events_since, event_numbers, user_state, expired_users, hourly_windows, user_sessions,
    capped_details, redacted_details, run_log_roundtrip, stream_windows, stream_closed_windows, stream_dedup, stream_user_state, source_list, web_ids, point_read, deleted_documents, cited_sources, ingest_totals, sign_off, chunk_ids,
    read_passages, distinct_acts, qualifier_search, case_citations, pool_merged, pool_duplicates, pool_summary, pool_trace, uncovered_terms, quote_cut, top_types, reached_types, requests_of_class, failed_users,
    stream_expired_users, long_provisions, quotes_elsewhere, quote_places, claim_references,
]


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_versions, *_PLAIN)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
