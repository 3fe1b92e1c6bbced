"""SQL that the queries of the core are checked against, for DuckDB."""

from __future__ import annotations

from attesta.functions import text
from attesta.operators import corpus
from attesta.operators.quotes import LEAST_CHARS, THRESHOLDS

_DATE = """CASE WHEN regexp_matches({c}, '^\\d{{4}}-') THEN {c} WHEN regexp_matches({c}, '^\\d{{4}}/') THEN replace({c}, '/', '-')
 WHEN regexp_matches({c}, '^\\d{{8}}$') THEN strftime(strptime({c}, '%Y%m%d'), '%Y-%m-%d') WHEN regexp_matches({c}, '^\\d+-\\d+-\\d{{4}}$') THEN strftime(strptime({c}, '%d-%m-%Y'), '%Y-%m-%d')
 WHEN regexp_matches({c}, '^\\d+\\.') THEN strftime(strptime({c}, '%d.%m.%Y'), '%Y-%m-%d') ELSE coalesce(strftime(try_strptime({c}, '%d %B %Y'), '%Y-%m-%d'), strftime(try_strptime({c}, '%d %b %Y'), '%Y-%m-%d'), lower({c})) END"""
_VALUES = {
    "status": "regexp_replace(lower(trim(status)), '[ _-]+', '_', 'g')",
    "effective_from": _DATE.format(c="trim(effective_from)"),
    "effective_to": _DATE.format(c="trim(effective_to)"),
    "struck_down_by": "lower(trim(regexp_replace(struck_down_by, '\\s+', ' ', 'g')))",
}
_VERSIONS = (
    "WITH one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ref_key, recorded_at ORDER BY update_id DESC, arrived_at DESC) AS rn FROM status_updates), told AS (SELECT doc_id, ref_key, recorded_at, "
    + ", ".join(f"CASE WHEN row_kind = 'update' AND {c} IS NULL THEN NULL WHEN {c} IS NULL OR trim({c}) IN ('', '-') THEN '' ELSE {v} END AS {c}" for c, v in _VALUES.items())
    + " FROM one WHERE rn = 1), st AS (SELECT doc_id, ref_key, recorded_at, "
    + ", ".join(f"nullif(last_value({c} IGNORE NULLS) OVER w, '') AS {c}" for c in _VALUES)
    + " FROM told WINDOW w AS (PARTITION BY doc_id, ref_key ORDER BY recorded_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), ch AS (SELECT *, lag(recorded_at) OVER o AS was, "
    + ", ".join(f"lag({c}) OVER o AS l_{c}" for c in _VALUES)
    + " FROM st WINDOW o AS (PARTITION BY doc_id, ref_key ORDER BY recorded_at)), v AS (SELECT * FROM ch WHERE was IS NULL OR "
    + " OR ".join(f"{c} IS DISTINCT FROM l_{c}" for c in _VALUES)
    + ") "
)



_CHUNKS = "ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC, ingest_batch DESC) AS delivery FROM chunks) WHERE delivery = 1)"
_STATUS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY try_cast(ingested_at AS TIMESTAMPTZ) DESC NULLS LAST) AS delivery FROM sources) WHERE delivery = 1)"
_META = (
    _CHUNKS
    + ", md AS (SELECT chunk_id, coalesce(doc_title, '') AS doc_title, coalesce(source_url, '') AS source_url, c.char_start AS char_start, c.char_end AS char_end, "
    + ", ".join(f"coalesce(c.{x}, '') AS {x}" for x in ("ref_key", "section_no", "subsection_no", "article_no", "heading", "effective_from", "effective_to", "para_no"))
    + ", "
    + ", ".join(f"coalesce(nullif(lower(trim({t})), ''), '{d}') AS {n}" for t, n, d in (("doc_type", "doc_type", "act"), ("d.verification_status", "verification_status", "unverified"), ("c.status", "status", "in_force")))
    + f" FROM ch c LEFT JOIN {_STATUS} d USING (doc_id))"
)
_UNIT = "CASE WHEN article_no <> '' THEN 'Article ' || article_no || CASE WHEN subsection_no <> '' THEN '(' || subsection_no || ')' ELSE '' END WHEN section_no <> '' THEN 'Section ' || section_no || CASE WHEN subsection_no <> '' THEN '(' || subsection_no || ')' ELSE '' END WHEN para_no <> '' THEN 'Para ' || para_no END"


def _tokens(column: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+'), lambda x: x <> '')"


def _stem(word: str) -> str:
    cases = " ".join(f"WHEN {word} LIKE '%{e}' AND length({word}) >= {len(e) + 4} THEN left({word}, length({word}) - {len(e)})" for e in text.ENDINGS)
    return f"CASE WHEN length({word}) <= 4 THEN {word} {cases} ELSE {word} END"


def _terms(table: str, key: str, column: str) -> str:
    """(key, pos, term): content tokens with the place of their first occurrence."""
    stop = ", ".join(f"'{w}'" for w in text.STOPWORDS)
    each = f"SELECT {key}, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS w FROM (SELECT {key}, {_tokens(column)} AS t FROM {table} WHERE {column} IS NOT NULL)"
    return f"(SELECT {key}, term, min(pos) AS pos FROM (SELECT {key}, pos, {_stem('w')} AS term FROM ({each}) WHERE length(w) >= 3 AND w NOT IN ({stop})) GROUP BY {key}, term)"


def _numbers(column: str) -> str:
    names = "MAP {" + ", ".join(f"'{w}': '{n}'" for w, n in text.NUMBER_WORDS.items()) + "}"
    value = rf"CASE WHEN regexp_matches(t, '^[0-9]+$') THEN CASE WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END ELSE {names}[t] END"
    return f"list_sort(list_filter(list_transform({_tokens(column)}, lambda t: {value}), lambda n: n IS NOT NULL))"


def _level1(column: str) -> str:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
    s = f"translate({column}, '{wide}{text.SINGLE}{text.DOUBLE}{text.DASHES}०१२३४५६७८९{text.DROPPED}', '{narrow}{chr(39) * 10}{chr(34) * 5}{'-' * 7}0123456789')"
    s = rf"lower(regexp_replace(replace(replace({s}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '-[ \t]*\n[ \t]*', '', 'g'))"
    for pattern, value in text.SPELLINGS:
        if "(?=" in pattern:
            s = rf"regexp_replace({s}, '\bs\.\s*(\d)', 'section \1', 'g')"
        else:
            s = f"regexp_replace({s}, '{pattern}', '{value}', 'g')"
    for _ in range(2):
        s = rf"regexp_replace({s}, '([0-9]),([0-9])', '\1\2', 'g')"
    return rf"trim(regexp_replace({s}, '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+', ' ', 'g'))"


def _level2(folded: str) -> str:
    return rf"trim(regexp_replace({folded}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _grams(column: str) -> str:
    s = rf"trim(regexp_replace(lower({column}), '\s+', ' ', 'g'))"
    return f"list_distinct(list_transform(range(1, greatest(length({s}) - 3, 1)), lambda i: substring({s}, i, 5)))"


_UNIQUE = "(SELECT quote_id, any_value(source) AS source, any_value(quote) AS quote, any_value(genuine) AS genuine FROM quotes GROUP BY quote_id)"
_SIMILAR = f"(SELECT quote_id, genuine, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS similarity FROM (SELECT quote_id, genuine, {_grams('source')} AS a, {_grams('quote')} AS b FROM {_UNIQUE}))"
_QUOTE_LEVELS = f"(SELECT quote_id, s1, q1, {_level2('s1')} AS s2, {_level2('q1')} AS q2 FROM (SELECT quote_id, {_level1('source')} AS s1, {_level1('quote')} AS q1 FROM {_UNIQUE}))"
_DENSE = "SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0, least(1, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS similarity FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0"


def _top(rows: str, k: int) -> str:
    return f"SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM ({rows})) WHERE rank <= {k}"


# Sentences of long provisions, packed one after the other; then cut where one alone is too long.
_PARTS = rf"""WITH RECURSIVE {_CHUNKS}, tx AS (SELECT chunk_id, coalesce(heading, '') AS heading, regexp_replace(text, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g') AS t FROM ch WHERE text IS NOT NULL),
 se AS (SELECT chunk_id, string_split(regexp_replace(t, '([.;:—])\s+([A-Z(0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM tx WHERE length(t) > 1200),
 pk AS (SELECT chunk_id, s, 2 AS i, s[1] AS buf, []::VARCHAR[] AS done FROM se UNION ALL
  SELECT chunk_id, s, i + 1, CASE WHEN length(buf) + 1 + length(s[i]) > 1200 THEN s[i] ELSE buf || ' ' || s[i] END, CASE WHEN length(buf) + 1 + length(s[i]) > 1200 THEN list_append(done, buf) ELSE done END FROM pk WHERE i <= len(s)),
 pa AS (SELECT chunk_id, unnest(range(1, len(done) + 2)) AS k, unnest(list_append(done, buf)) AS p FROM pk WHERE i = len(s) + 1),
 cu AS (SELECT chunk_id, k, p, unnest(range(0, (length(p) - 1) // 1200 + 1)) AS c FROM pa),
 nu AS (SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY k, c) - 1 AS part_no, count(*) OVER (PARTITION BY chunk_id) AS n_parts, substring(p, c * 1200 + 1, 1200) AS part FROM cu),
 bl AS (SELECT chunk_id, part_no, n_parts, part, trim(heading || CASE WHEN part_no > 0 THEN ' (continued ' || (part_no + 1) || ')' ELSE '' END) AS line FROM nu JOIN tx USING (chunk_id))
 SELECT chunk_id, part_no, n_parts, length(part) AS n_chars, md5(CASE WHEN line <> '' THEN line || chr(10) || part ELSE part END) AS block_hash FROM bl WHERE n_parts > 1"""
_PAIRS = "pr AS (SELECT a, b FROM equivalences UNION SELECT b, a FROM equivalences)"
_KEYS = "SELECT ref_key FROM ch UNION SELECT ref_key_alt FROM ch UNION SELECT a FROM equivalences UNION SELECT b FROM equivalences"
_CLOSURE = f"{_CHUNKS}, {_PAIRS}, st AS (SELECT ref_key FROM ({_KEYS}) WHERE ref_key <> ''), " + r"""cl AS (SELECT ref_key, ref_key AS alias FROM st UNION SELECT ref_key, regexp_replace(ref_key, '\(\w+\)$', '') FROM st
 UNION SELECT ref_key, regexp_replace(regexp_replace(ref_key, '\(\w+\)$', ''), '\(\w+\)$', '') FROM st UNION SELECT cl.ref_key, pr.b FROM cl JOIN pr ON cl.alias = pr.a)"""
_FUSED = (
    "dn AS (SELECT query_id, vec_id AS doc_id, similarity FROM ("
    + _top(_DENSE, 8)
    + ")), qs AS (SELECT vec_id AS query_id, d.act_code AS asked FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id WHERE vec_id % 20 = 0), "
    "bs AS (SELECT DISTINCT query_id, d.doc_id FROM dn JOIN documents d ON d.doc_id = dn.doc_id - 1 OR d.doc_id = dn.doc_id + 1 WHERE d.doc_id <> query_id), "
    "rf AS (SELECT query_id, doc_id FROM qs JOIN documents ON act_code = asked WHERE doc_id <> query_id), "
    "ex AS (SELECT query_id, doc_id FROM qs, documents WHERE contains(text, 'in good faith') AND doc_id <> query_id), "
    "hits AS (SELECT query_id, doc_id, 'dense' AS route, similarity AS dense FROM dn UNION ALL SELECT query_id, doc_id, 'neighbour', 0 FROM bs UNION ALL SELECT query_id, doc_id, 'ref', 0 FROM rf UNION ALL SELECT query_id, doc_id, 'exact', 0 FROM ex), "
    "one AS (SELECT query_id, doc_id, max(dense) AS dense, bool_or(route = 'ref') AS ref_hit, bool_or(route = 'exact') AS exact_hit, false AS is_web, bool_and(route = 'neighbour') AS is_neighbour, string_agg(route, ',' ORDER BY route) AS routes FROM hits GROUP BY ALL), "
    "sc AS (SELECT *, round(greatest(0, least(1, 0.5::DOUBLE * dense + 0.3::DOUBLE * ref_hit::INT + 0.2::DOUBLE * exact_hit::INT - 0.05::DOUBLE * is_neighbour::INT)), 7) AS score FROM one), "
    "fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc)"
)
_TOTALS = "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(*) FILTER (event_type = 'error') / count(*), 6) END AS error_rate, round(coalesce(avg(value), 0), 2) AS avg_value, round(coalesce(max(value), 0), 2) AS max_value FROM events"
_LATEST = "(SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(event_id, (ts, event_id)) AS last_event, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY user_id)"
_HOURS = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


# Copies by hash of their letters and digits, then near-duplicates. A chain, in which one that is merged itself is the best for another, is not told apart here.
_MERGED = (
    _FUSED
    + f", sq AS MATERIALIZED (SELECT doc_id, sha1({_level2('f1')}) AS hash, s FROM (SELECT doc_id, {_level1('text')} AS f1, "
    + r"trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS s FROM documents WHERE doc_id IN (SELECT doc_id FROM fused WHERE rank <= 40))), "
    "pl AS MATERIALIZED (SELECT fused.*, hash, list_distinct(list_transform(range(1, greatest(length(s) - 3, 1)), lambda i: substring(s, i, 5))) AS g FROM fused LEFT JOIN sq USING (doc_id) WHERE rank <= 40), "
    "tw AS (SELECT *, coalesce(CASE WHEN hash IS NOT NULL THEN min(rank) OVER (PARTITION BY query_id, hash) END, rank) AS twin FROM pl), "
    "gr AS (SELECT query_id, rank, len(g) AS size, unnest(g) AS gram FROM tw WHERE rank = twin), "
    "mt AS (SELECT a.query_id, a.rank AS lead, b.rank AS twin, any_value(a.size) AS x, any_value(b.size) AS y, count(*) AS met FROM gr a JOIN gr b ON a.query_id = b.query_id AND a.gram = b.gram AND a.rank < b.rank GROUP BY 1, 2, 3), "
    "nr AS (SELECT query_id, twin, min(lead) AS lead FROM mt WHERE met >= 0.9::DOUBLE * (x + y - met) "
    "GROUP BY 1, 2), "
    "ld AS (SELECT tw.*, coalesce(nr.lead, twin) AS lead FROM tw LEFT JOIN nr USING (query_id, twin)), "
    "rt AS (SELECT query_id, lead, string_agg(DISTINCT r, ',' ORDER BY r) AS routes FROM (SELECT query_id, lead, unnest(string_split(routes, ',')) AS r FROM ld) GROUP BY 1, 2), "
    "mg AS (SELECT query_id, lead, arg_min(doc_id, rank) AS doc_id, max(dense) AS dense, bool_or(ref_hit) AS ref_hit, bool_or(exact_hit) AS exact_hit, false AS is_web, arg_min(is_neighbour, rank) AS is_neighbour, coalesce(string_agg(doc_id, ',' ORDER BY doc_id) FILTER (rank <> lead), '') AS duplicates FROM ld GROUP BY 1, 2), "
    "ms AS (SELECT mg.* EXCLUDE (lead), routes, round(greatest(0, least(1, 0.5::DOUBLE * dense + 0.3::DOUBLE * ref_hit::INT + 0.2::DOUBLE * exact_hit::INT - 0.05::DOUBLE * is_neighbour::INT)), 7) AS score FROM mg JOIN rt USING (query_id, lead))"
)


def _discrete(by: str = "") -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"SELECT {head}" + ", ".join(f"round(quantile_disc(value, {p / 100}), 2) AS p{p}" for p in (50, 95, 99)) + " FROM events" + tail


def oracle_sql() -> dict[str, str]:
    at = "strftime(recorded_at, '%Y-%m-%d %H:%M:%S')"
    after = f"lead({at}) OVER (PARTITION BY doc_id, ref_key ORDER BY recorded_at)"
    docs = "(SELECT count(*) FROM documents WHERE text IS NOT NULL)"
    weights = f"(SELECT term, count(*) AS df, ln(({docs} + 1.0) / (count(*) + 1)) + 1 AS idf FROM {_terms('documents', 'doc_id', 'text')} GROUP BY term)"
    count = lambda c: f"count(*) FILTER ({c})"
    thresholds = ", ".join(f"({t})" for t in THRESHOLDS)
    negations = "len(list_filter(string_split({}, ' '), lambda w: w IN (" + ", ".join(f"'{w}'" for w in text.NEGATIONS) + ")))"
    statuses = ", ".join(f"'{x}'" for x in corpus.STATUSES)
    quoted = _level2(_level1("source"))
    return {
        "p2_found": _VERSIONS + f"SELECT doc_id, ref_key, {at} AS valid_from FROM v",
        "p2_versions": _VERSIONS + f"SELECT doc_id, ref_key, CAST(row_number() OVER (PARTITION BY doc_id, ref_key ORDER BY recorded_at) AS INTEGER) AS version, {', '.join(_VALUES)}, {at} AS valid_from, {after} AS valid_to, {after} IS NULL AS is_current FROM v",
        "corpus_documents": f"WITH {_CHUNKS} SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(act_code) AS act_code, max(seq) AS last_seq FROM ch GROUP BY doc_id",
        "corpus_rollup": f"WITH {_CHUNKS} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce(nullif({d}, ''), '—') AS value, count(*) AS n FROM ch GROUP BY 2" for d in ("act_code", "status", "ref_key_alt")),
        "corpus_unverified": "SELECT doc_type, count(*) AS n, count(*) FILTER (state <> 'verified') AS unverified FROM (SELECT DISTINCT doc_id, doc_type, lower(trim(coalesce(verification_status, 'unverified'))) AS state FROM sources) GROUP BY doc_type",
        "browse_page": f"WITH {_CHUNKS} SELECT chunk_id, doc_id, seq, ref_key FROM ch WHERE status = 'in_force' AND regexp_matches(text, '(?i)section [0-9]+') ORDER BY chunk_id LIMIT 40 OFFSET 20",
        "passage_slices": "SELECT DISTINCT doc_id, c.chunk_id, c.seq, substring(text, c.char_start + 1, c.char_end - c.char_start) AS passage FROM (SELECT doc_id, text, unnest(chunks) AS c FROM sources)",
        "passage_check": f"WITH {_CHUNKS}, st AS (SELECT DISTINCT c.chunk_id AS chunk_id, substring(text, c.char_start + 1, c.char_end - c.char_start) AS passage FROM (SELECT text, unnest(chunks) AS c FROM sources)) SELECT chunk_id, passage IS NULL AS no_source FROM ch LEFT JOIN st USING (chunk_id) WHERE passage IS NULL OR passage <> text",
        "chunk_offsets": f"WITH {_CHUNKS} SELECT chunk_id, CAST(row_number() OVER w - 1 AS INTEGER) AS part_no, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_at, CAST(sum(length(text) + 2) OVER w - 2 AS INTEGER) AS end_at FROM ch WHERE text IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY seq)",
        "stale_offsets": f"WITH {_CHUNKS} SELECT chunk_id, char_start, char_end, CAST(length(text) AS INTEGER) AS n_chars FROM ch WHERE char_start IS NULL OR char_end IS NULL OR char_end - char_start <> length(text)",
        "chunk_carry": f"WITH {_CHUNKS}, ca AS (SELECT chunk_id, CASE WHEN lag(text) OVER w IS NULL THEN text ELSE '…' || right(lag(text) OVER w, 150) || ' ' || text END AS t FROM ch WHERE text IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) SELECT chunk_id, md5(t) AS carry_hash, CAST(length(t) AS INTEGER) AS n_chars FROM ca",
        "chunk_metadata": f"WITH {_META} SELECT chunk_id, doc_type, status, verification_status, CASE doc_type WHEN 'judgment' THEN concat_ws(' — ', nullif(doc_title, ''), 'para ' || nullif(para_no, '')) WHEN 'web' THEN coalesce(nullif(doc_title, ''), source_url) ELSE concat_ws(' — ', nullif(doc_title, ''), {_UNIT}, nullif(heading, '')) END AS label FROM md",
        "metadata_violations": f"WITH {_META} SELECT chunk_id, 'status' AS problem FROM md WHERE status NOT IN ({statuses}) UNION ALL SELECT chunk_id, 'doc_type' FROM md WHERE doc_type NOT IN ('act', 'constitution', 'judgment', 'rule', 'web') UNION ALL SELECT chunk_id, 'verification' FROM md WHERE verification_status NOT IN ('unverified', 'verified', 'disputed') UNION ALL SELECT chunk_id, 'no_offset' FROM md WHERE char_start IS NULL OR char_end IS NULL UNION ALL SELECT chunk_id, 'no_key' FROM md WHERE ref_key = '' AND para_no = '' UNION ALL SELECT chunk_id, 'no_title' FROM md WHERE doc_title = '' UNION ALL SELECT chunk_id, 'dates' FROM md WHERE effective_to <> '' AND effective_from <> '' AND effective_to < effective_from",
        "neighbour_read": f"WITH {_CHUNKS} SELECT a.chunk_id AS anchor_id, c.chunk_id, c.seq, c.seq = a.seq AS is_anchor FROM ch a JOIN ch c ON c.doc_id = a.doc_id AND c.seq BETWEEN a.seq - 1 AND a.seq + 1",
        "document_order": "SELECT doc_id, coalesce(a.act_code, s.code) AS act_code, coalesce(a.title, s.title) AS title, CAST(coalesce(len(names), 0) AS INTEGER) AS n_names FROM (SELECT doc_id, max(act_code) AS code, max(doc_title) AS title FROM sources GROUP BY doc_id) s FULL JOIN acts a USING (doc_id) ORDER BY doc_id",
        "filter_and_or": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND (l_quantity < 5 OR l_discount > 0.08::DOUBLE) AND l_returnflag IN ('A', 'R')",
        "filter_not_in": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '1-URGENT') AND o_totalprice <= 50000 AND o_orderstatus <> 'F'",
        "filter_contains": "SELECT doc_id, n_chars FROM documents WHERE contains(text, 'shall') AND NOT contains(text, 'Rs ') AND source = 'gazette'",
        "keyword_regex": rf"WITH {_CHUNKS} SELECT chunk_id FROM ch WHERE regexp_matches(text, '(?i)licen[cs]e[\s\S]{{0,80}}months')",
        "keyword_phrase": "SELECT doc_id FROM documents WHERE contains(text, 'in good faith')",
        "qualified_provisions": f"WITH {_CHUNKS} SELECT * FROM (SELECT chunk_id, regexp_matches(text, '{text.QUALIFIER}') AS qualified, regexp_matches(text, '{text.RECENT}') AS recent FROM ch) WHERE qualified OR recent",
        "ref_labels": rf"WITH {_CHUNKS} SELECT DISTINCT ref_key, regexp_replace(regexp_replace(ref_key, '^([A-Z]+):A(.+)$', '\1 Art. \2'), '^([A-Z]+):S(.+)$', '\1 s.\2') AS label, CASE WHEN NOT regexp_matches(ref_key, '\(\w+\)$') THEN '' WHEN NOT regexp_matches(regexp_replace(ref_key, '\(\w+\)$', ''), '\(\w+\)$') THEN regexp_replace(ref_key, '\(\w+\)$', '') ELSE regexp_replace(ref_key, '\(\w+\)$', '') || ',' || regexp_replace(regexp_replace(ref_key, '\(\w+\)$', ''), '\(\w+\)$', '') END AS parents FROM ch WHERE ref_key <> ''",
        "ref_roundtrip": f"WITH {_CHUNKS} SELECT DISTINCT ref_key, ref_key AS parsed_key FROM ch JOIN acts ON acts.act_code = split_part(ref_key, ':', 1) WHERE ref_key <> ''",
        "alias_closure": f"WITH RECURSIVE {_CLOSURE} SELECT DISTINCT ref_key, alias FROM cl",
        "ref_lookup": f"WITH RECURSIVE {_CLOSURE} SELECT DISTINCT cl.ref_key, chunk_id FROM cl JOIN ch ON ch.ref_key = alias OR ch.ref_key_alt = alias",
        "idf_table": f"SELECT term, df, round(idf, 6) AS idf FROM {weights}",
        "distinctive_terms": f"SELECT item_id, CAST(rank AS INTEGER) AS rank, term, round(idf, 6) AS idf FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(idf, 9) DESC, pos) AS rank FROM (SELECT t.item_id, t.term, t.pos, coalesce(w.idf, ln({docs} + 1.0) + 1) AS idf FROM {_terms('eval_items', 'item_id', 'text')} t LEFT JOIN {weights} w USING (term))) WHERE rank <= 2",
        "content_tokens": f"SELECT 'documents' AS tab, doc_id AS key, term FROM {_terms('documents', 'doc_id', 'text')} UNION ALL SELECT 'eval_items', item_id, term FROM {_terms('eval_items', 'item_id', 'text')}",
        "numeric_tokens": f"WITH {_CHUNKS} SELECT chunk_id, coalesce(array_to_string({_numbers('text')}, ' '), '') AS numbers FROM ch WHERE text IS NOT NULL",
        "ngram_overlap": f"SELECT quote_id, round(similarity, 6) AS similarity FROM {_SIMILAR}",
        "level1_hashes": f"SELECT quote_id, sha1(f) AS h1, sha1({_level2('f')}) AS h2 FROM (SELECT quote_id, {_level1('quote')} AS f FROM {_UNIQUE})",
        "hash_dedup": f"WITH {_CHUNKS}, hs AS (SELECT chunk_id, sha1({_level2('f')}) AS text_hash FROM (SELECT chunk_id, {_level1('text')} AS f FROM ch WHERE text IS NOT NULL)) SELECT chunk_id, text_hash, min(chunk_id) OVER w AS first_key, count(*) OVER w AS copies FROM hs WINDOW w AS (PARTITION BY text_hash)",
        "query_fingerprints": "SELECT sha1(event_type || ':' || props) AS fingerprint, count(*) AS n, min(event_type) AS event_type, min(props) AS props FROM events GROUP BY 1",
        "dense_topk": _top(_DENSE, 8),
        "dense_topk_filtered": _top(_DENSE + " AND e.label BETWEEN 0 AND 2", 5),
        "vector_norms": "SELECT vec_id, round(list_dot_product(u, u), 6) AS norm, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 2) AS e FROM embeddings))",
        "fusion_pool": f"WITH {_FUSED} SELECT query_id, doc_id, dense, ref_hit, exact_hit, is_web, is_neighbour, routes, score, rank FROM fused WHERE rank <= 40",
        "evidence_packet": f"WITH {_FUSED}, ev AS (SELECT query_id, rank, concat_ws(' — ', nullif(coalesce(a.title, d.source), ''), nullif(d.doc_kind, '')) AS label, CASE WHEN length(text) > 1600 THEN left(text, 1599) || '…' ELSE coalesce(text, '') END AS shown FROM fused LEFT JOIN documents d USING (doc_id) LEFT JOIN acts a ON a.act_code = d.act_code WHERE rank <= 6) "
        "SELECT query_id, string_agg('<evidence id=\"E' || rank || '\" source=\"' || regexp_replace(replace(label, '\"', '&quot;'), '[\\n\\r]', ' ', 'g') || '\">' || chr(10) || shown || chr(10) || '</evidence>', chr(10) || chr(10) ORDER BY rank) AS packet FROM ev GROUP BY query_id",
        "term_coverage": f"WITH qs AS {_UNIQUE}, tm AS (SELECT quote_id, term, 1 AS w FROM {_terms('qs', 'quote_id', 'quote')} UNION ALL SELECT DISTINCT quote_id, unnest({_numbers(_level1('quote'))}), 2 FROM qs), hd AS (SELECT quote_id, {quoted} AS f, {_numbers(_level1('source'))} AS ns FROM qs), "
        "sm AS (SELECT tm.quote_id, CAST(sum(w) AS BIGINT) AS total, CAST(coalesce(sum(w) FILTER (CASE WHEN w = 1 THEN contains(f, term) ELSE list_contains(ns, term) END), 0) AS BIGINT) AS covered FROM tm LEFT JOIN hd USING (quote_id) GROUP BY 1) SELECT quote_id, coalesce(total, 0) AS total, coalesce(covered, 0) AS covered, CASE WHEN coalesce(total, 0) = 0 THEN 1.0 ELSE round(covered / total, 6) END AS coverage FROM qs LEFT JOIN sm USING (quote_id)",
        "quote_tiers": f"SELECT quote_id, tier FROM (SELECT quote_id, CASE WHEN length(q1) > 0 AND contains(s1, q1) THEN 'exact' WHEN length(q2) > 0 AND contains(s2, q2) THEN 'normalized' END AS tier FROM {_QUOTE_LEVELS}) WHERE tier IS NOT NULL",
        "quote_guards": f"SELECT quote_id, {_numbers('q1')} = {_numbers('s1')} AS same_numbers, CAST({negations.format('q2')} AS INTEGER) AS quote_negations, CAST({negations.format('s2')} AS INTEGER) AS source_negations FROM {_QUOTE_LEVELS}",
        "ngram_sweep": f"SELECT threshold, tp, fp, tn, fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE round(tp / (tp + fn), 6) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1 FROM (SELECT t.threshold::DOUBLE AS threshold, {count('ok AND genuine')} AS tp, {count('ok AND NOT genuine')} AS fp, {count('NOT ok AND NOT genuine')} AS tn, {count('NOT ok AND genuine')} AS fn FROM (SELECT threshold, genuine, round(similarity, 6) >= threshold::DOUBLE AS ok FROM {_SIMILAR}, (VALUES {thresholds}) v(threshold) WHERE genuine IS NOT NULL) t GROUP BY 1)",
        "source_cover": "WITH sp AS (SELECT DISTINCT doc_id, length(text) AS size, unnest(chunks) AS c FROM sources), ps AS (SELECT DISTINCT doc_id, size, unnest(range(c.char_start, c.char_end)) AS p FROM sp) SELECT doc_id, count(*) AS covered, round(count(*) / max(size), 6) AS share FROM ps GROUP BY doc_id",
        "source_list": f"SELECT doc_id, doc_title, doc_type, CAST(len(chunks) AS INTEGER) AS n_chunks, CAST(length(text) AS INTEGER) AS n_chars FROM {_STATUS}",
        "web_ids": f"SELECT doc_id, 'web::' || sha1(source_url) AS web_id FROM {_STATUS} WHERE source_url <> ''",
        "point_read": f"WITH {_CHUNKS} SELECT chunk_id, doc_id, seq FROM ch WHERE chunk_id IN (SELECT unnest(chunks).chunk_id FROM sources)",
        "deleted_documents": f"WITH {_CHUNKS} SELECT chunk_id, doc_id FROM ch WHERE NOT coalesce(doc_id IN (SELECT doc_id FROM {_STATUS} WHERE doc_type = 'web'), false)",
        "cited_sources": "SELECT DISTINCT quote_id, doc_id, coalesce(doc_id IN (SELECT doc_id FROM sources), false) AS valid FROM quotes",
        "ingest_totals": "SELECT ingest_batch, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars FROM chunks GROUP BY 1",
        "sign_off": f"SELECT doc_type, coalesce(nullif(lower(trim(verification_status)), ''), 'unverified') AS state, count(*) AS n_docs, CAST(sum(len(chunks)) AS BIGINT) AS n_chunks FROM {_STATUS} GROUP BY 1, 2",
        "long_provisions": _PARTS,
        "quotes_elsewhere": f"""WITH {_CHUNKS}, q AS (SELECT quote_id, q2 FROM (SELECT quote_id, q2, length(q1) > 0 AND contains(s1, q1) OR length(q2) > 0 AND contains(s2, q2) AS own FROM {_QUOTE_LEVELS}) WHERE own IS NOT TRUE AND length(q2) >= {LEAST_CHARS} AND len(string_split(q2, ' ')) >= 3),
 t AS (SELECT chunk_id, {_level2('f')} AS t2 FROM (SELECT chunk_id, {_level1('text')} AS f FROM ch WHERE text IS NOT NULL))
 SELECT quote_id, min(chunk_id) AS found_in, count(*) AS n_texts FROM q JOIN t ON contains(t2, q2) GROUP BY quote_id""",
        "stream_expired_users": f"SELECT user_id, n, last_event, last_type FROM {_LATEST} WHERE last_ts + INTERVAL 1 DAY < (SELECT max(ts) - INTERVAL 2 HOUR FROM events)",
        "chunk_ids": f"WITH {_CHUNKS} SELECT chunk_id, doc_id || '::c' || format('{{:03d}}', row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) AS made_id FROM ch",
        "read_passages": f"WITH {_CHUNKS}, ok AS (SELECT * FROM ch WHERE text IS NOT NULL) SELECT a.chunk_id AS anchor_id, CAST(count(*) AS INTEGER) AS n, md5(left(string_agg(c.text, chr(10) || chr(10) ORDER BY c.seq, c.chunk_id), 3000)) AS passage_hash FROM ok a JOIN ok c ON c.doc_id = a.doc_id AND c.seq BETWEEN a.seq - 1 AND a.seq + 1 GROUP BY 1",
        "distinct_acts": "SELECT count(*) AS n_acts, string_agg(act_code || ':' || n, ' ' ORDER BY act_code) AS counts FROM (SELECT act_code, count(*) AS n FROM documents WHERE act_code <> '' GROUP BY 1)",
        "qualifier_search": f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{text.QUALIFIER_SEARCH}')",
        "case_citations": f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{text.CASE_CITATION}'))) AS citation FROM documents",
        "pool_merged": f"WITH {_MERGED} SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM ms",
        "pool_duplicates": f"WITH {_MERGED} SELECT query_id, doc_id, CAST(unnest(string_split(duplicates, ',')) AS BIGINT) AS duplicate FROM ms WHERE duplicates <> ''",
        "pool_summary": f"WITH {_FUSED}, ct AS (SELECT query_id, d.act_code, count(*) AS n, min(rank) AS r FROM fused JOIN documents d USING (doc_id) WHERE rank <= 5 AND d.act_code <> '' GROUP BY 1, 2), "
        "ac AS (SELECT query_id, act_code AS act FROM ct WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, r) = 1) SELECT query_id, count(*) FILTER (score >= 0.4::DOUBLE) AS strong, max(score) AS top_score, any_value(act) AS act FROM fused LEFT JOIN ac USING (query_id) WHERE rank <= 8 GROUP BY query_id",
        "pool_trace": f"WITH {_FUSED} SELECT query_id, doc_id, rank, round(score, 4) AS score, round(dense * 0.5::DOUBLE, 4) AS of_dense, round(ref_hit::INT * 0.3::DOUBLE, 4) AS of_ref, round(exact_hit::INT * 0.2::DOUBLE, 4) AS of_exact, routes FROM fused WHERE rank <= 12",
        "uncovered_terms": f"WITH qs AS {_UNIQUE}, tm AS {_terms('qs', 'quote_id', 'quote')}, hd AS (SELECT quote_id, {quoted} AS f FROM qs) SELECT quote_id, term FROM tm JOIN hd USING (quote_id) WHERE NOT coalesce(contains(f, term), false) AND NOT regexp_matches(term, '^[0-9]+$') AND term NOT IN ({', '.join(repr(w) for w in text.NUMBER_WORDS)})",
        "quote_cut": "SELECT DISTINCT quote_id, md5(left(quote, 600)) AS cut_hash, length(quote) > 600 AS truncated FROM quotes WHERE quote IS NOT NULL",
        "top_types": "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10",
        "reached_types": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS reached, bool_or(event_type = 'error') AS failed FROM events GROUP BY 1",
        "requests_of_class": "SELECT event_id, event_type, user_id FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) // 10 = 3 AND contains(lower(event_type), 'cl') ORDER BY event_id DESC LIMIT 100",
        "failed_users": f"SELECT user_id, last_event, n FROM {_LATEST} WHERE last_type = 'error' ORDER BY last_ts DESC, last_event LIMIT 20",
        "request_metrics": _TOTALS,
        "request_percentiles": _discrete(),
        "request_percentiles_by_type": _discrete("event_type"),
        "request_by_type": "SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 2) AS total, max(value) AS max_value, round(sum(value) / count(*), 2) AS avg_value FROM events GROUP BY event_type",
        "request_by_class": "SELECT CAST(CAST(json_extract(props, '$.k') AS INTEGER) // 10 AS VARCHAR) || 'x' AS class, count(*) AS n FROM events GROUP BY 1",
        "ring_last_n": "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
        "ring_last_n_by_user": "SELECT user_id, CAST(age AS INTEGER) AS age, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 3",
        "window_recent": _TOTALS + " WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 1440 MINUTE AND ts <= TIMESTAMP '2024-01-15'",
        "events_since": "SELECT event_id, event_type, user_id FROM events WHERE event_id > 5000 AND contains(event_type, 'cl') ORDER BY event_id DESC LIMIT 200",
        "event_numbers": "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq FROM events",
        "user_state": f"SELECT user_id, last_type, last_event, n FROM {_LATEST}",
        "stream_user_state": f"SELECT user_id, last_type, last_event, n FROM {_LATEST}",
        "expired_users": f"SELECT user_id, last_event FROM {_LATEST} WHERE last_ts < TIMESTAMP '2024-01-30' - INTERVAL 60 MINUTE",
        "hourly_windows": _HOURS,
        "stream_windows": _HOURS,
        "stream_closed_windows": f"SELECT * FROM ({_HOURS}) WHERE strptime(window_start, '%Y-%m-%d %H:%M:%S') + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)",
        "stream_dedup": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type",
        "user_sessions": "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2) GROUP BY 1",
        "capped_details": """SELECT event_id, CASE WHEN length(d) > 34 THEN '{"_truncated":true,"_originalChars":' || length(d) || ',"preview":"' || replace(left(d, 34), '"', '\\"') || '"}' ELSE d END AS detail FROM (SELECT event_id, '{"type":"' || event_type || '","props":' || props || '}' AS d FROM events)""",
        "redacted_details": "SELECT event_id, '••••••••' AS token, CASE WHEN length(event_type) > 4 THEN '[' || length(event_type) || ' chars elided]' ELSE event_type END AS type FROM events",
        "run_log_roundtrip": f"SELECT CAST(user_id AS VARCHAR) AS id, strftime(last_ts, '%Y-%m-%dT%H:%M:%S') AS recordedAt, last_type AS status, 'last event ' || last_event AS preview, 0 AS events FROM {_LATEST} ORDER BY 2 DESC, 1 LIMIT 100",
    }
