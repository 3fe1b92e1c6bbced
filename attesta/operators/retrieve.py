"""Retrieval: term weights, vector and keyword and key look-ups, and the fusion of what they find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import refs, text
from attesta.session import kept

WEIGHTS = {"dense": 0.5, "ref": 0.3, "exact": 0.2, "web": 0.10, "neighbour": 0.05}
STATUS_NOTES = {
    "in_force": "currently in force",
    "applies_to_prior_offences": "applies to offences before 1 July 2024; superseded for later ones",
    "repealed": "repealed",
    "struck_down": "struck down by a court and no longer in force",
    "read_down": "read down or kept in abeyance by a court",
    "amended": "amended",
}


def idf(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(term, df, idf): ln((N + 1) / (df + 1)) + 1 over all documents with a text. The number of documents is one value, counted once."""
    sorted_terms = F.explode(F.array(F.expr(text.sorted_terms(column))))
    rows = docs.where(F.col(column).isNotNull()).select(key, sorted_terms.alias("all_terms")).select(key, text.term_set(F.col("all_terms")).alias("terms"))
    n = docs.where(F.col(column).isNotNull()).count()
    counted = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counted.withColumn("idf", F.log((F.lit(n) + 1.0) / (F.col("df") + 1)) + 1)


def distinctive(items: DataFrame, key: str, column: str, weights: DataFrame, docs_count: int, most: int = 2) -> DataFrame:
    """(key, rank, term, idf): the rarest terms of each text; unknown terms weigh most, ties go to the first in the text."""
    terms = items.select(key, F.posexplode(F.expr(text.content_tokens(column))).alias("pos", "term"))
    known = terms.join(weights.select("term", "idf"), "term", "left").withColumn("idf", F.coalesce("idf", F.log(F.lit(docs_count + 1.0)) + 1))
    order = Window.partitionBy(key).orderBy(F.round("idf", 9).desc(), "pos")
    return known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(key, "rank", "term", "idf")


def normalised_vector(vector: Column) -> Column:
    """The vector at length 1; one without length stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm > 0) & ~F.isnan(norm), F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _packed(rows: DataFrame, key: str, vector: str, block: int, name: str) -> DataFrame:
    """Vectors in blocks of about ``block``, a row each: keys and vectors as lists."""
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-rows.count() // block))
    packs = rows.groupBy(F.pmod(F.xxhash64("k"), F.lit(blocks)).alias("b"), F.size("v").alias(f"{name}_size"))
    return packs.agg(F.collect_list("k").alias(f"{name}_keys"), F.flatten(F.collect_list("v")).alias(f"{name}_values"), F.count("*").alias("n")).drop("b", "n")


def _best(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best ``top`` of a block of vectors for each query of a block of queries. More are kept only where they tie with the last of these."""
        for batch in batches:
            for i in range(batch.num_rows):
                own = {c: batch.column(c)[i].values.to_numpy() for c in ("q_keys", "q_values", "v_keys", "v_values")}
                q, v = (own[f"{x}_values"].reshape(len(own[f"{x}_keys"]), -1) for x in "qv")
                like = np.round(np.clip(q @ v.T, 0.0, 1.0), 6)
                like[own["q_keys"][:, None] == own["v_keys"][None, :]] = -1.0  # itself
                least = np.partition(like, max(0, like.shape[1] - top), axis=1)[:, max(0, like.shape[1] - top)]
                a, b = np.nonzero((like >= least[:, None]) & (like >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(own["q_keys"][a]), pa.array(own["v_keys"][b]), pa.array(like[a, b])], ["query_id", "k", "similarity"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 8, block: int = 1000) -> DataFrame:
    """(query_id, key, rank, similarity): the ``top`` vectors most like each query, itself left out, exactly. Vectors have length 1; those of another number
    of dimensions and null ones are left out. Ties go to the smaller key.

    A stated set of queries is compared with all rows in blocks: each pair of a block of queries and a block of vectors is one row and one product of
    matrices, of which the best are kept, and only these are compared further. The plan is the same however many blocks there are.
    """
    pairs = _packed(vectors, key, vector, block, "v").crossJoin(_packed(queries, key, vector, block, "q")).where("v_size = q_size AND v_size > 0")
    kind = vectors.schema[key].dataType.simpleString()
    found = pairs.select("q_keys", "q_values", "v_keys", "v_values").mapInArrow(_best(top), f"query_id {kind}, k {kind}, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "k")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", F.col("k").alias(key), "rank", "similarity")


def keyword(rows: DataFrame, column: str, pattern: str | None = None, phrase: str | None = None) -> DataFrame:
    """Rows that hold a pattern (without regard to case) or else a phrase; every row is looked at. Neither given: no rows."""
    if pattern:
        return rows.where(F.col(column).rlike(f"(?i){pattern}"))
    return rows.where(F.col(column).contains(phrase)) if phrase else rows.limit(0)


def lookup(keys: DataFrame, chunks: DataFrame, equivalences: DataFrame) -> DataFrame:
    """(ref_key, chunk_id): the chunks under a key, its parents or any equivalent, by their own key or their second one.

    Two joins on equal keys in place of one with OR, which would compare every pair.
    """
    wanted = refs.closure(keys, equivalences)
    own = chunks.select("chunk_id", F.explode(F.array_distinct(F.array("ref_key", "ref_key_alt"))).alias("alias")).where("alias IS NOT NULL AND alias != ''")
    return wanted.join(own, "alias").select("ref_key", "chunk_id").distinct()


def hits_of_routes(dense: DataFrame, docs: DataFrame, queries: DataFrame, most: int = 40) -> DataFrame:
    """Hits (query_id, doc_id, route, dense, ref_hit, exact_hit, is_web, is_neighbour) of four routes: nearest, act, phrase, and documents next to the nearest.

    dense: (query_id, doc_id, similarity); docs: (doc_id, act_code, has_phrase); queries: (query_id). The queries' own documents are left out. An act may hold
    a third of all documents and all queries ask for the phrase; but documents that only these routes find are ordered by their key among their like, so no
    more than the first ``most`` of each kind can enter a list of ``most`` rows, and only these are joined. What the other routes find is looked up whole.
    """
    asked = queries.select("query_id").distinct().join(docs.select(F.col("doc_id").alias("query_id"), F.col("act_code").alias("asked")), "query_id", "left")
    beside = dense.select("query_id", F.explode(F.array(F.col("doc_id") - 1, F.col("doc_id") + 1)).alias("doc_id")).distinct()
    beside = beside.join(docs.select("doc_id"), "doc_id").where("doc_id != query_id")
    reached = dense.select("query_id", "doc_id").unionByName(beside).distinct().join(asked, "query_id").join(docs, "doc_id")
    kind = Window.partitionBy("act_code", "has_phrase").orderBy("doc_id")
    first = docs.where("act_code IS NOT NULL").withColumn("n", F.row_number().over(kind)).where(F.col("n") <= most + 1).drop("n")  # one may be the query's own
    of_act = asked.join(first, F.col("asked") == F.col("act_code"))
    of_phrase = asked.crossJoin(F.broadcast(docs.where("has_phrase").orderBy("doc_id").limit(most + 1)))
    found = reached.unionByName(of_act).unionByName(of_phrase).where("doc_id != query_id").distinct()

    def hits(rows: DataFrame, route: str, similarity: Column) -> DataFrame:
        flags = [F.lit(route == r).alias(n) for r, n in (("ref", "ref_hit"), ("exact", "exact_hit"), ("web", "is_web"), ("neighbour", "is_neighbour"))]
        return rows.select("query_id", "doc_id", F.lit(route).alias("route"), similarity.alias("dense"), *flags)

    none = F.lit(0.0)
    out = hits(dense, "dense", F.col("similarity")).unionByName(hits(beside, "neighbour", none))
    return out.unionByName(hits(found.where("asked = act_code"), "ref", none)).unionByName(hits(found.where("has_phrase"), "exact", none))


def score(dense: Column, ref: Column, exact: Column, web: Column, neighbour: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    on = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    raw = weights["dense"] * F.coalesce(dense, F.lit(0.0)) + weights["ref"] * on(ref) + weights["exact"] * on(exact) - weights["web"] * on(web) - weights["neighbour"] * on(neighbour)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def fuse(hits: DataFrame, query: str = "query_id", key: str = "chunk_id", most: int = 40, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """One row for each query and candidate out of the hits of all routes, ranked by score.

    hits: (query, key, route, dense, ref_hit, exact_hit, is_web, is_neighbour). Similarity counts at its most, a hit if any route has it, a neighbour only if
    all have it. Ties go to the smaller key. ``most`` rows are kept for each query: the length of the ranked list.
    """
    one = hits.groupBy(query, key).agg(
        F.max("dense").alias("dense"), F.bool_or("ref_hit").alias("ref_hit"), F.bool_or("exact_hit").alias("exact_hit"), F.bool_or("is_web").alias("is_web"),
        F.bool_and("is_neighbour").alias("is_neighbour"), F.concat_ws(",", F.array_sort(F.collect_set("route"))).alias("routes"),
    )
    one = one.withColumn("score", F.round(score(*[F.col(c) for c in ("dense", "ref_hit", "exact_hit", "is_web", "is_neighbour")], weights), 7))
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), key)
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


# Jaccard of character 5-grams from which two candidates are one; sets are sketched by their least value in each of so many classes, in bands.
NEAR, CLASSES, BAND = 0.90, 64, 4


def _near_pairs(rows: DataFrame, forms: DataFrame, query: str, key: str) -> DataFrame:
    """(query, ord, before): for each candidate the better ranked ones of its query whose n-gram sets reach NEAR.

    Candidates of one query that agree in a band of minima are compared exactly; two sets at NEAR miss all sixteen bands with probability 4e-8.
    """
    least = forms.select(key, F.explode("grams").alias("g")).groupBy(key, F.pmod("g", F.lit(CLASSES)).alias("class")).agg(F.min("g").alias("least"))
    bands = least.groupBy(key, F.floor(F.col("class") / BAND).alias("band")).agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("class", "least")))).alias("sketch"))
    placed = rows.select(query, key, "ord").join(bands, key)
    a, b = (placed.select(query, "band", "sketch", F.col(key).alias(f"key_{x}"), F.col("ord").alias(f"ord_{x}")) for x in "ab")
    pairs = a.join(b, [query, "band", "sketch"]).where("ord_a < ord_b").select(query, "key_a", "key_b", "ord_a", "ord_b").distinct()
    for x in "ab":
        pairs = pairs.join(forms.select(F.col(key).alias(f"key_{x}"), F.col("grams").alias(f"grams_{x}")), f"key_{x}")
    near = pairs.where(text.jaccard(F.col("grams_a"), F.col("grams_b")) >= NEAR)
    return near.groupBy(query, F.col("ord_b").alias("ord")).agg(F.collect_list("ord_a").alias("before"))


def merged(pool: DataFrame, texts: DataFrame, query: str = "query_id", key: str = "chunk_id", column: str = "text", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """A ranked pool (of ``fuse``) in which copies and near-duplicates are one candidate each, ranked anew, with the keys that were merged as ``duplicates``.

    Candidates with the same letters and digits go to the best ranked of them; then, in order of rank, each goes to the best ranked of those still standing
    whose 5-gram Jaccard with it reaches NEAR. Who stays takes over the best similarity, all hits and all routes; whether it is from the web or a neighbour is
    its own. ``texts`` is (key, text); candidates without a text stay as they are. Lists are as short as ``fuse`` makes them, and only their texts are read.
    """
    forms = texts.join(pool.select(key).distinct(), key, "left_semi").where(F.col(column).isNotNull())
    forms = kept(forms.select(key, F.sha1(F.expr(text.level2(text.level1(column)))).alias("hash"), F.expr(text.char_ngrams(column)).alias("grams")))
    rows = kept(pool.withColumnRenamed("rank", "ord").join(forms.select(key, "hash"), key, "left"))
    same = rows.where("hash IS NOT NULL").groupBy(query, "hash").agg(F.min("ord").alias("twin"))
    rows = rows.join(same, [query, "hash"], "left").withColumn("twin", F.coalesce("twin", "ord"))
    near = _near_pairs(rows.where("ord = twin"), forms, query, key)
    none = F.array().cast("array<int>")
    stands = lambda gone, x: F.array_except(x["before"], gone)
    lists = near.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("ord", "before"))).alias("all"))
    lists = lists.withColumn("gone", F.aggregate("all", none, lambda gone, x: F.when(F.size(stands(gone, x)) > 0, F.array_append(gone, x["ord"])).otherwise(gone)))
    moved = lists.select(query, "gone", F.explode("all").alias("x")).select(query, F.col("x.ord").alias("twin"), F.array_min(stands(F.col("gone"), F.col("x"))).alias("lead"))
    rows = rows.join(moved, [query, "twin"], "left").withColumn("lead", F.coalesce("lead", "twin"))
    first = lambda c: F.min_by(c, "ord").alias(c)
    one = rows.groupBy(query, "lead").agg(
        first(key), F.max("dense").alias("dense"), F.bool_or("ref_hit").alias("ref_hit"), F.bool_or("exact_hit").alias("exact_hit"), first("is_web"), first("is_neighbour"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("routes", ","))))), ",").alias("routes"), F.array_sort(F.collect_list(F.when(F.col("ord") != F.col("lead"), F.col(key)))).alias("duplicates"),
    )
    one = one.drop("lead").withColumn("score", F.round(score(*[F.col(c) for c in ("dense", "ref_hit", "exact_hit", "is_web", "is_neighbour")], weights), 7))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), key)))


# Score from which a candidate is strong, and how many of the first are looked at for that and for the act they share.
STRONG, STRONG_AMONG, ACT_AMONG = 0.40, 8, 5


def pool_summary(pool: DataFrame, acts: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, strong, top_score, act): strong candidates among the first eight, the best score, and the act that two or more of the first five share (of
    equal counts that which comes first). ``acts`` is (key, act_code)."""
    first = pool.where(F.col("rank") <= STRONG_AMONG)
    sums = first.groupBy(query).agg(F.count_if(F.col("score") >= STRONG).alias("strong"), F.max("score").alias("top_score"))
    counts = pool.where(F.col("rank") <= ACT_AMONG).join(acts.where("act_code != ''"), key).groupBy(query, "act_code").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    act = counts.where("n >= 2").groupBy(query).agg(F.max_by("act_code", F.struct("n", -F.col("first"))).alias("act"))
    return sums.join(act, query, "left")


def uncovered(items: DataFrame, key: str, item_text: str, candidate_text: str) -> DataFrame:
    """(key, term): the words of a text, numbers aside, that do not stand in its candidate."""
    terms = items.select(key, F.expr(text.level1(candidate_text)).alias("held"), F.explode(F.expr(text.content_tokens(item_text))).alias("term"))
    terms = terms.where(~F.expr(text.number_like("term")))
    return terms.where(~F.coalesce(F.expr(text.level2("held")).contains(F.col("term")), F.lit(False))).select(key, "term").distinct()


def evidence_block(rank: Column, label: Column, status: Column, passage: Column, most: int = 1600) -> Column:
    """A numbered passage of at most ``most`` characters with its source and, where there is one, the note of its status."""
    attribute = lambda c: F.regexp_replace(F.replace(c, F.lit('"'), F.lit("&quot;")), r"[\n\r]", " ")
    notes = F.create_map(*[F.lit(x) for pair in STATUS_NOTES.items() for x in pair])
    note = F.coalesce(F.try_element_at(notes, status), status, F.lit(""))
    shown = F.coalesce(passage, F.lit(""))
    shown = F.when(F.length(shown) > most, F.concat(F.left(shown, F.lit(most - 1)), F.lit("…"))).otherwise(shown)
    told = F.when(note != "", F.concat(F.lit(' status="'), attribute(note), F.lit('"'))).otherwise("")
    return F.concat(F.lit('<evidence id="E'), rank.cast("string"), F.lit('" source="'), attribute(F.coalesce(label, F.lit(""))), F.lit('"'), told, F.lit(">\n"), shown, F.lit("\n</evidence>"))


def same_text(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, text_hash, first_key, copies): rows whose letters and digits are the same; grouped by hash, with the smallest key of each group."""
    hashed = kept(rows.where(F.col(column).isNotNull()).select(key, F.sha1(F.expr(text.level2(text.level1(column)))).alias("text_hash")))  # each text is folded once
    groups = hashed.groupBy("text_hash").agg(F.min(key).alias("first_key"), F.count("*").alias("copies"))
    return hashed.join(groups, "text_hash").select(key, "text_hash", "first_key", "copies")


def coverage(items: DataFrame, candidates: DataFrame, key: str, item_text: str, candidate_text: str) -> DataFrame:
    """(key, total, covered, coverage): how much of the weight of an item's terms its candidates hold. Words weigh 1, numbers 2; no terms: all covered.

    ``candidates`` is (key, text). A word is held where it stands in the folded text, a number where it is among the numbers.
    """
    words = F.transform(F.expr(text.content_tokens(item_text)), lambda t: F.struct(t.alias("term"), F.lit(1).alias("weight")))
    numbers = F.transform(F.array_distinct(F.expr(text.numeric_tokens(text.level1(item_text)))), lambda t: F.struct(t.alias("term"), F.lit(2).alias("weight")))
    terms = items.select(key, F.explode_outer(F.concat(words, numbers)).alias("t")).select(key, "t.term", "t.weight").distinct()
    held = candidates.select(key, F.explode(F.array(F.expr(text.level1(candidate_text)))).alias("f1"))
    held = held.select(key, F.expr(text.level2("f1")).alias("folded"), F.expr(text.numeric_tokens("f1")).alias("numbers"))
    met = terms.join(held, key).where(F.when(F.col("weight") == 1, F.col("folded").contains(F.col("term"))).otherwise(F.array_contains("numbers", F.col("term")))).select(key, "term", "weight").distinct()
    total = terms.groupBy(key).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total"))
    got = met.groupBy(key).agg(F.sum("weight").alias("covered"))
    out = total.join(got, key, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.withColumn("coverage", F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.round(F.col("covered") / F.col("total"), 6)))
