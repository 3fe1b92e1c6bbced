"""The pool of candidates against brute force."""

from pyspark.sql import functions as F

from attesta import queries
from attesta.operators import retrieve


def test_pool_holds_all_routes(spark, tmp_path):
    docs = [(i, "BIG" if i % 3 == 0 else "SML" if i % 50 == 1 else None, "done in good faith" if i % 7 == 0 else None if i % 11 == 0 else "plain") for i in range(300) if i % 13 != 5]
    vectors = [(i, [1.0, float(i % 9), float(i % 4)]) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, act_code string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    unit = retrieve.normalised_vector(F.col("embedding")).cast("array<float>").alias("embedding")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").select("vec_id", unit, F.lit(0).alias("label")).write.parquet(str(tmp_path / "embeddings.parquet"))
    dense = {}
    for r in queries.dense_topk(spark, str(tmp_path)).collect():
        dense.setdefault(r.query_id, {})[r.vec_id] = r.similarity
    act, phrase = {i: a for i, a, _ in docs}, {i for i, _, t in docs if t and "in good faith" in t}
    want = {}
    for q in (0, 20, 40):
        beside = {d + x for d in dense[q] for x in (-1, 1)} & set(act) - {q}
        ref = {d for d in act if act[d] and act[d] == act.get(q)} - {q}
        scored = []
        for d in set(dense[q]) | beside | ref | phrase - {q}:
            routes = [n for n, s in (("dense", dense[q]), ("exact", phrase), ("neighbour", beside), ("ref", ref)) if d in s]
            raw = 0.5 * dense[q].get(d, 0.0) + 0.3 * (d in ref) + 0.2 * (d in phrase) - 0.05 * (routes == ["neighbour"])
            scored.append((-round(max(0.0, min(1.0, raw)), 6), d, ",".join(routes)))
        want[q] = [(d, r, -s) for s, d, r in sorted(scored)[:40]]
    got = {}
    for r in queries.fusion_pool(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.routes, round(r.score, 6)))
    assert got == want
    assert all(len(v) == 40 for v in got.values()) and max(d for d, _, _ in got[0]) >= 60


def test_packet_keeps_whole_passages(spark, tmp_path):
    long = "in good faith " + "w" * 2000
    docs = [(i, "HTA" if i < 4 else None, long if i == 1 else "s" * 1600, "notice", "gazette") for i in range(9)]
    spark.createDataFrame(docs, "doc_id long, act_code string, text string, doc_kind string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("HTA", 'The "Harbour" Tolls Act')], "act_code string, title string").write.parquet(str(tmp_path / "acts.parquet"))
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(9)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    (row,) = queries.evidence_packet(spark, str(tmp_path)).collect()
    blocks = row.packet.split("\n\n")
    assert len(blocks) == 6 and blocks[0] == '<evidence id="E1" source="The &quot;Harbour&quot; Tolls Act — notice">\n' + long[:1599] + "…\n</evidence>"
    assert all(b.startswith(f'<evidence id="E{i}"') and b.endswith("\n" + "s" * 1600 + "\n</evidence>") for i, b in enumerate(blocks[1:], 2)) and 'source="gazette — notice"' in blocks[5]
    shown = spark.range(3).select(retrieve.evidence_block(F.lit(1), F.lit("a"), F.element_at(F.array(F.lit("read_down"), F.lit("odd"), F.lit(None)), (F.col("id") + 1).cast("int")), F.lit(None)).alias("b")).collect()
    assert [r.b.split(">")[0] for r in shown] == ['<evidence id="E1" source="a" status="read down or kept in abeyance by a court"', '<evidence id="E1" source="a" status="odd"', '<evidence id="E1" source="a"']


def test_copies_and_near_duplicates_are_merged(spark):
    base = " ".join(f"word{i} of the harbour" for i in range(60))
    texts = {1: base, 2: base.upper() + "!", 3: base + " and", 4: base + " and then some more", 5: "wholly other words", 6: None, 7: None, 8: "abc", 9: "abd", 10: "abc"}
    scores = {1: 0.5, 2: 0.9, 3: 0.7, 4: 0.6, 5: 0.4, 6: 0.3, 7: 0.3, 8: 0.2, 9: 0.2, 10: 0.1}
    hits = [(1, k, "ref" if k == 3 else "dense", d, k == 3, False, False, k == 4) for k, d in scores.items()] + [(2, 1, "dense", 0.1, False, False, False, False)]
    pool = retrieve.fuse(spark.createDataFrame(hits, "query_id int, chunk_id long, route string, dense double, ref_hit boolean, exact_hit boolean, is_web boolean, is_neighbour boolean"))
    got = {(r.query_id, r.chunk_id): (r.duplicates, r.routes, r.score, r.rank) for r in retrieve.merged(pool, spark.createDataFrame(list(texts.items()), "chunk_id long, text string")).collect()}
    # 3 is first by its score (0.65) and takes in 2 with its copy 1, and 4; short texts have no n-grams, so all of them count as alike.
    assert got[1, 3] == ([1, 2, 4], "dense,ref", 0.75, 1) and got[1, 5][0] == [] and got[1, 6][0] == got[1, 7][0] == [] and got[2, 1] == ([], "dense", 0.05, 1)
    assert got[1, 8][0] == [10] and got[1, 9][0] == []
