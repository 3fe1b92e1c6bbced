"""Queries over all that they are asked for, on small tables."""

from attesta import queries
from attesta.functions import refs


def stored(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


CHUNKS = "chunk_id string, doc_id string, seq int, ref_key string, ref_key_alt string, ingest_batch string, ingested_at string"


def test_neighbours_of_every_chunk(spark, tmp_path):
    rows = [(f"d::c{i}", "d", i, None, None, "b", "t") for i in range(7)] + [("e::c0", "e", 3, None, None, "b", "t")]
    got = {tuple(r) for r in queries.neighbour_read(spark, stored(spark, tmp_path, chunks=(rows, CHUNKS))).collect()}
    want = {(a[0], b[0], b[2], a[2] == b[2]) for a in rows for b in rows if a[1] == b[1] and abs(a[2] - b[2]) <= 1}
    assert got == want and len({a for a, *_ in got}) == 8


def test_all_keys_are_asked_for(spark, tmp_path):
    rows = [("d::c0", "d", 0, "A:S1", "C:S7", "b", "t"), ("d::c1", "d", 1, "B:S2(1)", "", "b", "t"), ("d::c2", "d", 2, None, None, "b", "t")]
    folder = stored(spark, tmp_path, chunks=(rows, CHUNKS), equivalences=([("A:S1", "B:S2"), ("D:S4", "A:S1")], "a string, b string"))
    same = {"A:S1", "B:S2", "D:S4"}
    want = {(k, x) for k in same for x in same} | {("C:S7", "C:S7"), ("B:S2(1)", "B:S2(1)")} | {("B:S2(1)", x) for x in same}
    assert {tuple(r) for r in queries.alias_closure(spark, folder).collect()} == want
    held = {"A:S1": "d::c0", "C:S7": "d::c0", "B:S2(1)": "d::c1"}
    assert {tuple(r) for r in queries.ref_lookup(spark, folder).collect()} == {(k, held[x]) for k, x in want if x in held}


def test_closure_has_no_last_step(spark):
    chain = spark.createDataFrame([(f"A:S{i}", f"A:S{i + 1}") for i in range(12)], "a string, b string")
    assert refs.closure(spark.createDataFrame([("A:S0",)], "ref_key string"), chain).count() == 13


def test_tokens_and_order_of_growing_tables(spark, tmp_path):
    folder = stored(
        spark, tmp_path, documents=([(1, "sealed boats"), (2, None)], "doc_id long, text string"), eval_items=([(1, "boats")], "item_id long, text string"),
        acts=([("a", "A", "Act A", ["x", "y"]), ("z", "Z", "Act Z", ["z"])], "doc_id string, act_code string, title string, names array<string>"),
        sources=([("m", "", "M v N"), ("m", "", "M v N"), ("a", "A", "Act A")], "doc_id string, act_code string, doc_title string"),
    )
    assert {tuple(r) for r in queries.content_tokens(spark, folder).collect()} == {("documents", 1, "seal"), ("documents", 1, "boat"), ("eval_items", 1, "boat")}
    assert [tuple(r) for r in queries.document_order(spark, folder).collect()] == [("a", "A", "Act A", 2), ("m", "", "M v N", 0), ("z", "Z", "Act Z", 1)]
