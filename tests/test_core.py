"""Operators on small tables, with nulls, empty tables and clashing names."""

import json
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from attesta.functions import filters, places, refs, text
from attesta.operators import corpus, metrics, quotes, retrieve
from attesta.sources import files


def value(spark, expression, given):
    return spark.createDataFrame([(given,)], "t string").select(F.expr(expression)).first()[0]


def test_levels(spark):
    assert value(spark, text.level1("t"), "See  Sec. 5, S. 7 and “punish-\n  ment” of Rs 1,00,000") == 'see section 5, section 7 and "punishment" of rs 100000'
    assert value(spark, text.level2(text.level1("t")), "A—B, c!") == "a b c"
    assert value(spark, text.level1("t"), "") == "" and value(spark, text.level1("t"), None) is None


def test_tokens(spark):
    assert value(spark, text.content_tokens("t"), "The licences and Licensing of notified boats") == ["licenc", "licens", "notifi", "boat"]
    assert value(spark, text.numeric_tokens("t"), "seven of 007 or two lakh, 19(1)") == ["1", "100000", "19", "2", "7", "7"]
    assert len(value(spark, text.char_ngrams("t"), "abcdefg")) == 3 and value(spark, text.char_ngrams("t"), "abc") == []
    assert value(spark, text.negation_count("t"), "do not nothing unless no") == 3


def test_html(spark):
    page = "<style>x</style><p>A &amp; B&nbsp;&#8377;5</p><script>1</script><br/>C<!-- no -->"
    assert value(spark, text.html_to_text("t"), page) == "A & B ₹5\n \nC"


def test_filters(spark):
    df = spark.range(10).withColumn("s", F.concat(F.lit("a"), "id"))
    count = lambda spec: df.where(filters.where(spec)).count()
    assert count(None) == 10 and count({"id": {"$in": [1, 2]}}) == 2 and count({"id": {"$nin": [1, 2]}}) == 8
    assert count({"$or": [{"id": {"$lt": 2}}, {"id": {"$gte": 9}}]}) == 3 and count({"s": {"$contains": "a3"}}) == 1 and count({"s": {"$regex": "A[12]"}}) == 2
    assert filters.all_of() is None and filters.all_of(None, {"id": {"$eq": 1}}) == {"id": {"$eq": 1}}
    for bad in ({}, {"a": 1}, {"id": {"$in": []}}, {"$and": [{"id": {"$eq": 1}}]}, {"id": {"$eq": 1}, "s": {"$eq": 1}}, {"id": {"$like": 1}}):
        with pytest.raises(ValueError):
            filters.where(bad)


def test_references(spark):
    acts = spark.createDataFrame([("HTA", ["harbour tolls act", "h.t.a.", "hta"]), ("CHT", ["charter"])], "act_code string, names array<string>")
    names = refs.act_names(acts)
    wanted = {"Section 12(3) of the Harbour Tolls Act": "HTA:S12(3)", "HTA 66a": "HTA:S66A", "Article 19(1)(a) of the Charter": "CHT:A19(1)(a)", "Harbour Tolls Act, 2014": "", "§ 5, h.t.a.": "HTA:S5", "nothing": ""}
    df = spark.createDataFrame([(k,) for k in wanted], "raw string")
    got = {r.raw: r.k for r in df.select("raw", refs.ref_key(refs.parsed(F.col("raw"), refs.act_code(F.col("raw"), names))).alias("k")).collect()}
    assert got == wanted
    row = spark.createDataFrame([("CHT:A19(1)(a)",)], "k string").select(refs.parents(F.col("k")).alias("p"), refs.label(F.col("k")).alias("l")).first()
    assert row.p == ["CHT:A19(1)", "CHT:A19"] and row.l == "CHT Art. 19(1)(a)"


def test_closure_follows_chains(spark):
    pairs = spark.createDataFrame([("A:S1", "B:S2"), ("B:S2", "C:S3"), (None, "X")], "a string, b string")
    keys = spark.createDataFrame([("A:S1(4)",), (None,), ("",)], "ref_key string")
    assert {r.alias for r in refs.closure(keys, pairs).collect()} == {"A:S1(4)", "A:S1", "B:S2", "C:S3"}


def test_offsets_and_carry(spark):
    parts = spark.createDataFrame([("d", 0, "abc"), ("d", 1, "de"), ("e", 0, "")], "doc_id string, seq int, text string")
    got = {(r.doc_id, r.seq): (r.start_at, r.end_at) for r in corpus.offsets(parts).collect()}
    assert got == {("d", 0): (0, 3), ("d", 1): (5, 7), ("e", 0): (0, 0)}
    assert [r.with_carry for r in corpus.carried(parts, most=2).orderBy("doc_id", "seq").collect()] == ["abc", "…bc de", ""]


def test_quote_ladder(spark):
    source = "No officer shall remove the sealed register within seven days of the notice given to the owner of the vessel."
    rows = [(1, source, "remove the sealed register within seven days"), (2, source, "remove the sealed, register -- within seven days of"), (3, source, source.replace("seven", "ten")), (4, source, "wholly different words about nothing"), (5, None, "x"), (6, source, ""), (7, source, source.replace("owner of the ", ""))]
    df = spark.createDataFrame(rows, "quote_id long, source string, quote string")
    got = {r.quote_id: r for r in quotes.guarded(df, quotes.matched(df)).collect()}
    assert [got[i].tier for i in range(1, 8)] == ["exact", "normalized", "fuzzy", "none", "none", "none", "fuzzy"]
    assert got[3].status == "rejected" and got[3].guards == ["number_mismatch"] and got[3].similarity > 0.95
    assert got[1].status == got[2].status == "verified" and got[7].status == "partially_verified" and got[7].similarity >= 0.85


def test_quote_without_a_source(spark):
    df = spark.createDataFrame([(1, None, "No officer shall remove the sealed register at all"), (2, "", "No officer shall remove the sealed register at all")], "quote_id long, source string, quote string")
    got = {r.quote_id: (r.guards, r.status) for r in quotes.guarded(df, quotes.matched(df)).collect()}
    assert got == {1: (["source_unavailable"], "rejected"), 2: ([], "rejected")}


def test_near_windows_equal_brute_force():
    import math
    import random

    rng = random.Random(1)
    for _ in range(60):
        s, q = ([rng.choice("abcdef") for _ in range(rng.randrange(1, 30))] for _ in range(2))
        widths = list(dict.fromkeys(max(1, x) for x in (math.floor(len(q) * 0.8), len(q), math.ceil(len(q) * 1.2))))
        want, order = [], 0
        for w in (w for w in widths if w <= len(s)):
            order += 1
            want += [(order, i + 1, " ".join(s[i : i + w])) for i in range(len(s) - w + 1) if len(set(q) & set(s[i : i + w])) >= 0.5 * len(set(q) | set(s[i : i + w]))]
        assert list(quotes.near_windows(s, q)) == want


def test_bare_references(spark):
    acts = spark.createDataFrame([("IPC", ["Indian Penal Code"]), ("HTA", ["Harbour Tolls Act"])], "act_code string, names array<string>")
    rows = [(1, "see IPC 302 and HTA  66A."), (2, "the XIPC 302, ipc 40"), (3, None), (4, "")]
    got = {tuple(r) for r in refs.mentions(spark.createDataFrame(rows, "id long, t string"), "id", "t", acts).collect()}
    assert got == {(1, "IPC:S302"), (1, "HTA:S66A"), (2, "IPC:S40")}


def test_nearest_blocks(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    one = retrieve.nearest(vectors.where("vec_id % 5 = 0"), vectors, top=3, block=1000)
    many = retrieve.nearest(vectors.where("vec_id % 5 = 0"), vectors, top=3, block=3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_metrics_of_an_empty_log(spark):
    empty = spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    assert tuple(metrics.totals(empty).first()) == (0, 0, 0.0, 0.0, 0.0)
    assert metrics.percentiles(empty, "event_type").count() == 0


def test_seed_documents_and_run_log(spark, tmp_path):
    good = {"doc_id": "a-1", "doc_title": "A", "doc_type": "act", "provisions": [{"section": "1", "text": "x"}, {"section": "2", "text": "y"}]}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/b.json").write_text(json.dumps([{"doc_id": "j", "doc_title": "J", "doc_type": "judgment", "paragraphs": [{"para": "1", "text": "z"}]}, {"doc_id": "bad id", "doc_title": "B", "doc_type": "act"}]))
    (tmp_path / "docs/a.json").write_text(json.dumps(good))
    docs = files.seed_documents(spark, str(tmp_path / "docs"))
    kept, refused = files.checked_documents(docs)
    assert [r.doc_id for r in kept.collect()] == ["a-1", "j"] and [r.reason for r in refused.collect()] == ["bad doc_id"]
    rows = files.provisions(kept)
    assert sorted((r.doc_id, r.seq, r.text) for r in rows.collect()) == [("a-1", 0, "x"), ("a-1", 1, "y"), ("j", 0, "z")]
    files.replace_documents(rows, str(tmp_path / "out"))
    files.replace_documents(rows.where("doc_id = 'j'").withColumn("text", F.lit("new")), str(tmp_path / "out"))
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["new", "x", "y"]
    runs = spark.createDataFrame([("r1", "2024-01-01T00:00:00"), ("r1", "2024-01-02T00:00:00"), ("r2", "2024-01-01T10:00:00")], "id string, recordedAt string")
    files.append_runs(runs, str(tmp_path / "runs"))
    (tmp_path / "runs/broken.json").write_text("{not json\n")
    assert [r.recordedAt[:10] for r in files.list_runs(spark, str(tmp_path / "runs"), 2).collect()] == ["2024-01-02", "2024-01-01"]
    assert files.load_run(spark, str(tmp_path / "runs"), "r1").first().recordedAt == "2024-01-02T00:00:00"


def test_entry_without_llm():
    code = "import sys; sys.modules['attesta.llm'] = None; import attesta.queries, attesta.oracles; assert set(attesta.oracles.oracle_sql()) <= set(attesta.queries.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_overlapping_names_of_acts(spark):
    names = [("tolls act of the north", "NTA"), ("harbour tolls act", "HTA")]
    rows = spark.createDataFrame([("the Harbour Tolls Act of the North",), ("Harbour, Tolls Act",), (None,)], "t string")
    assert [r[0] for r in rows.select(refs.act_code(F.col("t"), names)).collect()] == ["NTA", "HTA", None]


def test_claim_references_fall_back(spark):
    acts = spark.createDataFrame([("HTA", "section", ["harbour tolls act", "hta"])], "act_code string, unit string, names array<string>")
    claims = spark.createDataFrame([(1, "Section 5 of the Harbour Tolls Act", "a", []), (2, "nothing", "a", []), (2, "nothing", "a", []), (3, None, "b", []), (4, "nothing", "a", ["HTA:S9"])], "id int, claim string, src string, given array<string>")
    sources = spark.createDataFrame([("a", "See section 7(2) of the Harbour Tolls Act."), ("b", None)], "src string, body string")
    got = sorted(map(tuple, refs.claim_references(claims, "id", "claim", "src", sources, "body", acts, "given").collect()))
    assert got == [(1, "HTA:S5", False), (2, "HTA:S7(2)", True), (4, "HTA:S9", False)]


def _packed(text, most):
    """Brute force: sentences one after the other."""
    text = text.strip()
    if len(text) <= most:
        return [text] if text else []
    done, held = [], ""
    for s in re.split(r"(?<=[.;:—])\s+(?=[A-Z(\d])", text):
        if held and len(held) + 1 + len(s) > most:
            done, held = [*done, held], s
        else:
            held = f"{held} {s}" if held else s
    return [p[i : i + most] for p in [*done, held] for i in range(0, len(p), most)]


def test_long_provisions_are_split(spark):
    rng = random.Random(3)
    texts = ["", "   ", None, "short", "x" * 95, "A. B. C", " Ends; and (a) so on: (b) more — 12 words. " * 9] + [" ".join(rng.choice(["word", "End.", "(a)", "So;", "Twelve:", "y" * 30]) for _ in range(rng.randrange(60))) for _ in range(40)]
    rows = spark.createDataFrame([(i, t, "H" if i % 2 else None, "clash") for i, t in enumerate(texts)], "chunk_id int, text string, heading string, part string")
    got = {}
    for r in corpus.provision_parts(rows, 40).orderBy("chunk_id", "part_no").collect():
        got.setdefault(r.chunk_id, []).append(r.part)
        head = (["H"] if r.chunk_id % 2 else []) + ([f"(continued {r.part_no + 1})"] if r.part_no else [])
        assert r.block == (f"{' '.join(head)}\n{r.part}" if head else r.part)
    assert got == {i: p for i, t in enumerate(texts) if t and (p := _packed(t, 40))}


def test_places_in_the_source(spark):
    source = "Whoever  com-\n  mits “murder”, or １,０００ oﬀences, shall be punished; and no less."
    rows = spark.createDataFrame([(1, source, 'commits "murder"'), (2, source, "murder or 1000 oﬀences shall"), (3, source, "nowhere at all"), (4, None, "x"), (5, source, "")], "quote_id int, source string, quote string")
    got = {r.quote_id: (r.tier, r.shown) for r in quotes.in_source(rows, quotes.matched(rows)).collect()}
    assert got == {1: ("exact", "com-\n  mits “murder”"), 2: ("normalized", "murder”, or １,０００ oﬀences, shall")}


def test_places_round_trip():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab AB.,-\n\t“’–०…ﬁ１İ12 §") for _ in range(rng.randrange(40)))
        for level in (1, 2):
            form, at = places.folded(text, level)
            assert len(form) == len(at) and all(x <= y for x, y in zip(at, at[1:])) and form == form.strip(" ")
            if len(form) > 4 and " " not in form[1:4]:
                a, b = places.located(text, form[1:4], level)
                assert 0 <= a < b <= len(text)


def test_quotes_elsewhere(spark):
    body = "no person shall keep more than forty barrels of lamp oil in a shed beside the quay"
    texts = [("b", f"Rule 1. {body.upper()}!"), ("a", f"{body}s and more"), ("c", "other words"), ("d", None), ("e", ""), ("b", f"Rule 1. {body.upper()}!")]
    wanted = [(1, body), (2, "keep more than forty barrels of lamp oil in a shed"), (3, "more than forty"), (4, body.replace("quay", "pier")), (5, None), (6, "incontrovertibilities unextraordinarilyx so"), (1, body)]
    long = [("f", "incontrovertibilities unextraordinarilyx sorry"), ("g", " ".join(f"w{i}" for i in range(5000)))]
    stored = spark.createDataFrame([(k, t, "clash") for k, t in texts + long], "chunk_id string, text string, q string")
    rows = spark.createDataFrame([(k, q, "clash") for k, q in wanted], "quote_id int, quote string, words string")
    assert sorted(map(tuple, quotes.elsewhere(rows, stored).collect())) == [(1, "a", 2), (2, "a", 2), (6, "f", 1)]
    assert quotes.elsewhere(rows, stored.limit(0)).count() == 0 == quotes.elsewhere(rows.limit(0), stored).count()
    full = spark.createDataFrame([(1, "nothing of it", body)], "quote_id int, source string, quote string")
    (row,) = quotes.guarded(full, quotes.matched(full), others=quotes.elsewhere(full, stored)).collect()
    assert row.guards == ["wrong_source"] and row.status == "rejected"
