"""The training-data operators against brute force on small tables, with nulls, empty texts, repeats and extra columns."""

import random


import pytest
from pyspark.sql import functions as F

from attesta.llm import langid, leak, lookalike, mix, neardup, spans, split

PLAIN = "The officer shall keep the sealed register at the harbour for nine weeks after the notice"
SCHEMA = "id long, text string"


def texts_of(spark, rows):
    return spark.createDataFrame(list(rows), SCHEMA)


# 1


def test_fold():
    assert lookalike.fold("Ｔｈｅ　ﬁsh\u200b cafe\u0301 ") == "The fish café"
    assert lookalike.fold("x¹ “q” ½") == "x¹ “q” ½" and lookalike.fold("") == "" and lookalike.fold(" \u00a0\n") == ""


def test_repairs_are_script_aware():
    assert lookalike.repairs("The соpe of lаw") == {"соpe": "cope", "lаw": "law"}
    assert lookalike.repairs("Привет, сор") == {} and lookalike.repairs("Привет, cop") == {"cop": "сор"} and lookalike.repairs("plain") == {}


def test_same_look_form(spark):
    rows = [(1, PLAIN), (2, PLAIN.replace("o", "о")), (3, PLAIN.replace("sealed", "ѕеаled")), (4, "Zаqx stands alone"), (5, None), (6, ""), (7, " "), (1, PLAIN), (8, PLAIN.upper())]
    df = texts_of(spark, rows).withColumn("word", F.lit("w")).withColumn("fixed", F.lit("f"))
    got = lookalike.same_look_form(df).collect()
    form = {r.id: r.canonical for r in got}
    assert len(got) == len(rows) and form[1] == form[2] == form[3] == PLAIN and form[4] == "Zаqx stands alone" and form[5] is None and form[6] == form[7] == "" and form[8] != form[1]
    with pytest.raises(ValueError):
        lookalike.same_look_form(df, out="word")
    assert lookalike.same_look_form(texts_of(spark, [])).count() == 0


def test_same_look_pairs(spark):
    rows = [("a", 1, PLAIN), ("a", 2, PLAIN.replace("o", "о")), ("a", 3, PLAIN), ("b", 4, PLAIN), ("a", 1, PLAIN), ("a", 5, None), ("a", 6, ""), ("a", 7, " "), ("a", 8, PLAIN.replace("e", "е"))]
    df = spark.createDataFrame(rows, "tab string, key long, text string")
    got = {tuple(r)[1:] for r in lookalike.same_look_pairs(df, "key", "text", "tab").collect()}
    assert got == {(1, 2), (2, 3), (6, 7), (1, 8), (3, 8), (2, 8)}


# 3


@pytest.mark.parametrize("hot,fan", [(64, 4), (1, 2)])
def test_shared_spans_equal_brute_force(spark, hot, fan):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(i, base[(s := rng.randrange(500)) : s + rng.randrange(30, 200)] + "".join(rng.choice("xyzw") for _ in range(100))) for i in range(40)]
    rows += [(100, "a" * 400), (101, "b" + "a" * 130), (102, "a" * 119), (103, ""), (104, None), (105, rows[0][1]), (0, rows[0][1]), (106, "é" + base[100:219]), (107, base[100:219] + "é")]
    df = texts_of(spark, rows)
    parts = [spans.parts_of(df.where("id % 3 = 0"), "id", ["text"]), spans.parts_of(df.where("id % 3 = 1"), "id", ["text"]), spans.parts_of(df.where("id % 3 = 2"), "id", ["text"])]
    matches, members = spans.shared_matches(parts, spark, hot=hot, fan=fan)
    got = {(r.rec_a, r.rec_b) for r in spans.record_pairs(matches, members).collect()}
    grams = {str(i): {t[k : k + 120] for k in range(len(t) - 119)} for i, t in rows if t}
    keys = sorted(grams)
    assert got == {(a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if grams[a] & grams[b]}
    cover = {r.rec: r.shared_chars for r in spans.shared_cover(matches, members, parts[0].unionByName(parts[1]).unionByName(parts[2])).collect()}
    for i, t in dict(rows).items():
        if t and len(t) >= 120:
            held = {p for k in range(len(t) - 119) if any(t[k : k + 120] in g for j, g in grams.items() if j != str(i)) for p in range(k, k + 120)}
            assert cover[str(i)] == len(held)


def test_index_opens_again(spark, tmp_path):
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(150))
    lots = [texts_of(spark, [(i, f"{i}" * 40 + shared + f"{i + 1}" * 40), (i + 10, shared[:119] + "#@%!"[i] * 9)]) for i in range(4)]
    lots = [d.select(spans.text_id(F.col("text")).alias("tid"), "text") for d in lots]
    index = spans.SpanIndex(spark, fan=2, path=str(tmp_path / "index"))
    for d in lots[:3]:
        index.add(d)
        index.compact()
    for _, run, texts in index.runs:
        spark.sql(f"DROP TABLE {run}")
        spark.sql(f"DROP TABLE {texts}")
    again = spans.SpanIndex.opened(spark, index.path)
    assert again.runs == index.runs and again.buckets == index.buckets and sorted(r[0] for r in again.runs) == [0, 1]
    found = [r for r in again.add(lots[3]).collect() if r.tid_b]
    new = lots[3].first().tid
    assert len(found) == 3 and all(r.end_a - r.start_a == 150 and new in (r.tid_a, r.tid_b) for r in found)
    assert again.add(lots[3]).count() == 0
    tables = {p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("spans_")}
    assert tables == {n for r in again.runs for n in r[1:]}


@pytest.mark.parametrize("hot", [64, 1])
def test_shared_cover_is_per_record(spark, hot):
    rng = random.Random(8)
    own, both, rest = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (300, 200, 250))
    quotes = [("q1", "x" * 30 + own, own[50:250]), ("q2", rest + both, "y" * 40), ("q3", both, both), ("q4", "z" + own[:130], None), ("q5", rest[:200], rest[:200])]
    df = spark.createDataFrame(quotes, "id string, source string, quote string")
    parts = [spans.parts_of(df.where("id < 'q3'"), "id", ["source", "quote"]), spans.parts_of(df.where("id >= 'q3'"), "id", ["source", "quote"])]
    matches, members = spans.shared_matches(parts, spark, hot=hot)
    texts = parts[0].unionByName(parts[1])
    fields = {(r, f): t for r, *ts in quotes for f, t in zip(("source", "quote"), ts) if t and len(t) >= 120}
    held = {}
    for (r, _), t in fields.items():
        for k in range(len(t) - 119):
            held.setdefault(t[k : k + 120], set()).add(r)
    want = {}
    for (r, f), t in fields.items():
        want[r, f] = {p for k in range(len(t) - 119) if held[t[k : k + 120]] != {r} for p in range(k, k + 120)}
    assert 0 < len(want["q1", "source"]) < 200 and len(want["q1", "quote"]) == 0
    assert {(r.rec, r.field): r.shared_chars for r in spans.shared_cover(matches, members, texts).collect()} == {k: len(v) for k, v in want.items()}
    got = {}
    for r in spans.shared_passages(matches, members, texts).collect():
        got.setdefault((r.rec, r.field), set()).update(range(r.start, r.end))
    assert got == {k: v for k, v in want.items() if v}


# 4


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    rows = []
    for g in range(25):
        own = [rng.choice(vocabulary) for _ in range(60)]
        for k in range(3):
            rows.append((10 * g + k, " ".join(rng.choice(vocabulary) if rng.random() < 0.03 * k else w for w in own)))
    rows += [(900, rows[0][1].upper() + "  "), (901, ""), (902, " "), (903, None), (904, "abc"), (905, "abc"), rows[0]]
    sets = {i: set(neardup.shingles(" ".join(t.lower().split())).tolist()) for i, t in rows if t is not None}
    keys = sorted(sets)
    want = {(a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    links, members = neardup.near_duplicates(texts_of(spark, rows), "id", "text")
    assert {tuple(r) for r in neardup.pairs_of_records(links, members).collect()} == want
    groups = {r.rec: r.class_id for r in neardup.groups_of_records(links, members).collect()}
    assert len(groups) == len(keys) and all(groups[a] == groups[b] for a, b in want)
    few = neardup.similar_texts(texts_of(spark, rows).where("text != ''").select(F.md5("text").alias("tid"), neardup.normalised(F.col("text")).alias("text")).dropDuplicates(["text"]), block=2)
    assert few.count() == links.count()


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(1)
    sigs = [rng.getrandbits(64) for _ in range(200)]
    sigs += [s ^ (1 << rng.randrange(64)) for s in sigs]
    tree = neardup.BKTree()
    for i, s in enumerate(sigs):
        tree.add(s, i)
    for s in sigs[:20]:
        assert set(tree.search(s, 6)) == {i for i, x in enumerate(sigs) if (x ^ s).bit_count() <= 6}


# 5


def test_pieces_keep_their_promises():
    rng = random.Random(4)
    cases = ["", "short", "x" * 5000, "word " * 900, "Sentence one is here. " * 200, "\n".join("Clause; and so on, " * 9 for _ in range(30)), "é\u0301" * 1500]
    cases += ["".join(rng.choice("ab .,;\n") for _ in range(rng.randrange(1000, 4000))) for _ in range(20)]
    for t in cases:
        out = split.pieces(t, split.Sizes())
        assert "".join(t[b:c] for _, b, c in out) == t
        assert all(c - a <= 1200 and 0 <= b - a <= 150 for a, b, c in out)
    for a, b, c in split.pieces(cases[4], split.Sizes())[:-1]:
        assert cases[4][c - 1] == "."


def test_edits_stay_local():
    rng = random.Random(9)
    t = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", "", ",", "."]) for _ in range(4000))
    u = t[:9000] + "new words " + t[9000:]
    old, new = ({x[a:c] for a, _, c in split.pieces(x, split.Sizes())} for x in (t, u))
    assert len(new - old) <= 6 < len(new)


def test_split_texts(spark):
    df = texts_of(spark, [(1, "a b " * 800), (2, "x"), (3, None), (4, ""), (2, "x")])
    out = split.split_texts(df).collect()
    assert sorted((r.id, r.piece_count) for r in out if r.id != 1) == [(2, 1), (2, 1), (3, None), (4, 1)]
    assert all(r.piece_text == ("a b " * 800)[r.piece_start : r.piece_end] for r in out if r.id == 1) and sum(r.id == 1 for r in out) > 2
    with pytest.raises(ValueError):
        split.split_texts(df.withColumn("piece_no", F.lit(1)))


# 6


def edit_distance_ends(p, t, k):
    row = list(range(len(p) + 1))
    out = []
    for j, w in enumerate(t):
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[-1] <= k:
            out.append((j + 1, row[-1]))
    return out


def test_myers():
    rng = random.Random(3)
    for _ in range(200):
        p, t = [rng.randrange(4) for _ in range(rng.randrange(1, 15))], [rng.randrange(4) for _ in range(30)]
        assert leak.myers_ends(p, t, 4) == edit_distance_ends(p, t, 4)


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_leaks_equal_brute_force(spark, errors):
    rng = random.Random(errors)
    pick = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    items = [(i, pick(rng.randrange(5, 40))) for i in range(12)]
    docs = []
    for d in range(40):
        words = pick(30)
        own = rng.choice(items)[1]
        s = rng.randrange(max(1, len(own) - 10))
        part = list(own[s : s + rng.randrange(9, 20)])
        if part and rng.random() < 0.5:
            part[rng.randrange(len(part))] = "changed"
        docs.append((d, " ".join(words + part + pick(5))))
    rows = [*docs, (90, ""), (91, None), docs[0]]
    left = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(98, ""), (99, None)], "item long, passage string")
    got = {(r.id, r.item) for r in leak.leaked_items(texts_of(spark, rows), "id", "text", left, "item", "passage", errors=errors).collect()}
    want = {(d, i) for d, t in docs for i, w in items if any(edit_distance_ends(w[s : s + 13], t.split(), errors) for s in range(len(w) - 12))}
    # Items shorter than a passage count as a whole, unchanged.
    whole = {(d, i) for d, t in docs for i, w in items if len(w) < 13 and f" {' '.join(w)} " in f" {t} "}
    assert whole and got == want | whole


def test_short_items(spark):
    docs = [(1, "the fee is five coins"), (2, "Five coins"), (3, "five"), (4, "coins five"), (5, ""), (6, None)]
    items = spark.createDataFrame([(1, "five coins"), (2, "Five  coins!"), (3, "..."), (4, "the fee is five coins a day")], "item long, passage string")
    got = sorted(map(tuple, leak.leaked_items(texts_of(spark, docs), "id", "text", items, "item", "passage").collect()))
    assert got == [(d, i, 0, 2) for d in (1, 2) for i in (1, 2)]


def test_words():
    assert leak.words("The “Licence-holder’s” Ｆee, ﬁve (5)! ... é") == ["the", "licenceholders", "fee", "five", "5", "é"]


# 7


def test_flow_prefers_unused_documents():
    flow = mix.least_cost_flow({("a",): 100, ("a", "b"): 50, ("b",): 10, (): 30}, {"a": 120, "b": 60}, {"a": 2, "b": 3})
    per = {s: sum(n for (_, x), n in flow.items() if x == s) for s in "ab"}
    assert per == {"a": 120, "b": 60}
    assert flow[("a", "b"), "b"] <= 150 and flow.get((("a",), "a"), 0) >= 100


def test_held_quotas():
    patterns = {("a",): 100, ("a", "b"): 50, ("b",): 10, (): 30}
    repeats = {"a": 2, "b": 1, "c": 4, "d": 0}
    assert mix.held_quotas(patterns, {"a": 100, "b": 60, "c": 7, "d": 7}, repeats) == {"a": 100, "b": 60, "c": 7, "d": 7}
    held = mix.held_quotas(patterns, {"a": 1000, "b": 1000, "c": 7, "d": 0}, repeats)
    assert held["a"] == held["b"] == 60 and held["c"] == 7
    rng = random.Random(2)
    for _ in range(30):
        quotas = {s: rng.randrange(1, 400) for s in "ab"}
        held = mix.held_quotas(patterns, quotas, repeats)
        flow = mix.least_cost_flow(patterns, held, repeats)
        assert sum(flow.values()) == sum(held.values()) and abs(held["a"] * quotas["b"] - held["b"] * quotas["a"]) <= sum(quotas.values())
        more = {s: held[s] + 2 + q // 100 for s, q in quotas.items()}
        assert held == quotas or sum(mix.least_cost_flow(patterns, more, repeats).values()) < sum(more.values())
    assert mix.held_quotas({}, {"a": 5}, {"a": 1}) == {"a": 5}


def test_mix(spark):
    rows = [(i, f"word{i} " * (5 + i % 7), ["Big", "big ", "small"][i % 3] if i < 60 else None) for i in range(70)] + [(100, "shared text of both", "small"), (101, "shared text of both", "big"), (102, None, "big"), (103, "", "big")]
    docs = spark.createDataFrame(rows, "id long, text string, source string")
    targets = spark.createDataFrame([("p", "big", 1.0, 1, 0.5), ("p", "SMALL", 1.0, 2, 0.5), ("p", "none", 0.5, 3, 0.5)], "plan string, source string, target_share double, max_repeats int, size_factor double")
    sized = mix.sized_documents(docs, "id", "text", "source")
    arcs = mix.allotments(sized, targets)
    chosen = mix.selected_documents(sized, arcs)
    shares = {r.source: r for r in mix.reached_shares(chosen, arcs).collect()}
    assert shares["none"].tokens == 0 and shares["small"].most_uses <= 2 and shares["big"].most_uses <= 1
    assert abs(shares["big"].tokens - shares["big"].quota) < 40 and abs(shares["small"].tokens - shares["small"].quota) < 40
    assert chosen.groupBy("source", "doc").count().where("count > 1").isEmpty()


# 8


def test_languages(spark):
    en = "The officer shall keep the register and pay the owner of the vessel within nine days. "
    de = "Der Beamte muss das Verzeichnis führen und dem Eigentümer des Schiffes binnen neun Tagen zahlen. "
    fr = "Le greffier doit garder le registre et payer le propriétaire du navire dans les neuf jours. "
    docs = [(i, (en, de, fr)[i % 3] * (2 + i % 2), ("en-GB", "German", "fra")[i % 3]) for i in range(30)]
    docs += [(50, en, None), (51, de, "en"), (52, en + de + en, "en"), (53, "", "en"), (54, None, "fr"), (55, "12 34", "und"), (56, fr, "xx")]
    df = spark.createDataFrame(docs, "id long, text string, lang string")
    model = langid.train(df, "id", "text", "lang")
    got = {r.id: (r.verdict, r.langs) for r in langid.document_languages(df, "id", "text", "lang", model).collect()}
    assert all(got[i][0] == "fine" for i in range(30))
    assert got[50] == ("missing", ["en"]) and got[51] == ("wrong", ["de"]) and got[52] == ("mixed", ["de", "en"]) and got[56] == ("wrong", ["fr"])
    assert got[53][0] == got[54][0] == got[55][0] == "empty"
    parts = langid.language_segments(df.where("id = 52"), "id", "text", model).orderBy("seg_no").collect()
    assert [p.seg_lang for p in parts] == ["en", "de", "en"] and (parts[0].seg_start, parts[-1].seg_end) == (0, len(en + de + en)) and all(0.5 < p.confidence <= 1 for p in parts)
    with pytest.raises(ValueError):
        langid.train(df.where("id > 1000"), "id", "text", "lang")


def test_forward_sums_all_segmentations():
    number = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁a": 5}
    model = langid.fit([{"ab": 1} if i == 0 else {} for i in range(len(langid.MODELS))], number, 0)
    p = model.prob[1][0]
    ways = p**3 + p**2 + p**2  # ▁ a b, ▁ ab, ▁a b
    assert abs(2.718281828459045 ** model.score("ab")[0] - ways) < 1e-12


def test_label_codes(spark):
    df = spark.createDataFrame([(x,) for x in ("EN", "en-IN", "en_GB", "Hindi", "mar", " pt-BR ", "ger", "und", "", None, "xx")], "l string")
    assert [r[0] for r in df.select(langid.label_code(F.col("l"))).collect()] == ["en", "en", "en", "hi", "mr", "pt", "de", None, None, None, None]
