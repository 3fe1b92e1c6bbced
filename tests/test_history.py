"""Histories against a plain loop in Python, with slices of every size."""

import random
from datetime import datetime, timedelta

import pytest

from attesta.operators import history

SCHEMA = "update_id long, doc_id string, ref_key string, row_kind string, status string, effective_from string, effective_to string, struck_down_by string, recorded_at timestamp_ntz, arrived_at timestamp_ntz, note string"
T0 = datetime(2020, 1, 1)


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = T0 + timedelta(hours=rng.randrange(60))
        key = rng.choice(["K1"] * 6 + ["K2", "K3"])
        kind = rng.choice(["snapshot", "update"])
        status = rng.choice(["In Force", "in_force", "amended ", "amended", None, ""])
        day = rng.choice(["2004-03-12", "12/03/2004", "12 March 2004", "20040312", "2005-01-01", "", None, "-" if kind == "snapshot" else None])
        out.append((i, "d", key, kind, status, day, None, rng.choice(["A  v. B", "a v. b", None]), at, at + timedelta(hours=rng.choice([0, 0, 0, 900])), "x"))
    return out + [r for r in out if rng.random() < 0.05]


def expected(data):
    best = {}
    for r in data:
        k = (r[1], r[2], r[8])
        if k not in best or r[0] > best[k][0]:
            best[k] = r
    def value(kind, name, v):
        if kind == "update" and v is None:
            return "same"
        if v is None or v.strip() in ("", "-"):
            return None
        if name == "status":
            return v.strip().lower().replace(" ", "_")
        if name == "day":
            return {"2004-03-12": "2004-03-12", "2005-01-01": "2005-01-01"}.get(v, "2004-03-12")
        return " ".join(v.lower().split())
    out, last = set(), {}
    for (d, k, at), r in sorted(best.items()):
        new = [value(r[3], n, v) for n, v in (("status", r[4]), ("day", r[5]), ("day", r[6]), ("name", r[7]))]
        old = last.get((d, k))
        state = tuple((old[i] if old else None) if x == "same" else x for i, x in enumerate(new))
        if old != state:
            out.add((d, k, at, *state))
        last[d, k] = state
    return out


def found(df):
    return {(r.doc_id, r.ref_key, r.valid_from, r.status, r.effective_from, r.effective_to, r.struck_down_by) for r in df.collect()}


@pytest.mark.parametrize("slice_rows", [1, 4, 50_000])
def test_equals_loop(spark, slice_rows):
    data = rows(150, slice_rows)
    raw = spark.createDataFrame(data, SCHEMA)
    out = history.build_history(history.changes(raw), slice_rows=slice_rows)
    assert found(out) == expected(data)
    by_key = {}
    for r in out.collect():
        by_key.setdefault(r.ref_key, []).append(r)
    for own in by_key.values():
        own.sort(key=lambda r: r.version)
        assert [r.version for r in own] == list(range(1, len(own) + 1))
        assert [r.valid_to for r in own[:-1]] == [r.valid_from for r in own[1:]] and own[-1].is_current and own[-1].valid_to is None


def test_rebuild_equals_full(spark):
    data = rows(120, 7)
    raw = spark.createDataFrame(data, SCHEMA)
    assert found(history.replayed_history(raw, late_days=10)) == expected(data)


def test_empty_and_nulls(spark):
    assert history.build_history(history.changes(spark.createDataFrame([], SCHEMA))).count() == 0
    assert history.replayed_history(spark.createDataFrame([], SCHEMA)).count() == 0
    lost = [(1, None, "K", "update", "x", None, None, None, T0, T0, "")]
    assert history.replayed_history(spark.createDataFrame(lost, SCHEMA)).count() == 0
    odd = [(None, "d", "K", "snapshot", None, None, None, None, T0, None, None), (1, None, "K", "update", "x", None, None, None, T0, T0, ""), (2, "d", "K", None, "x", None, None, None, None, T0, "")]
    out = history.build_history(history.changes(spark.createDataFrame(odd, SCHEMA))).collect()
    assert [(r.doc_id, r.ref_key, r.status) for r in out] == [("d", "K", None)]


def test_chain_store(spark, tmp_path):
    store = history.ChainStore(spark, str(tmp_path / "chains"), buckets=4)
    assert store.read() is None
    data = rows(80, 3)
    raw = spark.createDataFrame(data, SCHEMA)
    early = spark.createDataFrame([r for r in data if r[9] < T0 + timedelta(days=5)], SCHEMA)
    late = spark.createDataFrame([r for r in data if r[9] >= T0 + timedelta(days=5)], SCHEMA)
    store.commit(history.build_history(history.changes(early)))
    before = found(store.read())
    touched = late.select("doc_id", "ref_key").distinct()
    anew = history.build_history(history.changes(raw).join(touched, ["doc_id", "ref_key"], "left_semi"))
    store.commit(anew, touched)
    assert found(store.read()) == expected(data) != before


def test_chain_store_drops_a_chain(spark, tmp_path):
    store = history.ChainStore(spark, str(tmp_path / "chains"), buckets=4)
    data = [r for r in rows(60, 9) if r[2] in ("K1", "K2")]
    store.commit(history.build_history(history.changes(spark.createDataFrame(data, SCHEMA))))
    for gone in ("K1", "K2"):
        touched = spark.createDataFrame([("d", gone)], "doc_id string, ref_key string")
        store.commit(store.read().limit(0), touched)
        left = store.read()
        assert gone not in {r.ref_key for r in left.collect()} if left is not None else gone == "K2"
    assert store.read() is None


def test_change_log_reads_only_the_touched(spark, tmp_path):
    log = history.ChangeLog(spark, str(tmp_path / "raw"), buckets=8)
    data = rows(100, 4) + [(9999, None, "K1", "update", "x", None, None, None, T0, T0, "")]
    for part in (data[:60], data[60:]):
        log.append(spark.createDataFrame(part, SCHEMA))
    got = log.of(spark.createDataFrame([("d", "K2"), ("d", "K9")], "doc_id string, ref_key string"))
    assert sorted(r.update_id for r in got.collect()) == sorted(r[0] for r in data if r[2] == "K2" and r[1])


def test_as_of(spark):
    data = rows(80, 6)
    chains = history.build_history(history.changes(spark.createDataFrame(data, SCHEMA)))
    moment = T0 + timedelta(hours=30)
    from pyspark.sql import functions as F

    got = history.history_as_of(chains, F.lit(moment))
    last = {}
    for v in sorted(expected(data)):
        if v[2] <= moment:
            last[v[:2]] = v
    assert found(got) == set(last.values())
