import random
import re

import numpy as np

from inkweir.llm import intake as N
from inkweir.llm.likeness import Likeness
from inkweir.llm.skeletons import skeleton_of
from tests.llm.test_likeness import corpus, plain

P = Likeness(least=20)
COLUMNS = "title string, content string, wenhao string, policy_key string, band int, sketch string"


def tables(spark, seed=2):
    random.seed(seed)
    rows = corpus(30, seed)
    accepted = [(i, t, c, random.choice([None, "", f"甲〔2025〕{i % 9}号"]), f"k{i}", 1, "x") for i, t, c in rows[::2]]
    fresh = [(100 + i, random.randint(1, 3), t, c, random.choice([None, f"甲［2025］{i % 9} 号"]), random.choice([None, f"ｋ{i}"]), 1, "x") for i, t, c in rows[1::2]]
    fresh += [(300, 2, "新", accepted[0][2], None, None, 1, "x"), (301, 1, None, None, None, None, 1, "x"), (302, 3, "", " ", "", "", 1, "x"), (303, 3, "", " ", "", "", 1, "x")]
    random.shuffle(fresh)
    a = spark.createDataFrame(accepted, "id long, " + COLUMNS)
    b = spark.createDataFrame(fresh, "cand_id long, batch_no int, " + COLUMNS)
    return accepted, fresh, a, b


def brute(accepted, fresh):
    bare = lambda c: re.sub(r"\s", "", c or "")
    mark = lambda x: skeleton_of(x, True) if x else ""
    known = [(bare(c), plain(t, c), mark(w), mark(k)) for _, t, c, w, k, *_ in accepted]
    out = {}
    for i, b, t, c, w, k, *_ in sorted(fresh, key=lambda r: (r[1], r[0])):
        me = (bare(c), plain(t, c), mark(w), mark(k))
        if me[0] and any(me[0] == x[0] for x in known):
            out[i] = "exact"
        elif me[1] and any(x[1] and len(me[1] & x[1]) >= 0.6 * len(me[1] | x[1]) for x in known):
            out[i] = "near"
        elif any((me[2] and me[2] == x[2]) or (me[3] and me[3] == x[3]) for x in known):
            out[i] = "key"
        known.append(me)
    return out


def test_equals_brute_force(spark):
    accepted, fresh, a, b = tables(spark)
    got = {r["cand_id"]: r["kind"] for r in N.repeated_candidates(a, b, p=P).collect()}
    want = brute(accepted, fresh)
    assert got == want and set(want.values()) == {"exact", "near", "key"}


def test_few_witnesses_and_short_windows_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "WITNESSES", 1)
    monkeypatch.setattr(N, "PREVIOUS", 1)
    monkeypatch.setattr(N, "FIRST", 1)
    monkeypatch.setattr(N, "GROUPS", 2)
    accepted, fresh, a, b = tables(spark, 6)
    got = {r["cand_id"]: r["kind"] for r in N.repeated_candidates(a, b, p=P, waves=1).collect()}
    assert got == brute(accepted, fresh)


def test_store_grows_by_batches_and_is_enough(spark, monkeypatch):
    monkeypatch.setattr(N, "FAN", 2)
    accepted, fresh, a, b = tables(spark, 4)
    store = N.FingerprintStore(spark, partitions=4, p=P)
    store.absorb(store.stage(N.history_rows(a, "id")))
    got = {}
    for no in (1, 2, 3):
        # Reopened by another object, without the accepted records: the store has all that is needed.
        store.close()
        store = N.FingerprintStore(spark, store.folder, store.partitions, P)
        got |= {r["cand_id"]: r["kind"] for r in N.repeated_candidates(None, b.where(f"batch_no = {no}"), store=store, p=P, waves=1).collect()}
    assert got == brute(accepted, fresh)
    assert store.segments() == ["00000000-00000003-16"]  # merged twice by two, then once
    store.drop()
    assert not store.segments()


def test_a_batch_reads_only_the_buckets_of_its_keys(spark):
    _, _, a, _ = tables(spark, 4)
    store = N.FingerprintStore(spark, partitions=64, p=P)
    store.absorb(store.stage(N.history_rows(a, "id")))
    segment = store.segments()[0]
    one = spark.createDataFrame(store._read("postings", segment).limit(1).collect(), "band long, nth int, doc long, loc long, s1 long, s2 long")
    met = store.met("postings", segment, one, "band")
    assert len(met.inputFiles()) == 1 and met.join(one, "band", "left_semi").count() >= 1
    assert len(store._read("postings", segment).inputFiles()) > 32
    places = [r["loc"] for r in one.collect()]
    assert {r["loc"] for r in store.records(locs=places).select("loc").distinct().collect()} == set(places)
    store.drop()


def test_bloom_has_no_false_negatives():
    g = np.random.Generator(np.random.PCG64(1))
    keys, others = g.integers(-(2**62), 2**62, 5000), g.integers(-(2**62), 2**62, 5000)
    f = N.bloom(keys)
    assert N.may_hold([f], keys).all() and N.may_hold([f], others).mean() < 0.05
    assert not N.may_hold([], keys).any()


def test_empty_tables(spark):
    _, fresh, a, b = tables(spark)
    assert N.repeated_candidates(a, b.limit(0), p=P, waves=1).count() == 0
    got = {r["cand_id"]: r["kind"] for r in N.repeated_candidates(a.limit(0), b, p=P, waves=1).collect()}
    assert got == brute([], fresh)


def test_one_text_in_a_third_of_the_batch(spark):
    random.seed(1)
    base = [chr(0x4E00 + random.randint(0, 300)) for _ in range(120)]
    rows = []
    for i in range(300):
        own = [c if random.random() > 0.01 else "改" for c in base] if i % 3 == 0 else [chr(0x5200 + random.randint(0, 3000)) for _ in range(120)]
        rows.append((i, 1, "t", "".join(own), None, None, 1, "x"))
    fresh = spark.createDataFrame(rows, "cand_id long, batch_no int, " + COLUMNS)
    accepted = spark.createDataFrame([(1, "t", "".join(base), None, None, 1, "x")], "id long, " + COLUMNS)
    got = {r["cand_id"]: r["kind"] for r in N.repeated_candidates(accepted, fresh, p=P, waves=1).collect()}
    assert got == brute([(1, "t", "".join(base), None, None)], rows)
