import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from inkweir.llm.likeness import BITS, Likeness, codes_of, jaccard, key_rows, prefix_keys, shingles, sketch, sketched, values_of
from inkweir.llm.neardup import candidates, classes, metric_pairs, near_groups, near_pairs, records_of, representative_pairs

P = Likeness(least=20)


def plain(title, content, least=20):
    body = re.sub(r"\s", "", content or "")
    if len(body) < least:
        return None
    x = re.sub(r"\s", "", title or "") + body
    return {x[k : k + 5] for k in range(len(x) - 4)}


def corpus(n=60, seed=5):
    random.seed(seed)
    words = ["".join(chr(random.randint(0x4E00, 0x5200)) for _ in range(random.randint(2, 5))) for _ in range(400)]
    rows = []
    for _ in range(n):
        text = [random.choice(words) for _ in range(random.randint(20, 60))]
        rows.append((len(rows), random.choice([None, "", "标题"]), "".join(text)))
        for _ in range(random.randint(0, 3)):
            edited = [w if random.random() > random.choice([0, 0.05, 0.15]) else random.choice(words) for w in text]
            rows.append((len(rows), "标题", " ".join(edited)))
    rows += [(len(rows), "t", None), (len(rows) + 1, "t", ""), (len(rows) + 2, None, "短文")]
    return rows


def pairs_of(rows, t=0.6):
    sets = {i: plain(a, b) for i, a, b in rows}
    return {(i, j) for i, j in itertools.combinations(sorted(sets), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "id long, title string, content string, key int, digest string, band int")


def test_jaccard_of_hashed_sets_is_exact():
    for _, a, b in corpus(10):
        if s := plain(a, b):
            h = shingles(np.concatenate([codes_of(a), codes_of(b)]) if a else codes_of(b))
            assert len(h) == len(s)
            assert jaccard(h, h) == 1


def test_near_pairs_equal_brute_force(spark):
    rows = corpus()
    got = {tuple(r) for r in near_pairs(frame(spark, rows), "id", "title", "content", P).collect()}
    assert got == pairs_of(rows) and len(got) > 20


def crowd(seed=8):
    random.seed(seed)
    words = ["".join(chr(random.randint(0x4E00, 0x5200)) for _ in range(4)) for _ in range(60)]
    rows = []
    for c in range(3):
        base = [random.choice(words) + str(c) for _ in range(40)]
        rows += [(len(rows) + k, "", "".join(w if random.random() > 0.04 else random.choice(words) for w in base)) for k in range(25)]
    return rows


def test_large_regions_by_metric_join(spark):
    rows = crowd()
    got = {tuple(r) for r in near_pairs(frame(spark, rows), "id", "title", "content", P, block=2, leaf=8).collect()}
    assert got == pairs_of(rows)
    s = key_rows(sketched(frame(spark, rows), "id", "title", "content", P), P).withColumn("band", F.lit(0).cast("long"))
    for leaf, levels in ((5, 3), (5, 0), (1000, 3)):
        met = {tuple(r) for r in metric_pairs(records_of(frame(spark, rows), "id", "title", "content"), s, P, pivots=3, leaf=leaf, levels=levels).collect()}
        assert pairs_of(rows) <= met and len(met) < len(rows) * (len(rows) - 1) / 2


def test_keys_of_many_texts_get_longer_and_lose_no_pair(spark):
    rows = crowd(3)
    s = sketched(frame(spark, rows), "id", "title", "content", P)
    keys = np.unique(prefix_keys(values_of([r["sketch"] for r in s.collect()], P.bins), P))
    reps = {r["rep"] for r in classes(s).collect()}
    want = {(a, b) for a, b in pairs_of(rows) if a in reps and b in reps}
    for hot in (np.zeros(0, dtype=np.int64), keys[::2], keys):
        assert {tuple(r) for r in representative_pairs(records_of(frame(spark, rows), "id", "title", "content"), s, P, 3, hot).collect()} == want


def test_regions_are_reported_once(spark):
    rows = corpus(20)
    s = sketched(frame(spark, rows), "id", "title", "content", P)
    c = candidates(s, P, 256, np.zeros(0, dtype=np.int64))[0].collect()
    assert len({(r["a"], r["b"]) for r in c}) == len(c) and all(r["pivot"] <= r["a"] < r["b"] for r in c)


def test_groups_are_components(spark):
    rows = corpus(40, 9)
    got = {r["id"]: r for r in near_groups(frame(spark, rows), "id", "title", "content", P).collect()}
    assert set(got) == {i for i, *_ in rows}
    parent = {i: i for i, *_ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs_of(rows):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: r["group_id"] for i, r in got.items()} == {i: find(i) for i in parent}
    assert all(r["class_id"] <= i for i, r in got.items())


def test_long_chain_in_random_order_is_one_group(spark):
    random.seed(21)
    signs = "".join(chr(random.randint(0x4E00, 0x9F00)) for _ in range(20 * 400 + 84))
    ids = random.sample(range(10_000), 400)
    rows = [(i, "", signs[20 * k : 20 * k + 104]) for k, i in enumerate(ids)]  # each alike to the next only: 80 of 120, 60 of 140
    got = near_groups(frame(spark, rows), "id", "title", "content", P).collect()
    assert sorted(r["id"] for r in got) == sorted(ids)
    assert {r["group_id"] for r in got} == {min(ids)} and sum(r["links"] for r in got) == 2 * 399


def test_pairs_at_the_threshold_share_a_key():
    p, g, left, right = Likeness(), np.random.default_rng(1), [], []
    for _ in range(6000):
        h = g.integers(0, 1 << 64, int(np.exp(g.uniform(np.log(100), np.log(3000)))), dtype=np.uint64)
        both, rest = np.split(h, [int(np.ceil(p.threshold * len(h)))])
        mine = g.integers(0, 2, len(rest)).astype(bool)
        left.append(sketch(np.sort(np.concatenate([both, rest[mine]])), p.bins))
        right.append(sketch(np.sort(np.concatenate([both, rest[~mine]])), p.bins))
    a, b = values_of(left, p.bins), values_of(right, p.bins)
    assert (prefix_keys(a, p) == prefix_keys(b, p))[:, :, 0].any(axis=1).all()
    assert ((a == b)[:, : p.glance].mean(axis=1) >= p.sketch_floor).all()
    assert (((a ^ b) & 1).sum(axis=1) <= BITS).all()


def test_empty_table(spark):
    assert near_pairs(frame(spark, corpus(1)).limit(0), "id", "title", "content", P).count() == 0
    assert near_groups(frame(spark, corpus(1)).limit(0), "id", "title", "content", P).count() == 0
