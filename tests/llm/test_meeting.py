"""Pairs that meet in a key: compared by their signs in the task that has them."""

import random

import numpy as np
import pandas as pd

from inkweir.llm.likeness import APART, BITS, SIGNS, Likeness, alike_rows, prefix_keys, signs_of, sketched, whole_groups
from inkweir.llm.neardup import BLOCK, candidates, near_pairs
from tests.llm.test_likeness import P, crowd, frame, pairs_of

NONE = np.zeros(0, dtype=np.int64)


def test_alike_rows_equal_brute_force():
    g = np.random.default_rng(3)
    group = np.repeat(np.arange(30), g.integers(1, 40, 30))
    base = g.integers(0, 1 << 16, (30, 128))
    values = np.where(g.random((len(group), 128)) < g.choice([0.2, 0.4, 0.6], (len(group), 1)), g.integers(0, 1 << 16, (len(group), 128)), base[group])
    near = lambda a, b: ((a ^ b) & 1).sum() <= BITS and (((a ^ b) & 3) != 0).sum() <= APART
    want = {(i, j) for i in range(len(group)) for j in range(i + 1, len(group)) if group[i] == group[j] and near(values[i], values[j])}
    for small, cells in ((64, 1 << 18), (2, 1), (2, 50)):
        got = list(zip(*(x.tolist() for x in alike_rows(group, signs_of(values), small, cells))))
        assert len(got) == len(set(got)) and set(got) == want
    assert 0 < len(want) < sum(n * (n - 1) // 2 for n in np.bincount(group))


def test_whole_groups_over_batches():
    keys = np.repeat([1, 2, 3, 4, 5, 6], [3, 9, 1, 12, 2, 8])
    for step in (1, 2, 5, 100):
        frames = list(whole_groups((pd.DataFrame({"k": keys[x : x + step], "at": range(x, min(x + step, len(keys)))}) for x in range(0, len(keys), step)), "k", 4))
        assert sorted(i for f, _ in frames for i in f["at"]) == list(range(len(keys)))
        whole = [set(f["k"]) for f, crowded in frames if not crowded]
        assert set().union(*whole) == {1, 3, 5} and sum(map(len, whole)) == 3
        assert all(set(f["k"]) <= {2, 4, 6} for f, crowded in frames if crowded)
    assert not list(whole_groups(iter([pd.DataFrame({"k": []})]), "k", 4))


def test_texts_of_a_shared_passage_are_no_candidates(spark):
    random.seed(4)
    sign = lambda n: "".join(chr(random.randint(0x4E00, 0x9F00)) for _ in range(n))
    shared = sign(120)
    rows = [(i, "", shared + sign(280)) for i in range(200)]
    rows.append((200, "", rows[0][2][:-20]))
    s = sketched(frame(spark, rows), "id", "title", "content", P)
    met, crowded = candidates(s, P, BLOCK, NONE)
    assert met.count() < 300 and crowded.count() == 0
    assert [tuple(r) for r in near_pairs(frame(spark, rows), "id", "title", "content", P).collect()] == [(0, 200)]


def test_crowded_keys_are_counted_exactly(spark):
    rows = crowd(5)
    s = sketched(frame(spark, rows), "id", "title", "content", P)
    assert set(candidates(s, P, 2, NONE)[1].columns) == {"key", *SIGNS, "band"}
    assert candidates(s, P, 2, NONE)[1].count() > 0 and candidates(s, P, 75, NONE)[1].count() == 0
    for block in (2, 6, 75):
        got = {tuple(r) for r in near_pairs(frame(spark, rows), "id", "title", "content", P, block=block, leaf=8).collect()}
        assert got == pairs_of(rows)


def test_no_text_meets_itself():
    keys = prefix_keys(np.random.default_rng(5).integers(0, 1 << 16, (100_000, 128), dtype=np.uint16), Likeness())
    own = np.sort(keys[:, :, 0], axis=1)
    assert (own[:, 1:] != own[:, :-1]).all()
