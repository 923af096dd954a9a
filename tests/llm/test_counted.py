"""What p6 counts is counted over the whole history, and what reaches the driver is bounded."""

from collections import Counter

from inkweir.llm import intake as N
from inkweir.llm.likeness import crowded_keys, prefix_keys, sketched, values_of
from tests.llm.test_intake import P, brute, tables
from tests.llm.test_likeness import crowd, frame


def test_crowded_keys_are_those_of_all_texts(spark):
    s = sketched(frame(spark, crowd(6)), "id", "title", "content", P)
    held = Counter(prefix_keys(values_of([r["sketch"] for r in s.collect()], P.bins), P)[:, :, 0].ravel().tolist())
    for most in (1, 7, 20, 25):
        assert {r["key"] for r in crowded_keys(s.repartition(5), P, most).collect()} == {k for k, n in held.items() if n > most}


def test_filters_stay_off_the_driver_and_longer_keys_lose_nothing(spark, monkeypatch):
    assert N.BROADCAST <= 4 << 20
    monkeypatch.setattr(N, "BROADCAST", 0)
    monkeypatch.setattr(N, "LEAST", 2)
    accepted, fresh, a, b = tables(spark, 7)
    got = {r["cand_id"]: r["kind"] for r in N.repeated_candidates(a, b, p=P, waves=1).collect()}
    assert got == brute(accepted, fresh)
