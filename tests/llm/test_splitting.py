import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkweir.llm.splitting import HARD, Limits, cuts, oversized, pieces, stops

SMALL = Limits(60, 12, 5)


def check(text, limits):
    got = cuts(text, limits)
    assert "".join(text[a + o : b] for a, b, o, _ in got) == text
    assert all(b - a <= limits.size for a, b, _, _ in got)
    assert all(1 <= o <= limits.overlap for _, _, o, _ in got[1:]) and got[0][2] == 0
    for (a, b, _, _), (c, _, o, _) in zip(got, got[1:]):
        assert c == b - o and c >= a
    return got


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 。，\n.！中文", max_size=400))
def test_pieces_cover_the_text(text):
    check(text, SMALL)


def test_cuts_at_sentences_and_marks_forced_ones():
    text = "这是一个句子，内容不长。" * 30
    assert all(k < HARD for *_, k in check(text, SMALL))
    assert all(text[b - 1] == "。" for _, b, _, _ in cuts(text, SMALL))
    assert any(k == HARD for *_, k in check("字" * 300, SMALL))


def test_no_cheaper_chain_exists():
    text = "甲。" * 45
    assert len(cuts(text, SMALL)) == 2  # 90 characters need two pieces and get no more


def test_long_text_and_default_limits():
    random.seed(1)
    text = "".join(random.choice(["句子，", "完了。", "\n", "word ", "x" * 50]) for _ in range(20000))
    check(text, Limits())
    check("e\u0301" * 3000, Limits())
    check("\u0301" * 3000, Limits(20, 19, 50))


def longest(text):
    return stops(text)[1]


def test_longest_stretch():
    assert longest("") == 0
    assert longest("ab。cde\r\nf") == 3
    assert longest("ab. cd.ef") == len(" cd.ef")
    with pytest.raises(ValueError):
        Limits(10, 10)


def test_operator(spark):
    rows = [(1, "短"), (2, None), (3, ""), (4, "字" * 2001), (5, "句子。" * 700), (5, "句子。" * 700)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id long, body string, text string, pieces int")
    assert {tuple(r) for r in oversized(df, "id", "body").collect()} == {(4, "unbroken"), (5, "splittable")}
    p = pieces(df.dropDuplicates(["id"]), ["id"], "body").orderBy("id", "piece_no").collect()
    assert {r["id"] for r in p} == {1, 3, 4, 5}
    for i, t in dict(rows).items():
        if t is not None:
            own = [r for r in p if r["id"] == i]
            assert "".join(r["piece"][r["overlap"] :] for r in own) == t and [r["piece_no"] for r in own] == list(range(1, len(own) + 1))
    assert pieces(df.limit(0), ["id"], "body").count() == 0
