import os
import random

import pytest

from inkweir.llm import tokens as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary files here")
AL = "a' sStTrevedLlmM0１ \n\t　。,-'mé́​人😀\xa0\r\x85<|endoftext|>²Ⅷ"


def texts():
    random.seed(7)
    return ["", None, " ", "  \n x", "don't we'll I'M 's", "<|endoftext|>", "字" * 5000, *("".join(random.choice(AL) for _ in range(random.randint(0, 40))) for _ in range(20000))]


def test_equals_the_public_tokenizer():
    tk = pytest.importorskip("tokenizers").Tokenizer.from_file(K.VOCABULARY.replace(".tiktoken", ".json"))
    tk.encode_special_tokens = True
    own = texts()
    want = [e.ids for e in tk.encode_batch([t or "" for t in own], add_special_tokens=False)]
    assert K.Encoder().encode(own) == want
    assert K.Encoder(cache=50).encode(own[:500]) == want[:500]


def test_round_trip_and_plain_merging():
    e = K.Encoder()
    for t in texts()[:2000]:
        ids = e.encode([t])[0]
        assert e.decode(ids) == (t or "")
    for piece in ("hello", " world", "人民政府", "😀"):
        assert e.merge(piece.encode()) == e._merge(piece)


def test_spans_cover_the_text():
    e = K.Encoder()
    for t in texts()[:2000]:
        ids, starts, ends = e.spans(t)
        assert ids == e.encode([t])[0] and len(ids) == len(starts) == len(ends)
        if ids:
            assert starts[0] == 0 and ends[-1] == len(t) and all(a <= b for a, b in zip(starts, starts[1:])) and all(b >= c - 1 for b, c in zip(ends, starts[1:]))


def test_operator(spark):
    own = [(i, t, "x") for i, t in enumerate(texts()[:50])] + [(0, "", "x")]
    df = spark.createDataFrame(own, "doc_id long, text string, ids string")
    got = K.encode_corpus(df, "doc_id", "text").collect()
    want = K.Encoder().encode([t for _, t, _ in own])
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got) == sorted((i, tuple(w)) for (i, _, _), w in zip(own, want))
    first = df.select("doc_id", K.token_spans("text").alias("s")).where("doc_id = 4").first()["s"]
    assert first["ids"] == K.Encoder().encode([own[4][1]])[0] and first["ends"][-1] == len(own[4][1])
    assert K.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
