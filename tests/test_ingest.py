"""The ingest stage against a plain version taken one document after the other."""

import random

from inkweir.operators.ingest import counters, ingest_decisions

SCHEMA = "seq long, url string, natural string, digest string, content string, error string, files int, failed int, whole int, read int, relevance string, needs boolean"


def plain(rows, links, known, states, again):
    links, known, top, out = dict(links), {(k, d) for k, d, _ in known}, {}, {}
    for k, _, v in stored:
        top[k] = max(top.get(k, 0), v)
    for seq, url, natural, digest, content, error, files, failed, whole, read, relevance, needs in rows:
        partly, unread = bool(error) or failed > 0 or whole < files, files > 0 and read == 0
        if not content.strip() and not files:
            out[seq] = ("failed", "failed", None)
            continue
        if url in links and failed:
            out[seq] = ("failed", "failed", None)
            continue
        key = links.get(url, natural)
        if (key, digest) in known:
            free = again and not partly and states.get(key) not in ("confirmed", "adjusted", "rejected")
            out[seq] = ("reclassified" if free else "duplicate", "failed" if failed else "processed", None)
            continue
        if relevance == "no" and not partly and not unread:
            out[seq] = ("excluded", "excluded", None)
            continue
        review = needs or partly or unread
        if url in links:
            outcome, review = "updated", True
        elif key in top:
            outcome, review = "suspected_duplicate", True
        else:
            outcome = "ingested"
        if outcome != "suspected_duplicate":
            known.add((key, digest))
            top[key] = top.get(key, 0) + 1
        out[seq] = (outcome, "failed" if failed else "processed", "pending" if review else "confirmed_auto")
    return out


stored = [("k0", "d0", 1), ("k1", "d1", 1), ("k1", "d2", 2), ("k2", "d9", 1)]


def test_equals_one_after_the_other(spark):
    random.seed(4)
    links = [(f"u{i}", f"k{i % 3}") for i in range(3)]
    rows = []
    for i in range(200):
        files = random.choice([0, 0, 1, 2])
        failed = random.choice([0, 0, 0, 1]) if files else 0
        whole = random.randint(0, files - failed)
        rows.append((i, random.choice(["u0", "u1", "u2", f"n{i}"]), f"k{random.randint(0, 40)}", f"d{random.randint(0, 30)}", random.choice(["正文", "正文", ""]), random.choice(["", "", "坏"]), files, failed, whole, whole, random.choice(["yes", "no", "pending"]), random.random() < 0.2))
    states = {"k0": "confirmed", "k1": "pending"}
    for again in (False, True):
        got = ingest_decisions(
            spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(links, "url string, key string"), spark.createDataFrame(stored, "key string, digest string, version long"),
            spark.createDataFrame(list(states.items()), "key string, review_status string"), again,
        )
        have = {r["seq"]: (r["outcome"], r["status"], r["review_status"]) for r in got.collect()}
        assert have == plain(rows, links, stored, states, again)
    assert {r["outcome"]: r["n"] for r in counters(got).collect()}.keys() == {o for o, *_ in have.values()}


def test_empty_batch(spark):
    assert ingest_decisions(spark.createDataFrame([], SCHEMA)).count() == 0
