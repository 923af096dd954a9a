import json
import random

from pyspark.sql import functions as F

from inkweir.operators import classify as C
from inkweir.operators import views as V
from inkweir.operators.identity import decisions, snapshot_versions, stored_key

LEX = C.Lexicon(("投资", "项目"), ("会议",), (("a", "甲", ("资金", "基金")), ("b", "乙", ("监管", "资金"))), (("批复", ("批复",)), ("正式", ("通知",))), ("批复",), ("正式",), (("细则", "note"),))


def fold(batches):
    """The decisions one after the other."""
    versions, links, out = {}, {}, []
    for batch in batches:
        rows = []
        for seq, url, natural, digest, storable in batch:
            origin = url in links
            k = links.get(url, natural)
            if digest in versions.get(k, []):
                d, stored = "duplicate_skip", k
            elif not storable:
                d, stored = "excluded", None
            elif k in versions and not origin:
                d, stored = "suspected_duplicate", f"{k}:variant:{url}"
            else:
                d, stored = ("updated" if k in versions else "ingested"), k
            if d in ("ingested", "updated"):
                versions.setdefault(k, []).append(digest)
            if d == "suspected_duplicate":
                versions.setdefault(stored, []).append(digest)
            if stored:
                links[url] = stored
            rows.append((seq, d))
        out.append((rows, {k: list(v) for k, v in versions.items()}, dict(links)))
    return out


def test_decisions_equal_the_sequential_fold(spark):
    random.seed(5)
    for trial in range(3):
        batches, seq = [], 0
        for _ in range(3):
            urls = random.sample(range(40), 30)
            batch = []
            for u in urls:
                seq += 1
                batch.append((seq, f"u{u}", f"k{u % 7}", f"d{random.randint(0, 4)}", random.random() > 0.2))
            batches.append(batch)
        want = fold(batches)
        versions, links = {}, {}
        for batch, (rows, versions_after, links_after) in zip(batches, want):
            known = [(k, d, i + 1) for k, ds in versions.items() for i, d in enumerate(ds)]
            got = decisions(spark.createDataFrame(batch, "seq long, url string, natural string, digest string, storable boolean"), spark.createDataFrame(list(links.items()), "url string, key string"), spark.createDataFrame(known, "key string, digest string, version long")).collect()
            assert sorted((r["seq"], r["decision"]) for r in got) == sorted(rows)
            for r in got:
                if r["decision"] in ("ingested", "updated"):
                    assert versions_after[r["key"]][r["version"] - 1] == r["digest"]
            versions, links = versions_after, links_after


def test_decisions_of_empty_and_repeated_input(spark):
    schema = "seq long, url string, natural string, digest string, storable boolean"
    assert decisions(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", None, None, True), (2, "u2", "k", None, True), (3, "u3", "k", None, True)]
    got = {r["seq"]: r["decision"] for r in decisions(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "ingested", 2: "ingested", 3: "duplicate_skip"}
    key, related = stored_key(F.lit("suspected_duplicate"), F.lit("K"), F.lit("u"))
    r = spark.range(1).select(key.alias("k"), related.alias("r")).first()
    assert r["k"].startswith("K:variant:") and len(r["k"]) == 10 + 16 and r["r"] == "K"


def test_snapshot_versions(spark):
    rows = [(1, "k", "a"), (2, "k", "b"), (3, "k", "a"), (4, "k", "c"), (5, "l", "a")]
    got = snapshot_versions(spark.createDataFrame(rows, "seq int, key string, digest string"), "key", "seq", "digest").orderBy("seq").collect()
    assert [r["version"] for r in got] == [1, 2, 2, 3, 1]


def test_labels(spark):
    rows = [(1, "关于项目的通知", "投资 资金"), (2, "会议通知", "投资项目"), (3, "批复", ""), (4, None, None), (5, "实施细则", "基金 监管"), (6, "x", "投\n资")]
    got = {r["id"]: r for r in C.labelled(spark.createDataFrame(rows, "id int, title string, text string"), "title", "text", LEX).collect()}
    assert [got[i]["relevance"] for i in range(1, 7)] == ["yes", "no", "yes", "no", "no", "pending"]
    assert got[1]["category"] == "a,b" and got[1]["hint"] == "tie" and got[1]["reason"] == "甲:资金；乙:资金"
    assert got[2]["reason"] == "excluded" and got[2]["category"] == "" and got[3]["doc_type"] == "批复" and got[4]["doc_type"] == "其他"
    assert got[5]["hint"].startswith("boundary:细则")


def test_model_replies(spark):
    good = {"is_investment_policy": "yes", "category": ["a", "a"], "doc_type": "批复", "need_review": False, "evidence": "资金 支持", "confidence": 0.9, "category_reason": "r"}
    rows = [(1, json.dumps(good, ensure_ascii=False)), (2, json.dumps(good | {"evidence": "没有"}, ensure_ascii=False)), (3, json.dumps(good | {"category": ["z"], "need_review": "no", "is_investment_policy": "maybe"}, ensure_ascii=False)), (4, "no json"), (5, json.dumps(good | {"confidence": 0.5}, ensure_ascii=False)), (6, json.dumps(good | {"category": []}, ensure_ascii=False)), (7, None)]
    d = spark.createDataFrame(rows, "id int, reply string").select("id", C.checked(F.col("reply"), F.lit("给予资金支持"), ("a", "b"), ("批复",)).alias("c"))
    got = {r["id"]: r["c"] for r in d.collect()}
    assert got[1]["relevance"] == "yes" and got[1]["labels"] == ["a"] and not got[1]["need_review"] and got[1]["errors"] == []
    assert got[2]["relevance"] == "pending" and got[2]["errors"] == ["evidence"] and got[2]["evidence"] == ""
    assert set(got[3]["errors"]) == {"relevance", "labels", "flag"} and got[4]["relevance"] == "pending" and got[7]["relevance"] == "pending"
    assert got[5]["relevance"] == "yes" and got[5]["need_review"] and got[6]["errors"] == ["unlabelled"]


def test_slices_and_merge(spark):
    df = spark.createDataFrame([(1, "甲" * 25), (2, ""), (3, None)], "id int, t string")
    parts = C.in_chunks(df, ["id"], "t", 10, 2)
    assert sorted((r["id"], r["idx"], r["truncated"], len(r["chunk"])) for r in parts.collect()) == [(1, 0, True, 10), (1, 1, True, 10), (2, 0, False, 0), (3, 0, False, 0)]
    asked = C.by_model(parts, ["id"], lambda: lambda s: None if not s else json.dumps({"n": len(s)}))
    assert {r["reply"] for r in asked.where("id = 1").collect()} == {'{"n": 10}'}
    rows = [(1, 1, False, "no", ["b"], "批复", False, "r2", "", ""), (1, 0, False, "yes", ["a", "b"], "其他", False, "r1", "e", "h"), (2, 0, True, "no", [], "其他", False, "r", "", ""), (3, 0, False, "no", [], "其他", False, "r", "", "")]
    got = {r["id"]: r for r in C.merged(spark.createDataFrame(rows, "id int, idx int, truncated boolean, relevance string, labels array<string>, doc_type string, need_review boolean, reason string, evidence string, hint string"), ["id"]).collect()}
    assert (got[1]["relevance"], got[1]["category"], got[1]["doc_type"], got[1]["reason"]) == ("yes", "a,b", "批复", "r1；r2")
    assert got[2]["relevance"] == "pending" and got[2]["need_review"] and got[3]["relevance"] == "no" and not got[3]["need_review"]
    rules = spark.createDataFrame([(1, "no", "x", "t"), (9, "no", "x", "t")], "id int, relevance string, category string, doc_type string")
    both = {r["id"]: r for r in C.with_fallback(C.merged(spark.createDataFrame(rows, "id int, idx int, truncated boolean, relevance string, labels array<string>, doc_type string, need_review boolean, reason string, evidence string, hint string"), ["id"]), rules, ["id"]).collect()}
    assert both[1]["method"] == "llm" and both[1]["relevance"] == "yes" and both[9]["method"] == "rule_fallback" and both[9]["relevance"] == "pending"


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, True, ["a"]), (2, False, []), (3, True, ["a", "b"]), (4, True, [])], "id long, relevant boolean, categories array<string>")
    rec = spark.createDataFrame([(1, "yes", "a", "rule"), (2, "yes", "b", "rule"), (3, "pending", "a", "rule_fallback"), (4, "no", "", "llm")], "id long, relevance string, category string, method string")
    r = C.evaluated(gold, rec).first()
    assert (r["relevance_precision"], r["relevance_recall"], r["category_micro_precision"], r["category_micro_recall"], r["exact_match"], r["pending"], r["rule_fallback"]) == (0.5, round(1 / 3, 4), 0.5, round(1 / 3, 4), 0.25, 1, 1)
    assert C.evaluated(gold.limit(0), rec).first()["relevance_precision"] is None
    bad = spark.createDataFrame([(1, True, ["z"]), (9, True, []), (2, False, ["a"]), (3, True, []), (3, True, [])], "id long, relevant boolean, categories array<string>")
    assert {r["id"]: r["error"] for r in C.label_errors(bad, rec, ("a", "b")).collect()} == {1: "unknown label", 9: "unknown id", 2: "labels on an irrelevant text", 3: "repeated id"}


def test_reviews(spark):
    p = spark.createDataFrame([(1, "pending", True, "pending", "a"), (2, "pending", True, "yes", ""), (3, "pending", True, "yes", "b")], "id long, review_status string, need_review boolean, is_investment_policy string, category string")
    e = spark.createDataFrame([(1, 1, "reject", None, 1), (2, 1, "adjust", ["b", "a", "b"], 2), (3, 2, "confirm", None, 1), (4, 7, "confirm", None, 1), (5, 3, "adjust", ["q"], 1), (6, 3, "paint", None, 1)], "id long, policy_id long, action string, categories array<string>, at long")
    errors = {r["id"]: r["error"] for r in V.review_errors(e, p, ("a", "b")).collect()}
    assert errors == {3: "no label to confirm", 4: "unknown policy", 5: "invalid labels", 6: "unknown action"}
    got = {r["id"]: r for r in V.reviewed(p, e.where("id in (1, 2)")).collect()}
    assert (got[1]["review_status"], got[1]["category"], got[1]["need_review"], got[1]["is_investment_policy"]) == ("adjusted", "b,a", False, "yes") and got[3]["review_status"] == "pending"


def test_queues_and_runs(spark):
    rows = [(i, 1 if i % 3 else 2, random.Random(i).choice(["failed", "processed", "discovered"]), None if i % 4 == 0 else i % 5) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "id long, source_id long, status string, last_checked_at long")
    order = lambda r: (r[2] == "processed", r[3] is not None, r[3] or 0, r[0])
    want = {s: [r[0] for r in sorted((r for r in rows if r[1] == s), key=order)[:7]] for s in (1, 2)}
    got = V.rotation_all(df, 7, salts=3).orderBy("source_id", "place").collect()
    assert {s: [r["id"] for r in got if r["source_id"] == s] for s in (1, 2)} == want
    assert [r["id"] for r in V.rotation(df, 1, 7).collect()] == want[1]
    runs = spark.createDataFrame([(1, "r", "running", None, 1, None), (2, "r", "ok", '{"failed": 0, "downloaded": 3}', 1, 5), (3, "q", "running", '{"failed": 2}', 2, None)], "id long, run_id string, status string, summary string, started_at long, finished_at long")
    assert {r["run_id"]: r["status"] for r in V.latest_runs(runs).collect()} == {"r": "ok", "q": "running"}
    assert {r["status"] for r in V.recovered(runs.withColumn("note", F.lit(None).cast("string"))).collect()} == {"failed", "ok"}
    assert {r["run_id"]: r["status"] for r in V.run_totals(runs, ["run_id"]).drop("note").collect()} == {"r": "ok", "q": "failed"}


def test_upsert_migration_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "u", 1), (1, "u", 3), (1, "v", 2), (None, "u", 1), (None, "u", 1)], "policy_id long, url string, at long")
    assert sorted((r["policy_id"] or 0, r["url"], r["at"]) for r in V.upserted(rows, ["policy_id", "url"], ["at"]).collect()) == [(0, "u", 1), (0, "u", 1), (1, "u", 3), (1, "v", 2)]
    assert V.migrated(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([], "a int, b string")).collect()[0].asDict() == {"a": 1, "b": None}
    empty = spark.createDataFrame([], "id long, policy_key string, version int, review_status string, need_review boolean, region string, category string, category_names string, title string, content string, wenhao string")
    assert V.search(empty, keyword="x").count() == 0 and V.regions(empty).count() == 0 and V.category_counts(empty).count() == 0
