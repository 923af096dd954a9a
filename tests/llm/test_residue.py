import random
import re

from inkweir.llm import residue as R

SENTENCES = ["各有关单位应当按期完成项目建设，不得延误。", "到2026年投资完成率达到80%，接受社会监督。", "审批部门可不填写未涉及的项，资料保存期限不少于十年。", "#3机组与#4机组之间的管网由运营单位负责。", "网站关闭脚本（JavaScript）后仍应可阅读正文。"]
BAD = ["请启用JavaScript后刷新本页", "抱歉，您要找的页面不存在或已被删除（{n}）", "系统繁忙，请{n}分钟后重试", "404 Not Found", "文字文字文字文字文字", "这是第{n}段示例文本，用于查看版式效果。"]
MARKS = ["{{{{title}}}}", "${{issuer}}", "<%= content %>", "（此处填写发文单位）", "【待补充：金额】", "__UNIT_NAME__", "#发文字号#"]
SCHEMA = "id long, title string, content string, residue boolean, key string, h int"


def records(n=400):
    random.seed(6)
    out, bad = [], set()
    for i in range(n):
        text = "\n".join(random.choice(SENTENCES) for _ in range(random.randint(3, 8)))
        title = f"关于做好第{i}批项目工作的通知"
        kind = random.random()
        if kind < 0.1:
            text = random.choice(BAD).format(n=i)
        elif kind < 0.2:
            at = random.randint(0, len(text))
            text = text[:at] + random.choice(MARKS).format() + text[at:]
        elif kind < 0.25:
            text = "浏览器未启用 JavaScript，部分功能可能不可用\n" + text
        if kind < 0.2:
            bad.add(i)
        out.append((i, title, text))
    return out + [(n, None, None), (n + 1, "", ""), (n + 2, "通知", "  \n "), (n + 3, "{{标题}}", None)], bad | {n + 3}


def test_operator(spark):
    rows, bad = records()
    df = spark.createDataFrame([(*r, True, "x", 1) for r in rows], SCHEMA)
    got = {r["id"] for r in R.judged(df).where("residue").collect()}
    assert got == bad


def test_finds_notations_that_are_no_seeds(monkeypatch):
    rows, bad = records()
    seeds = [(t, c) for i, t, c in rows if i in bad]
    others = [(t, (c or "") + "（第一批）〔2025〕《管理办法》[大]") for i, t, c in rows if i not in bad]
    monkeypatch.setattr(R, "_PLACEHOLDER", re.compile(r"\{\{.*?\}\}|__[A-Z_]+__|<%=.*?%>|（此处.*?）|\$\{.*?\}|#发文字号#|【待补充.*?】"))
    model = R.learn(seeds, others)
    for text in ("尊敬的{customer_name}用户", "[[title]]", "@@pub_date@@", "%{issuer}", "{{发文字号}}"):
        assert R.verdict(None, SENTENCES[0] + text, model)[0], text
    for text in ("（第一批）", "〔2025〕", "《管理办法》", "[大] [中]", "#3机组与#4机组", "（JavaScript）", "{}", "[ ]"):
        assert not R.verdict(None, SENTENCES[0] + text, model)[0], text


def test_repeated_rows_long_texts_and_empty_table(spark):
    rows, _ = records(30)
    df = spark.createDataFrame([(*r, True, "x", 1) for r in [rows[0], rows[0], (1, "t", "字" * 300000)]], SCHEMA)
    assert R.judged(df).count() == 3
    assert R.judged(df.limit(0)).count() == 0


def test_samples_are_bounded(spark):
    from pyspark.sql import functions as F

    from inkweir.llm.sampling import sample, sample_kinds

    df = spark.range(5000).withColumn("h", F.xxhash64("id"))
    assert len(sample(df, F.col("h"), 100, ["id"])) == 100
    assert len(sample(df.limit(50), F.col("h"), 100, ["id"])) == 50
    got = sample_kinds(df, (F.col("id") % 2).cast("int"), F.col("h"), {0: 40, 1: 60}, ["id"])
    assert len(got[0]) == 40 and len(got[1]) == 60 and all(r["id"] % 2 == 0 for r in got[0])
