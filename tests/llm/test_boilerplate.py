import random

from inkweir.llm import boilerplate as B

FURNITURE = ["首页 > 信息公开", "版权所有：某局　未经许可不得转载", "扫一扫，在手机上打开当前页面", "浏览量：{n}　[返回顶部]", "登录 | 注册 | RSS", "责任编辑：网管{n}　【关闭】"]
SCHEMA = "id string, page_url string, body string, kept int, tbl string"


def pages(n=60):
    random.seed(3)
    out = []
    for i in range(n):
        topic = "".join(chr(random.randint(0x4E00, 0x5000)) for _ in range(6))
        text = ["各有关单位：", f"为推进{topic}建设，现就有关事项明确如下。", "一、总体要求", f"第1条　{topic}应当按期完成，不得延误{i}日。", "某省水利局", f"202{i % 7}年3月{i % 28 + 1}日"]
        furniture = [f.format(n=random.randint(1, 999)) for f in random.sample(FURNITURE, 3)]
        lines = furniture[:2] + text + furniture[2:]
        out.append((str(i), f"https://h{i % 2}.example/a/{i:03d}.html", "\n".join(lines), 1, "x", {1, 2, 9}))
    return out


def run(spark, rows, markup=False):
    df = spark.createDataFrame([r[:5] for r in rows], SCHEMA)
    p = B.pages(df, "t", "id", "page_url", "body", markup)
    return p, {r["key"]: r for r in B.differenced(p).collect()}


def test_furniture_of_texts(spark):
    rows = pages()
    _, got = run(spark, rows)
    assert all(set(got[r[0]]["dropped"]) == r[5] for r in rows)
    assert all(set(got[r[0]]["kept"]) == set(range(3, 9)) for r in rows)


NOTICE = "本网站使用Cookie以改善您的浏览体验，继续浏览即表示同意。"


def test_the_alignment_deletes_sentences_that_pages_share(spark):
    rows = [(r[0], r[1], NOTICE + "\n" + r[2], 1, "x", {1} | {i + 1 for i in r[5]}) for r in pages()]
    _, got = run(spark, rows)
    assert all(set(got[r[0]]["dropped"]) == r[5] for r in rows)
    alone = B.read(rows[0][2], False)
    odds = B.learn([])
    none, most = B.furniture(alone, B.Counter(), 0, odds), B.furniture(alone, B.Counter({0: 6}), 8, odds)
    assert not none[0] and most[0]  # without its neighbours the page keeps the notice
    assert not any(B.furniture(alone, B.Counter({i: 8 for i in (7, 8)}), 8, odds)[7:9])  # signature and date stay


def test_pages_of_one_line_keep_their_text(spark):
    text = ["各有关单位：", "为推进某项建设，现就有关事项明确如下。", "第1条　某项建设应当按期完成，不得延误。", "某省水利局", "2025年3月1日"]
    small = "<html><body><nav><a href='/1'>首页</a></nav><div>登录</div>" + "".join(f"<p>{x}</p>" for x in text) + "</body></html>"
    one = "<html><body>\n<p>为推进某项建设，现就有关事项明确如下，请遵照执行。</p>\n</body></html>"
    rows = [("1", "https://a.example/1", small, 1, "x"), ("2", "https://b.example/1", one, 1, "x")]
    p, got = run(spark, rows, True)
    assert got["1"]["body"].split("\n") == text and got["1"]["kept"] == [1]
    assert got["2"]["kept"] == [2]


def test_body_of_markup(spark):
    rows = []
    for r in pages(40):
        lines = r[2].split("\n")
        body = [f"<p>{x}</p>" for x in lines[2:8]]
        page = ["<html><head><title>题</title></head><body>", "<nav>", "<a href='/1'>首页</a>", "</nav>", f"<div>{lines[0]}</span>", *body, "<p>某地项目达到8吨，逐步实现一网通办。<a href='/2'>[详细]</a></p>", f"{lines[8]}<br>", "</body>"]
        rows.append((r[0], r[1], "\n".join(page), 1, "x"))
    _, got = run(spark, rows, True)
    assert all(got[r[0]]["kept"] == list(range(6, 12)) for r in rows)


def test_alignment_is_a_longest_common_subsequence():
    random.seed(1)
    for _ in range(200):
        a = [random.choice("abcd") for _ in range(random.randint(0, 12))]
        b = [random.choice("abcd") for _ in range(random.randint(0, 12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = B.common(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_odd_pages(spark):
    rows = [("1", None, "x", 1, "x"), ("2", "", "", 1, "x"), ("3", "u", None, 1, "x"), ("4", "https://h.example/", "<p>未闭合\n<b>字" * 3000, 1, "x"), ("4", "https://h.example/", "<p>", 1, "x")]
    for markup in (False, True):
        p, got = run(spark, rows, markup)
        texts = [(r["key"], r["text"]) for r in B.body_texts(p).collect()]
        assert len(texts) == 5 and ("3", None) in texts and ("2", "") in texts and "2" not in got and "3" not in got
        assert run(spark, rows[:0] or [rows[2]], markup)[1] == {}
