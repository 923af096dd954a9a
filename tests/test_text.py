import hashlib

from pyspark.sql import functions as F

from inkweir.functions import text as X
from inkweir.functions import urls as U
from inkweir.operators.identity import identity_key


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_normal_forms(spark):
    rows = [("《关于 ＡＢ》“通知”",), (None,), ("",), ("a\t　b\u001c c",)]
    got = values(spark, rows, "s string", t=X.title_key(F.col("s")), n=X.number_key(F.col("s")), m=X.for_match(F.col("s")), w=X.without_blanks(F.col("s")))
    assert [g["t"] for g in got] == ["关于ab通知", "", "", "abc"]
    assert got[0]["m"] == "《关于ａｂ》“通知”" and got[3]["m"] == "a\t　b\u001c c" and got[3]["w"] == "abc" and got[1]["w"] is None
    assert values(spark, [("发改 [2025]【１】（x）",)], "s string", n=X.number_key(F.col("s")))[0]["n"] == "发改〔2025〕〔1〕〔x〕"


def test_dates(spark):
    rows = [(s,) for s in ("2026年9月1日", "2026-13-01 2026-01-02", "2026/2/30", "x 1999.12.31", "26-1-1", None, "", "2026 年 9 月 1")]
    assert [g["d"] for g in values(spark, rows, "s string", d=X.iso_date(F.col("s")))] == ["2026-09-01", "", "", "1999-12-31", "", "", "", "2026-09-01"]


def test_metadata(spark):
    text = "发改投资〔2026〕 101号\n正文引用甲〔2020〕1号。\n2025年1月1日\n某某局\n省发展改革委\n县人民政府\n2026年9月1日\n"
    got = values(spark, [(text, "题"), ("正文", "关于甲局[2024]7号的通知"), (None, None), ("一段\n2026年2月30日", ""), ("某局\n2026年3月1日\n某厅\n2026年3月1日", "")], "c string, t string", n=X.issuing_number(F.col("c"), F.col("t")), d=X.signature_date(F.col("c")), s=X.signers(F.col("c")))
    assert [g["n"] for g in got] == ["发改投资〔2026〕101号", "关于甲局[2024]7号", "", "", ""]
    assert [g["d"] for g in got] == ["2026-09-01", "", "", "", "2026-03-01"]
    assert [g["s"] for g in got] == ["某某局、省发展改革委、县人民政府", "", "", "", "某厅"]


def test_chunks_guard_labels(spark):
    got = values(spark, [("字" * 7,), ("",), (None,), ("=1+1",), ("  -x",)], "s string", c=X.chunks(F.col("s"), 3), g=X.guarded(F.col("s")))
    assert [g["c"] for g in got[:3]] == [["字字字", "字字字", "字"], [""], [""]]
    assert [g["g"] for g in got] == ["字" * 7, "", None, "'=1+1", "'  -x"]
    assert values(spark, [("b,,a,z",), (None,)], "s string", n=X.label_names(F.col("s"), {"a": "甲", "b": "乙"})) == [{"n": ["乙", "甲", "z"]}, {"n": []}]
    assert values(spark, [("50% Off_É",)], "s string", a=X.holds(F.col("s"), "% oFF_"), b=X.holds(F.col("s"), "%_"), c=X.holds(F.col("s"), "é"))[0] == {"a": True, "b": False, "c": False}


def test_fingerprint_and_analysis_text(spark):
    files = "array<struct<name:string,sha256:string,url:string,parsed_text:string>>"
    a, b = ("n1", "x", "u1", "文"), ("n2", "", "u2", "")
    got = values(spark, [("正 文", [a, b]), ("正文　", [b, a, a]), ("正文", [a]), (None, [])], f"c string, f {files}", d=X.fingerprint(F.col("c"), F.col("f")), t=X.analysis_text(F.col("c"), F.col("f")))
    assert got[0]["d"] == got[1]["d"] != got[2]["d"] and got[0]["t"] == "[正文]\n正 文\n\n[附件：n1]\n文" and got[3]["t"] == "[正文]\n"
    assert values(spark, [("abc",)], "c string", d=X.fingerprint(F.col("c")))[0]["d"] == hashlib.sha256(b"abc").hexdigest()


def test_evidence_and_confidence(spark):
    got = values(spark, [("A b", "xab", "0.5"), ("", "x", "1.2"), (None, "x", "x"), ("q", "x", None)], "e string, s string, c string", e=X.located(F.col("e"), F.col("s")), c=X.confidence(F.col("c")))
    assert [g["e"] for g in got] == [True, False, False, False] and [g["c"] for g in got] == [0.5, None, None, None]


def test_identity_keys(spark):
    rows = [("甲[2025]1号", "t", "局", "s", "u"), ("公告（2025）1号", "t", "", "s", "u"), ("", "《办法》", "局", "s", "u"), (None, "办法（试行）", None, "s", "u"), (None, None, None, "s", "u"), ("甲〔２０２６〕1号", "", "", "s", "u")]
    got = values(spark, rows, "a string, b string, c string, d string, e string", k=identity_key(*map(F.col, "abcde")))
    assert [g["k"] for g in got] == ["甲〔2025〕1号", "s:公告〔2025〕1号", "局:办法", "s:办法(试行)", hashlib.sha256(b"u").hexdigest(), "甲〔2026〕1号"]


def test_urls(spark):
    from urllib.parse import urlsplit, urlunsplit

    rows = [(u,) for u in ("HTTP://A.Gov.cn/P?q=1#f", " https://a/b ", "/x/y#z", "https://h", "a?b", "//H/p", "https://h/?")]
    want = [urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path, p.query, "")) for p in (urlsplit(r[0].strip()) for r in rows)]
    assert [g["u"] for g in values(spark, rows, "u string", u=U.normalized(F.col("u")))] == want
    cases = [("https://a.cn/policy/1.html", True), ("https://b.cn/policy/1.html", False), ("https://a.cn/other/1.html", False), ("https://a.cn/policy/video/1", False), ("https://u@a.cn/policy/1", False), ("ftp://a.cn/policy/1", False), ("https://A.CN/policy/x.PNG", False), ("https://A.CN/policy/x", True), (None, False), ("file:///policy/x", False)]
    rows = [(u, "https://a.cn/list/", ["/policy/"], ["/video/"]) for u, _ in cases]
    got = values(spark, rows, "u string, o string, i array<string>, e array<string>", a=U.allowed(F.col("u"), F.col("o"), F.col("i"), F.col("e")), p=U.allowed(F.col("u"), F.col("o"), F.col("i"), F.col("e"), pattern=F.lit("1\\.html$")), h=U.allowed(F.col("u"), F.col("o"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.array(F.lit("b.cn"))))
    assert [g["a"] for g in got] == [w for _, w in cases] and [g["p"] for g in got].count(True) == 1 and [g["h"] for g in got].count(True) == 1
    pages = values(spark, [("https://a/l/", "trs", 3), ("https://a/l?p={page}&q={page0}", "", 2), ("https://a/l", None, None)], "u string, p string, n int", x=U.page_urls(F.col("u"), F.col("p"), F.col("n")))
    assert [[x["url"] for x in g["x"]] for g in pages] == [["https://a/l/", "https://a/l/index_1.html", "https://a/l/index_2.html"], ["https://a/l?p=1&q=0", "https://a/l?p=2&q=1"], ["https://a/l"]]
