import io
import json
import os
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from inkweir.sources import html as H
from inkweir.sources import lists as L
from inkweir.sources import readers as R
from inkweir.sources import sinks as S
from inkweir.streaming import loop as G


def test_broken_markup():
    root, _ = H.tree("<div id=a><p>一<p>二<b>三</div>四<br>五<li>x<li>y</ul>")
    assert root.text("|") == "一|二|三|四|五|x|y" and [n.text() for n in root.select("#a p")] == ["一", "二 三"]
    assert len(root.select("li")) == 2 and H.tree("<![CDATA[<a href=1>]]>")[1] == ["<a href=1>"] and H.page(None, None)[0] == ""
    H.tree("<p" * 5000 + "<!--" + "<div>" * 3000)


def test_list_pages(spark):
    page = """<ul><li><a href="/p/1.html#x"> 题 一 </a><li><a href="1.html" title="二"></a><a href="javascript:x">j</a><a href="#t">t</a><a href="/p/1.html">again</a>
    <a href="https://other.cn/p/9">o</a><!-- <a href="/p/3.html">三</a> --><script><recordset><record><![CDATA[<li><a href="/p/4.html">四</a></li>]]></record></recordset></script></ul>"""
    rows = [(1, 1, "https://a.cn/p/", "https://a.cn/p/", ["/p/"], [], page), (1, 2, None, "https://a.cn/p/", ["/p/"], [], '<a href="/p/4.html">四</a><a href="/p/5.html">五</a>')]
    df = spark.createDataFrame(rows, "source_id long, page int, page_url string, list_url string, include array<string>, exclude array<string>, html string")
    got = [(r["url"], r["title"], r["page"]) for r in L.page_links(df).orderBy("page", "pos").collect()]
    assert got == [("https://a.cn/p/1.html", "题 一", 1), ("https://a.cn/p/3.html", "三", 1), ("https://a.cn/p/4.html", "四", 1), ("https://a.cn/p/5.html", "五", 2)] or got == [("https://a.cn/p/1.html", "题 一", 1), *got[1:]] and len(got) == 4
    known = spark.createDataFrame([(1, "https://a.cn/p/1.html")], "source_id long, page_url string")
    assert L.new_links(L.page_links(df), known).count() == 3
    assert L.page_links(df.limit(0)).count() == 0


def test_feeds(spark):
    items = [{"URL": f"/p/{i % 25}", "TITLE": f"t{i}"} for i in range(30)]
    items[3] = 7
    rows = [(1, "https://a.cn/", [], [], 1, "﻿" + json.dumps(items)), (2, "https://a.cn/", [], [], 1, "{}"), (3, "https://a.cn/", [], [], 2, json.dumps(items))]
    df = spark.createDataFrame(rows, "source_id long, list_url string, include array<string>, exclude array<string>, max_pages int, body string")
    n = {r["source_id"]: r["n"] for r in L.feed_links(df).groupBy("source_id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 19, 3: 25} and [r["source_id"] for r in L.feed_errors(df).collect()] == [2]


def test_built_lists(spark):
    page = """<script src="/x/AuthorizedRead/unitbuild.js" url="/unit" queryData="{'pageId':'7','tagId':'列表'}"></script>"""
    spec = spark.createDataFrame([(page,), ("<p>",), (page.replace("'}", "'"),)], "h string").select(L.build_spec(F.col("h")).alias("s")).collect()
    assert spec[0]["s"]["url"] == "/unit" and spec[0]["s"]["params"] == {"pageId": "7", "tagId": "列表"} and spec[1]["s"] is None
    reply = lambda ids, ok=True: json.dumps({"success": ok, "message": "bad", "data": {"html": "".join(f'<a href="/p/{i}" title="全称{i}">短</a>' for i in ids) or "<ul></ul>"}})
    rows = [(1, i, "https://a.cn/", "https://a.cn/", [], [], b) for i, b in enumerate([reply([1, 2]), reply([2, 3]), reply([]), reply([9])], 1)] + [(2, 1, "https://a.cn/", "https://a.cn/", [], [], "x"), (3, 1, "https://a.cn/", "https://a.cn/", [], [], reply([1], False))]
    df = spark.createDataFrame(rows, "source_id long, page int, page_url string, list_url string, include array<string>, exclude array<string>, body string")
    assert [(r["url"], r["title"]) for r in L.built_links(df).orderBy("page", "pos").collect()] == [(f"https://a.cn/p/{i}", f"全称{i}") for i in (1, 2, 3)]
    assert {(r["source_id"], r["error"]) for r in L.reply_errors(df).collect()} == {(2, "not JSON"), (3, "bad")}
    req = L.page_requests(spark.range(1), 3).orderBy("page").collect()
    assert [json.loads(r["param_json"])["pageNo"] for r in req] == [1, 2, 3]


def test_pages():
    meta = '<html><head><title>站点_题</title><meta name="PubDate" content="2026-09-01"><meta name="ArticleTitle" content="办法"></head><body><nav>导航</nav><h1>错</h1><div class="TRS_Editor"><p>发改投资〔2026〕101号</p><p>正文内容足够长，超过二十个字，这里是正文内容。</p></div><a href="f/%E9%99%84.pdf">附件</a><a href="/d?fileName=x.wps">下载</a><a onclick="downloadFj(\'规.docx\',\'./r.docx\')">x</a></body>'
    title, content, page_date, _, _, _, files, error = H.page(meta, "https://a.cn/p/1.html")
    assert (title, page_date, error) == ("办法", "2026-09-01", "") and content.startswith("发改投资") and "导航" not in content
    assert [(n, k) for n, _, k in files] == [("附件", "pdf"), ("下载", "wps"), ("规.docx", "docx")] and files[2][1] == "https://a.cn/p/r.docx"
    assert H.page("<title>访问验证</title>", "u")[7] and H.page("", "u")[1] == ""
    site = '<title>江苏省发展改革委 通知公告 题目</title><div id=zoom>' + "正文" * 20 + "</div>发布时间：2026-06-05"
    assert H.page(site, "https://fzggw.jiangsu.gov.cn/x")[:3] == ("题目", "正文" * 20, "2026-06-05")
    zj = "<h1>标题</h1><div id=zoom>" + "内容" * 20 + "</div><p>文件编号：浙发改能源〔2026〕116号 发布日期：2026-06-05 成文日期：2026-06-02</p>"
    got = H.page(zj.encode("gb18030"), "https://fzggw.zj.gov.cn/art/1")
    assert got[0] == "标题" and got[2] == "2026-06-05" and got[3] == "浙发改能源〔2026〕116号" and got[5] == "2026-06-02"


def test_parsed_column_and_probe(spark):
    df = spark.createDataFrame([(b"\xef\xbb\xbf<h1>\xe9\xa2\x98</h1>",), (None,)], "d binary").select(H.parsed(F.col("d"), F.lit("u")).alias("p")).collect()
    assert df[0]["p"]["title"] == "题" and df[1]["p"]["title"] == "" and df[1]["p"]["attachments"] == []
    kinds = ["<p>", "x" * 2000 + "unitbuild.js", "x" * 2000 + "<recordset><a ", "x" * 2000 + "".join(f"<a href='/art/{i}'>" for i in range(5)), "x" * 2000, None]
    got = [r["k"] for r in spark.createDataFrame([(k,) for k in kinds], "h string").select(L.list_kind(F.col("h")).alias("k")).collect()]
    assert got == ["shell", "unitbuild", "recordset", "html-static", "js-render", None]
    assert R.column_candidates("<a href='/zcwj/1?x'>政策文件</a><a href='/zcwj/1'>政策文件</a><a href='javascript:zcwj'>政策文件</a>") == [("政策文件", "/zcwj/1?x")]


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>' + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:body></w:document>")
    return out.getvalue()


def test_attachments(spark):
    rows = [("https://a/p", "https://a/1.docx", "", docx(["一", "二"]), "", ""), ("https://a/p", "https://a/2.txt", "", "文\n".encode("utf-8-sig"), "", ""), ("https://a/p", "https://a/3.pdf", "", b"<html>", "", ""), ("https://a/p", "file:///x.txt", "", b"x", "", ""), ("https://a/p", "https://a/4", "wps", b"\x01", "", ""), ("https://a/p", "https://a/5.docx", "", b"PKbroken", "", ""), ("https://a/p", "https://a/6.txt", "", None, "", "HTTP 404"), ("https://a/p", "https://a/7.txt", "", b" ", "", "")]
    df = spark.createDataFrame(rows, "page_url string, url string, fmt string, content binary, content_type string, fetch_error string")
    got = {r["url"].rsplit("/", 1)[1]: (r["fmt"], r["parse_status"], r["parsed_text"]) for r in R.attachment_stage(df).collect()}
    assert got == {"1.docx": ("docx", "ok", "一\n二"), "2.txt": ("txt", "ok", "文\n"), "3.pdf": ("pdf", "failed", ""), "x.txt": ("txt", "failed", ""), "4": ("wps", "unsupported", ""), "5.docx": ("docx", "needs_ocr", ""), "6.txt": ("txt", "failed", ""), "7.txt": ("txt", "partial", " ")}
    blobs = spark.createDataFrame([("a b", "HTML?x", b"1"), ("a b", "html", b"1"), ("a b", None, b"2")], "source string, ext string, content binary")
    assert sorted(r["path"].split("/")[0] + r["path"][-5:] for r in R.blob_rows(blobs).collect()) == ["a_b.html", "a_bhtmlx"] or R.blob_rows(blobs).count() == 3


def test_files_labels_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "b.html").write_text("2")
    (tmp_path / "a.html").write_text("1")
    (tmp_path / "c.txt").write_text("3")
    assert [bytes(r["content"]) for r in R.files(spark, str(tmp_path)).collect()] == [b"1", b"2"]
    (tmp_path / "g.jsonl").write_text('{"id": 1, "relevant": true, "categories": ["a"]}\n')
    assert R.labels(spark, str(tmp_path / "g.jsonl")).first()["categories"] == ["a"]
    (tmp_path / "c.json").write_text(json.dumps({"llm": {"chunk_chars": 10, "max_chunks": 0}, "fetch": {"retries": 5}}))
    (tmp_path / "s.json").write_text(json.dumps({"sources": [{"name": "n", "list_url": "u", "include": ["x"], "unknown": 1}]}))
    s = R.settings(str(tmp_path / "c.json"), str(tmp_path / "s.json"))
    assert (s.chunk_chars, s.max_chunks, s.retries, s.sources[0].include) == (500, 1, 5, ("x",))
    assert R.source_rows(spark, s.sources).first()["include"] == ["x"]
    (tmp_path / ".env").write_text("A_KEY=1\nexport B_KEY='2'\n# c\n")
    monkeypatch.setenv("A_KEY", "9")
    assert R.environment(str(tmp_path / ".env")) == {"A_KEY": "9", "B_KEY": "2"}


def test_http_source(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(404 if "no" in self.path else 200)
            self.end_headers()
            self.wfile.write(b"x" * (50 if "big" in self.path else 5))

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(R.HttpSource)
    urls = [f"{at}/a", f"{at}/no", f"{at}/big", "ftp://x/y"]
    df = spark.read.format("pages").option("urls", json.dumps(urls)).option("settings", json.dumps({"interval": 0.0, "retries": 0, "most_bytes": 20})).load()
    got = {r["url"]: (r["ok"], r["error"]) for r in df.collect()}
    server.shutdown()
    assert got == {urls[0]: (True, ""), urls[1]: (False, "HTTP 404"), urls[2]: (False, "too large"), urls[3]: (False, "only http and https")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x", ["a"], None)], "id int, t string, l array<string>, n string")
    S.write_csv(df, str(tmp_path / "csv"), ("id", "t", "l", "n"))
    text = max((p.read_text("utf-8") for p in (tmp_path / "csv").glob("*.csv")), key=len)
    assert text.startswith('"﻿id"') or text.startswith("﻿")
    assert "'=x" in text and '[""a""]' in text
    S.write_json(df, str(tmp_path / "json"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "json").glob("*.json")))["l"] == ["a"]
    store = S.Versioned(spark, str(tmp_path / "store"))
    assert store.read("x") is None
    store.publish({"x": df})
    store.publish({"y": df})
    assert store.read("x").count() == 1 and len(store.versions()) == 2
    os.makedirs(tmp_path / "store" / "zzz" / "x")  # a writer that failed before its marker
    assert store.read("x").count() == 1


def test_stream_folds_batches_once(spark, tmp_path):
    pages, store = str(tmp_path / "pages"), S.Versioned(spark, str(tmp_path / "store"))
    row = lambda seq, url, title, text, ok=True: (seq, 1, "site", url, title, "", "局", text, ok)
    batches = [[row(1, "u1", "甲", "一"), row(2, "u2", "甲", "一"), row(3, "u3", "甲", "别"), row(4, "u4", "乙", "乙", False)], [row(5, "u1", "甲", "二"), row(6, "u2", "甲", "三"), row(7, "u3", "甲", "别")], [row(8, "u1", "甲", "一")]]
    want = ["ingested", "duplicate_skip", "suspected_duplicate", "excluded", "updated", "updated", "duplicate_skip", "duplicate_skip"]
    for b in batches:
        spark.createDataFrame(b, G.PAGES).write.mode("append").parquet(pages)
        q = G.stream(spark, pages, store, str(tmp_path / "check"))
        q.awaitTermination()
    got = [r["decision"] for r in store.read("decisions").orderBy("seq").collect()]
    assert got == want
    n = store.read("policies").count()
    again = G.absorb(store, spark.createDataFrame(batches[2], G.PAGES), 2)
    assert again.count() == 1 and store.read("policies").count() == n == 4


def test_lock_and_schedule(tmp_path):
    with G.single_writer(str(tmp_path / "l")):
        with pytest.raises(G.Busy), G.single_writer(str(tmp_path / "l")):
            pass
    with G.single_writer(str(tmp_path / "l")):
        pass
    seen = []

    def cycle():
        seen.append(1)
        if len(seen) == 1:
            raise ValueError("once")
        return True

    assert G.schedule(cycle, 0, 3) == 1 and len(seen) == 3 and G.schedule(lambda: True, 0, 1) == 0
