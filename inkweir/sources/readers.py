"""Readers: stored pages, samples, labels, configuration, attachments and blobs; a paged HTTP data source."""

from __future__ import annotations

import hashlib
import io
import json
import os
import time
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from inkweir.functions.urls import path_format
from inkweir.sources.html import anchors

LABELS = "id long, relevant boolean, categories array<string>"


def files(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """(path, content, length) of a folder's files, by path. Local paths are unquoted."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(urllib.parse.unquote(folder)).select("path", "content", "length").orderBy("path")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Gold labels from JSON lines; unreadable lines fail the read."""
    return spark.read.schema(LABELS).option("mode", "FAILFAST").json(path)


def detected_format(content: Column, url: Column, content_type: Column) -> Column:
    """pdf by its mark, else the suffix of the path, else the content type, else html."""
    suffix = path_format(url)
    named = F.when(F.contains(content_type, F.lit("pdf")), "pdf").when(F.contains(content_type, F.lit("wordprocessingml")), "docx").when(F.contains(content_type, F.lit("msword")), "doc").when(F.contains(content_type, F.lit("plain")), "txt").otherwise("html")
    return F.when(F.substring(content, 1, 5) == F.lit(b"%PDF-"), "pdf").when(suffix != "", suffix).otherwise(named)


def docx_text(data: bytes) -> str:
    """Paragraphs and tables of a Word document in order, a line each."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.parse(zipfile.ZipFile(io.BytesIO(data)).open("word/document.xml")).getroot().find(f"{w}body")
    blocks = [b for b in (body if body is not None else ()) if b.tag in (f"{w}p", f"{w}tbl")]
    return "\n".join(" ".join(t.text for t in b.iter(f"{w}t") if t.text) for b in blocks).strip()


def pdf_text(data: bytes) -> tuple[str, str]:
    """(text, error) of a PDF by an optional library; without one the file is kept for later."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return "", "no PDF library"
    pages = PdfReader(io.BytesIO(data)).pages
    if len(pages) > 500:
        return "", "more than 500 pages"
    texts = [p.extract_text() or "" for p in pages]
    return "\n\n".join(f"[第{i + 1}页]\n{t}" for i, t in enumerate(texts) if t.strip()), "" if all(t.strip() for t in texts) else "pages without text"


def decode_document(data: bytes | None, kind: str | None) -> tuple[str, str]:
    """(text, error) of an attachment; never raises."""
    kind = (kind or "").lower().lstrip(".")
    if data is None:
        return "", "no content"
    if data.startswith(b"%PDF-"):
        kind = "pdf"
    try:
        if kind == "pdf":
            text, error = pdf_text(data)
        elif kind == "docx":
            text, error = docx_text(data), ""
        elif kind == "txt":
            text, error = data.decode("utf-8-sig"), ""
        else:
            return "", f"unsupported: {kind}"
    except Exception as e:  # noqa: BLE001 - a broken file is data
        return "", f"{kind}: {type(e).__name__}"
    return text, error or ("" if text.strip() else "empty")


def document_texts(data: Column, kind: Column) -> Column:
    """Struct (text, error) of attachments, in Arrow batches."""

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, kinds in batches:
            yield pd.DataFrame([decode_document(d, k) for d, k in zip(contents, kinds)], columns=["text", "error"])

    return run(data, kind)


KINDS = ("pdf", "docx", "doc", "txt", "xls", "xlsx", "zip", "rar", "ofd", "wps")


def attachment_stage(rows: DataFrame) -> DataFrame:
    """Status ladder of attachments (page_url, url, fmt, content, content_type, fetch_error) -> fmt, sha256, parse_status, parsed_text, error.

    Failed: not fetched, a local file named by a remote page, or an error page in place of a PDF or Word file. Otherwise
    ok, partial (text and an error), unsupported (a kind without text) or needs_ocr.
    """
    found = detected_format(F.col("content"), F.col("url"), F.coalesce("content_type", F.lit("")))
    fmt = F.when(found.isin(*KINDS), found).otherwise(F.coalesce(F.nullif("fmt", F.lit("")), found))
    d = rows.withColumn("fmt", fmt)
    mark = F.substring("content", 1, 4)
    error = (
        F.when(F.coalesce("fetch_error", F.lit("")) != "", F.col("fetch_error")).when(F.col("content").isNull(), "no content").when(F.lower("url").startswith("file://") & ~F.lower(F.coalesce("page_url", F.lit(""))).startswith("file://"), "remote page names a local file")
        .when((F.col("fmt") == "pdf") & (F.substring("content", 1, 5) != F.lit(b"%PDF-")), "not a PDF").when(F.col("fmt").isin("doc", "docx") & (F.substring("content", 1, 2) != F.lit(b"PK")) & (mark != F.lit(b"\xd0\xcf\x11\xe0")), "not a Word file")
    )
    d = d.withColumn("_failed", error).withColumn("_t", document_texts(F.when(error.isNull(), F.col("content")), F.col("fmt")))
    status = F.when(F.col("_failed").isNotNull(), "failed").when((F.col("_t.text") != "") & (F.col("_t.error") != ""), "partial").when(F.col("_t.text") != "", "ok").when(~F.col("fmt").isin("pdf", "docx", "txt"), "unsupported").otherwise("needs_ocr")
    ok = F.col("_failed").isNull()
    return d.withColumn("sha256", F.when(ok, F.sha2("content", 256)).otherwise("")).withColumn("parse_status", status).withColumn("parsed_text", F.when(ok, F.col("_t.text")).otherwise("")).withColumn("error", F.coalesce("_failed", "_t.error")).drop("_failed", "_t")


def blob_rows(rows: DataFrame) -> DataFrame:
    """(source, sha256, path, content): the content-addressed store of fetched bytes (source, ext, content), one row each."""
    ext = F.substring(F.regexp_replace(F.lower(F.coalesce("ext", F.lit(""))), "[^a-z0-9]", ""), 1, 10)
    folder = F.regexp_replace("source", r"(?U)[^\w.-]", "_")
    d = rows.withColumn("sha256", F.sha2("content", 256)).withColumn("path", F.concat(folder, F.lit("/"), F.sha2("content", 256), F.lit("."), F.when(ext == "", "bin").otherwise(ext)))
    return d.groupBy("source", "sha256", "path").agg(F.any_value("content").alias("content"))


@dataclass(frozen=True)
class Source:
    """A configured source."""

    name: str
    list_url: str
    site: str = ""
    region: str = ""
    category: str = ""
    enabled: bool = True
    link_selector: str = ""
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    allowed_hosts: tuple[str, ...] = ()
    detail_url_pattern: str = ""
    pagination: str = ""
    list_format: str = ""
    max_pages: int = 1
    note: str = ""


@dataclass(frozen=True)
class Settings:
    """Run parameters: limits of fetching and of what a model sees."""

    timeout: int = 30
    interval: float = 0.5
    retries: int = 2
    backoff: float = 1.0
    most_bytes: int = 20 * 1024 * 1024
    chunk_chars: int = 10000
    max_chunks: int = 24
    sources: tuple[Source, ...] = ()
    model: dict = field(default_factory=dict)


def environment(path: str) -> dict[str, str]:
    """KEY=value lines of a file; what the environment already has wins."""
    out = {}
    if os.path.exists(path):
        for line in open(path, encoding="utf-8"):
            line = line.strip().removeprefix("export ").strip()
            if line and not line.startswith("#") and "=" in line:
                k, _, v = line.partition("=")
                out[k.strip()] = v.strip().strip("\"'")
    return out | {k: os.environ[k] for k in out if k in os.environ}


def settings(path: str, sources: str | None = None) -> Settings:
    """Settings from a YAML or JSON file, and the sources from a second one; chunks are at least 500 characters and one."""

    def load(p: str | None) -> dict:
        if not p or not os.path.exists(p):
            return {}
        text = open(p, encoding="utf-8").read()
        if p.endswith(".json"):
            return json.loads(text)
        import yaml

        return yaml.safe_load(text) or {}

    own, listed = load(path), load(sources).get("sources", [])
    fetch, model = own.get("fetch", {}), own.get("llm", {})
    names = Source.__dataclass_fields__
    made = tuple(Source(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items() if k in names}) for s in listed)
    return Settings(
        fetch.get("timeout_seconds", 30), fetch.get("request_interval_seconds", 0.5), fetch.get("retries", 2), fetch.get("retry_backoff_seconds", 1.0), fetch.get("max_page_bytes", 20 * 1024 * 1024),
        max(500, int(model.get("chunk_chars", 10000))), max(1, int(model.get("max_chunks", 24))), made, model,
    )


def source_rows(spark: SparkSession, sources: tuple[Source, ...]) -> DataFrame:
    """The configured sources as a table."""
    schema = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if "tuple" in f.type else T.BooleanType() if f.type == "bool" else T.IntegerType() if f.type == "int" else T.StringType()) for n, f in Source.__dataclass_fields__.items()])
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in (getattr(s, n) for n in Source.__dataclass_fields__)) for s in sources], schema)


def fetch(url: str, s: Settings, last: dict[str, float], opener=urllib.request.urlopen) -> dict:  # noqa: ANN001
    """One GET with a politeness interval, retries and a limit of bytes; errors are data. 401, 403 and 404 aren't retried."""
    out = {"url": url, "ok": False, "content": None, "content_type": "", "sha256": "", "error": ""}
    if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
        return out | {"error": "only http and https"}
    for attempt in range(s.retries + 1):
        time.sleep(max(0.0, s.interval - (time.monotonic() - last.get("at", -1e9))))
        last["at"] = time.monotonic()
        try:
            with opener(urllib.request.Request(url, headers={"User-Agent": "inkweir"}), timeout=s.timeout) as r:
                data = r.read(s.most_bytes + 1)
                if len(data) > s.most_bytes:
                    return out | {"error": "too large"}
                return out | {"ok": True, "content": data, "content_type": r.headers.get("Content-Type", ""), "sha256": hashlib.sha256(data).hexdigest()}
        except urllib.error.HTTPError as e:
            out["error"] = f"HTTP {e.code}"
            if e.code in (401, 403, 404):
                return out
        except OSError as e:
            out["error"] = type(e).__name__
        if attempt < s.retries:
            time.sleep(min(10, s.backoff * (attempt + 1)))
    return out


class _Host(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        super().__init__(urls)


class HttpSource(DataSource):
    """`spark.read.format("pages").option("urls", json)`: one partition for each host, so that the interval holds for it."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, ok boolean, content binary, content_type string, sha256 string, error string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _HttpReader(self.options)


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls, self.settings = json.loads(options.get("urls", "[]")), Settings(**json.loads(options.get("settings", "{}")))

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urllib.parse.urlsplit(u).netloc, []).append(u)
        return [_Host(x) for x in hosts.values()] or [_Host([])]

    def read(self, partition: _Host) -> Iterator[tuple]:
        last: dict[str, float] = {}
        for u in partition.value:
            r = fetch(u, self.settings, last)
            yield tuple(r[k] for k in ("url", "ok", "content", "content_type", "sha256", "error"))


# Words and address parts of the columns in which documents are published.
COLUMN_WORDS = ("规范性文件", "政策文件", "政策法规", "通知公告", "文件库", "zcwj", "guifan", "tzgg")


def column_candidates(page: str, words: tuple[str, ...] = COLUMN_WORDS) -> list[tuple[str, str]]:
    """(title, href) of a home page's links that look like columns of documents, each address without its query once."""
    found: dict[str, tuple[str, str]] = {}
    for href, title in anchors(page):
        if href[:1] == "/" or href.startswith("http"):
            if len(title) >= 3 and any(w in title or w in href for w in words):
                found.setdefault(href.partition("?")[0], (title[:30], href))
    return list(found.values())
