"""List pages, JSON feeds and dynamically built lists to candidate links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweir.functions.urls import absolute, allowed, normalized
from inkweir.operators.skew import first_rows
from inkweir.sources import html

FEED = "array<struct<URL:string,TITLE:string>>"


def first_seen(links: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return first_rows(links, by, order)


def page_links(pages: DataFrame, selector: str = "", title_first: bool = False) -> DataFrame:
    """(source_id, url, title, page, pos) of list pages (source_id, page, page_url, list_url, include, exclude, html).

    Links are resolved, normalised, filtered by their source and kept at their first place in the source's pages.
    """
    flat = pages.select("source_id", "page", "list_url", "include", "exclude", F.coalesce("page_url", "list_url").alias("base"), F.explode(html.links(F.col("html"), selector, title_first)).alias("l"))
    found = flat.select("source_id", "page", F.col("l.pos").alias("pos"), F.col("l.title").alias("title"), normalized(absolute(F.col("base"), F.col("l.href"))).alias("url"), "list_url", "include", "exclude")
    kept = found.where(allowed(F.col("url"), F.col("list_url"), F.col("include"), F.col("exclude")))
    return first_seen(kept.select("source_id", "url", "title", "page", "pos"), ["source_id", "url"], ["page", "pos"]).select("source_id", "url", "title", "page", "pos")


def feed_links(feeds: DataFrame, per_page: int = 20) -> DataFrame:
    """(source_id, url, title, pos) of JSON feeds (source_id, list_url, include, exclude, max_pages, body).

    A body is an array of objects with URL and TITLE; at most max_pages * per_page rows count; rows of another kind are
    skipped. feed_errors() gives the bodies that aren't arrays.
    """
    body = F.regexp_replace("body", "^﻿", "")
    rows = F.from_json(body, "array<string>")
    taken = F.slice(rows, F.lit(1), (F.coalesce("max_pages", F.lit(1)) * per_page).cast("int"))
    flat = feeds.select("source_id", "list_url", "include", "exclude", F.posexplode(taken).alias("pos", "row")).withColumn("o", F.from_json("row", "struct<URL:string,TITLE:string>")).where(F.col("row").rlike(r"^\s*\{"))
    found = flat.select("source_id", "pos", normalized(absolute(F.col("list_url"), F.coalesce("o.URL", F.lit("")))).alias("url"), F.coalesce("o.TITLE", F.lit("")).alias("title"), "list_url", "include", "exclude")
    kept = found.where(allowed(F.col("url"), F.col("list_url"), F.col("include"), F.col("exclude")))
    return first_seen(kept.select("source_id", "url", "title", "pos"), ["source_id", "url"], ["pos"]).select("source_id", "url", "title", "pos")


def feed_errors(feeds: DataFrame) -> DataFrame:
    """(source_id, error) of the bodies that aren't JSON arrays."""
    body = F.regexp_replace("body", "^﻿", "")
    return feeds.where(~F.coalesce(body.rlike(r"^\s*\[") & F.from_json(body, "array<string>").isNotNull(), F.lit(False))).select("source_id", F.lit("not a JSON array").alias("error"))


def build_spec(page: Column) -> Column:
    """Struct (url, params) of a page whose list is built by a unit script; null without one or with unreadable data."""
    tag = F.regexp_extract(page, r"(?i)(<script\b[^>]*AuthorizedRead/unitbuild\.js[^>]*>)", 1)
    url, data = F.regexp_extract(tag, r'(?i)\burl="([^"]+)"', 1), F.regexp_extract(tag, r'(?i)\bquerydata="([^"]+)"', 1)
    params = F.from_json(F.translate(data, "'", '"'), "map<string,string>")
    return F.when((url != "") & (data != "") & params.isNotNull(), F.struct(url.alias("url"), params.alias("params")))


def page_requests(spec: DataFrame, max_pages: int, page_size: int = 15) -> DataFrame:
    """(…, page, param_json): the requests of a dynamic list's pages, in order."""
    p = spec.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(max_pages))))
    return p.withColumn("param_json", F.format_string('{"pageNo": %d, "pageSize": ' + str(page_size) + ', "search": ""}', "page"))


def built_links(replies: DataFrame) -> DataFrame:
    """(source_id, url, title, page, pos) of the replies (source_id, page, page_url, list_url, include, exclude, body).

    Pages after the first without links, and after the first that only repeats earlier links, don't count.
    """
    r = F.from_json("body", "struct<success:boolean,message:string,data:struct<html:string>>")
    pages = replies.withColumn("r", r).where("r.success").select("source_id", "page", "page_url", "list_url", "include", "exclude", F.col("r.data.html").alias("html"))
    found = page_links(pages, title_first=True)
    fresh = found.groupBy("source_id", "page").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    every = pages.select("source_id", "page").distinct().join(fresh, ["source_id", "page"], "left")
    good = every.withColumn("dead", F.sum(F.when(F.coalesce("n", F.lit(0)) == 0, 1).otherwise(0)).over(w)).where("dead = 0")
    return found.join(good.select("source_id", "page"), ["source_id", "page"], "left_semi")


def reply_errors(replies: DataFrame) -> DataFrame:
    """(source_id, page, error) of replies that aren't JSON, report failure or hold no list."""
    r = F.from_json("body", "struct<success:boolean,message:string,code:string,data:struct<html:string>>")
    error = F.when(F.col("r").isNull() | ~F.coalesce(F.col("body").rlike(r"^\s*\{"), F.lit(False)), "not JSON").when(~F.coalesce(F.col("r.success"), F.lit(False)), F.coalesce("r.message", "r.code", F.lit("failed"))).when(F.coalesce("r.data.html", F.lit("")) == "", "empty list")
    return replies.withColumn("r", r).select("source_id", "page", error.alias("error")).where("error is not null")


def list_kind(page: Column) -> Column:
    """What a list page is: shell (too short), unitbuild, recordset, html-static (five detail links) or js-render."""
    details = F.filter(F.regexp_extract_all(page, F.lit("href=[\"']([^\"']+)[\"']"), F.lit(1)), lambda h: h.rlike(r"/(?:art|content|detail|info|t\d{8}_\d+|20\d{2}/)"))
    return (
        F.when(F.length(page) < 2000, "shell").when(page.rlike(r"(?i)AuthorizedRead[^\"']*unitbuild") | F.contains(page, F.lit("unitbuild.js")), "unitbuild")
        .when(F.contains(page, F.lit("<recordset>")) & F.contains(page, F.lit("<a ")), "recordset").when(F.size(F.array_distinct(details)) >= 5, "html-static").when(page.isNotNull(), "js-render")
    )


def new_links(found: DataFrame, records: DataFrame) -> DataFrame:
    """The found links (source_id, url, …) that have no record of (source_id, page_url) yet."""
    known = records.select("source_id", F.col("page_url").alias("url"))
    return found.join(known, ["source_id", "url"], "left_anti")
