"""URL functions: normal form, source filters and page addresses as native columns, resolution as a pandas UDF."""

from __future__ import annotations

import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_PARTS = r"^\s*(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"
MEDIA = r"(?i)\.(jpg|jpeg|png|gif|css|js|svg)$"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with its mark."""
    return F.regexp_extract(F.trim(url), _PARTS, i)


def normalized(url: Column) -> Column:
    """Trimmed, scheme and authority in lower case, no fragment; path and query as they are. Null for null."""
    scheme, authority, path, query = (part(url, i) for i in (1, 2, 3, 4))
    return F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), F.when(F.trim(url).rlike(r"^[^/?#]*//"), F.concat(F.lit("//"), F.lower(authority))).otherwise(""), path, F.when(query == "?", F.lit("")).otherwise(query)
    )


def host(url: Column) -> Column:
    """Lower-case host without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def path_format(url: Column) -> Column:
    """Extension of the last path segment in lower case, else ''."""
    return F.lower(F.regexp_extract(part(url, 3), r"\.([A-Za-z0-9]+)$", 1))


def allowed(url: Column, origin: Column, include: Column, exclude: Column, hosts: Column | None = None, pattern: Column | None = None) -> Column:
    """Whether a source takes a link.

    A file link needs a file origin. Others need http or https, a host and no user, a host of `hosts` or else the
    origin's, a match of `pattern` if there is one, one of `include` if there are any, none of `exclude`, and a path that
    isn't an image, style or script. Null arrays count as empty; a null URL is not taken.
    """
    scheme, none = F.lower(part(url, 1)), F.array().cast("array<string>")
    own = F.when(host(origin) != "", F.array(host(origin))).otherwise(none)
    hosts_ = own if hosts is None else F.when(F.size(F.coalesce(hosts, none)) > 0, hosts).otherwise(own)
    inc, exc = F.coalesce(include, none), F.coalesce(exclude, none)
    ok = scheme.isin("http", "https") & (host(url) != "") & ~F.contains(part(url, 2), F.lit("@"))
    ok &= (F.size(hosts_) == 0) | F.array_contains(hosts_, host(url))
    if pattern is not None:
        ok &= (F.coalesce(pattern, F.lit("")) == "") | F.regexp(url, F.coalesce(pattern, F.lit("")))
    ok &= (F.size(inc) == 0) | F.exists(inc, lambda k: F.contains(url, k))
    ok &= ~F.exists(exc, lambda k: F.contains(url, k)) & ~part(url, 3).rlike(MEDIA)
    return F.coalesce(F.when(scheme == "file", F.lower(part(origin, 1)) == "file").otherwise(ok), F.lit(False))


@F.pandas_udf(StringType())
def absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link resolved against its page; null where either is null or the link can't be read."""

    def one(b: str | None, x: str | None) -> str | None:
        try:
            return None if b is None or x is None else urllib.parse.urljoin(b, x)
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


@F.pandas_udf(StringType())
def unquoted(s: pd.Series) -> pd.Series:
    """Percent escapes decoded, plus signs kept."""
    return s.map(lambda x: None if x is None else urllib.parse.unquote(x))


def page_urls(list_url: Column, pagination: Column, pages: Column) -> Column:
    """array<struct<page,url>> of a source's list pages.

    `trs`: the list URL, then index_1.html and so on beside it; {page} and {page0} in the URL are filled in; else the
    same URL for every page.
    """
    folder = F.regexp_replace(list_url, r"[^/]*(\?[^#]*)?(#.*)?$", "")

    def one(i: Column) -> Column:
        n0 = (i - 1).cast("string")
        filled = F.replace(F.replace(list_url, F.lit("{page0}"), n0), F.lit("{page}"), i.cast("string"))
        url = F.when(F.coalesce(pagination, F.lit("")) != "trs", filled).when(i == 1, list_url).otherwise(F.concat(folder, F.lit("index_"), n0, F.lit(".html")))
        return F.struct(i.alias("page"), url.alias("url"))

    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce(pages, F.lit(1)).cast("int"))), one)
