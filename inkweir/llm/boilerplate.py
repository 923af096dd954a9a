"""Page furniture mixed with main content: nearest-URL page differencing.

Pages are ordered by host and URL path; each is compared with the NEAR pages before and after it of the same host. Their
lines, reduced to shapes (markup and digits gone), are aligned by a longest common subsequence, and each aligned line has
the vote of that neighbour. Lines that half of the neighbours share are deleted, sentences too; signatures, dates,
salutations and headings, which documents of one office share, are not. What the alignment finds also trains a naive
Bayes model of furniture, which settles lines that few or no neighbours share. Of markup pages the main body is the run of
lines in which document text outweighs furniture.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweir.llm import residue
from inkweir.llm.sampling import sample as bounded

#: Pages, neighbours by URL, from which the model of furniture is learned.
SAMPLE = 3000

#: Characters by which lines of variable filling are compared; bigrams of a telling stretch and their least mean log odds.
FRAME, STRETCH, TELLING = 4, 4, 2.0
#: Neighbours on each side; shared lines go if this share of at least this many neighbours has them.
NEAR, MOST, LEAST = 4, 0.5, 3

_HIDDEN = re.compile(r"<(script|style|noscript|title|select)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<!\[CDATA\[.*?\]\]>", re.I | re.S)
_LINK = re.compile(r"<a\b[^<>]*>([^\n]*?)</a\s*>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_NUMBERS = re.compile(r"\d+(?:\.\d+)?")
_TEASER = re.compile(r"<a\b[^<>]*>\s*[\[【（(<]?[^<>\n]{1,6}[\]】）)>]?\s*</a\s*>\s*(?:</[a-z0-9]+>\s*)*$", re.I)
#: Blocks at which a page written in few lines is taken apart.
_BLOCK = re.compile(r"(?i)(?=</?(?:p|div|li|h[1-6]|tr|section|article|header|footer|nav|ul|ol|table|main|aside)\b)|(?=<br\b)")
_SENTENCE = re.compile(r".*[。！？!?…]$|.{16,}[.;；]$")
# Fixed forms of document text.
_TEXT = re.compile(
    r".*[。；！？;!?…]$|.{16,}\.$|[一二三四五六七八九十百]+、.{1,30}|第[一二三四五六七八九十百零\d]+[条章节款].*|[（(][一二三四五六七八九十\d]+[）)].{2,}|\d{1,3}[.．、]\s?.{6,}|[^\n|>]{2,60}[：，:,]"
    r"|\d{2,4}年(?:\d{1,2}(?:月(?:\d{1,2}日?)?)?)?|[一二〇○零二三四五六七八九]{4}年[一二三四五六七八九十]{1,2}月[一二三四五六七八九十]{1,3}日|[一-鿿]{2,24}(?:局|厅|廳|委|委员会|委員會|办公室|辦公室|政府|部|院|署|局、[一-鿿]+)"
)


@dataclass
class Page:
    """The lines of a page: visible text, shape, and whether markup makes the line a list of links or a teaser."""

    lines: list[str]
    shapes: list[str]
    links: list[bool]
    form: list[bool]
    #: The number of each line between line feeds, from 1; a page without line feeds is read in blocks.
    numbers: list[int]


def read(text: str, markup: bool) -> Page:
    """Lines of a text or of a stored page. Line numbers are those between line feeds; a line of markup that holds most of
    the page is read as the blocks it consists of, all with its number."""
    if not markup:
        lines = [x.strip() for x in text.split("\n")]
        return _page(lines, [False] * len(lines), list(range(1, len(lines) + 1)))
    text = text.lstrip("\ufeff")
    lines = text.split("\n")
    large = [2 * len(x) > len(text) and len(_BLOCK.split(x)) > 3 for x in lines]
    if any(large):
        parts = [(b, k) for k, x in enumerate(lines, 1) for b in (_BLOCK.split(_HIDDEN.sub("", x)) if large[k - 1] else [x])]
        page = _markup("\n".join(b for b, _ in parts))
        return Page(page.lines, page.shapes, page.links, page.form, [k for _, k in parts])
    return _markup(text)


def _markup(text: str) -> Page:
    clean = _HIDDEN.sub(lambda m: "\n" * m.group().count("\n"), text)
    raw = clean.split("\n")
    shown = [x.strip() for x in _html.unescape(_TAG.sub("", clean)).replace("\xa0", " ").split("\n")]
    if len(shown) != len(raw):  # a tag spans lines
        shown = [_html.unescape(_TAG.sub("", x)).replace("\xa0", " ").strip() for x in raw]
    bare = [_TAG.sub("", _LINK.sub("", x)).strip() if "<a" in x or "<A" in x else x for x in raw]
    links = [bool(s) and (not b or _TEASER.search(x) is not None) for s, b, x in zip(shown, bare, raw)]
    return _page(shown, links, list(range(1, len(shown) + 1)))


def document_form(line: str) -> bool:
    return _TEXT.fullmatch(line) is not None


def _page(lines: list[str], links: list[bool], at: list[int]) -> Page:
    """A line of another form than document text is compared by how it begins, the rest being its filling."""
    form = [bool(x) and not k and document_form(x) for x, k in zip(lines, links)]
    numbers = _NUMBERS.sub("0", "\n".join(lines)).split("\n")
    return Page(lines, [x if f else x[:FRAME] for x, f in zip(numbers, form)], links, form, at)


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of the non-blank entries (Hunt and Szymanski)."""
    where: dict[str, list[int]] = defaultdict(list)
    for j, s in enumerate(b):
        if s:
            where[s].append(j)
    tails: list[int] = []
    links: list[tuple[int, int, object]] = []
    for i, s in enumerate(a):
        for j in reversed(where.get(s, ())) if s else ():
            k = bisect_left(tails, j)
            node = (i, j, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(node)
            else:
                tails[k] = j
                links[k] = node
    out = []
    node = links[-1] if links else None
    while node:
        out.append((node[0], node[1]))
        node = node[2]
    return out[::-1]


def line_scores(lines: list[str], odds: np.ndarray) -> tuple[list[float], list[float]]:
    """Mean log odds of furniture of each line, and of its most telling stretch of a few characters."""
    w = odds[residue.slots(residue.fold("\n".join(lines)))]
    total = np.concatenate([[0.0], np.cumsum(w, dtype=np.float64)])
    sizes = np.array([len(x) for x in lines])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = np.minimum(begins + np.maximum(sizes - 1, 0), len(w))
    begins = np.minimum(begins, ends)
    runs = np.append(total[STRETCH:] - total[:-STRETCH], [-9.0]) / STRETCH if len(w) >= STRETCH else np.array([-9.0])
    tops = [float(runs[a : b - STRETCH + 1].max()) if b - a >= STRETCH else -9.0 for a, b in zip(begins.tolist(), ends.tolist())]
    return ((total[ends] - total[begins]) / np.maximum(1, sizes - 1)).tolist(), tops


def furniture(page: Page, votes: Counter[int], near: int, odds: np.ndarray) -> list[bool]:
    """Which lines are furniture. votes: the neighbours, of `near`, that share each line; blank lines aren't furniture."""
    out = list(page.links)
    forms = [i for i, x in enumerate(page.form) if x]
    first, last = (forms[0], forms[-1]) if forms else (0, len(page.lines))
    open_ = [i for i, x in enumerate(page.lines) if x and not page.links[i] and (not page.form[i] or votes[i] > 1 and _SENTENCE.fullmatch(x))]
    if open_:
        for i, mean, top in zip(open_, *line_scores([page.lines[i] for i in open_], odds)):
            most = votes[i] >= max(LEAST, MOST * near)
            if page.form[i]:
                out[i] = most or mean > 0
            else:
                out[i] = most or mean > 0 or top > TELLING or ((votes[i] > 0 or not first < i < last) and mean > -1.0)
    return out


def body(page: Page, drop: list[bool]) -> list[int]:
    """Positions of the document's lines in a markup page: the best run, without the furniture inside it. A short run
    counts if it is most of what isn't furniture."""
    weights = []
    for line, bad, form in zip(page.lines, drop, page.form):
        weights.append(0.0 if not line else -1.0 if bad else 1.5 + (len(line) > 30) if form else -1.0)
    best, start, run, where = 0.0, 0, 0.0, (0, -1)
    for i, w in enumerate(weights):
        run += w
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, where = run, (start, i)
    kept = [i for i in range(where[0], where[1] + 1) if page.lines[i] and not drop[i] and (weights[i] > 0 or len(page.lines[i]) > 12)]
    size = lambda at: sum(len(page.lines[i]) for i in at)
    return kept if best >= 3 or 2 * size(kept) > size(i for i, d in enumerate(drop) if not d) else []


def pages(df: DataFrame, tbl: str, key: str, url: str | Column, text: str, markup: bool, title: str | None = None) -> DataFrame:
    """(tbl, key, host, path, markup, title, text) with the URL taken apart."""
    u = F.col(f"`{url}`") if isinstance(url, str) else url
    return df.select(
        F.lit(tbl).alias("tbl"), F.col(f"`{key}`").cast("string").alias("key"), F.lower(F.regexp_extract(u, r"^(?:[a-z]+:)?/{0,2}([^/?#]*)", 1)).alias("host"), F.regexp_extract(u, r"^(?:[a-z]+:)?/{0,2}[^/?#]*([^?#]*)", 1).alias("path"),
        F.lit(markup).alias("markup"), (F.col(f"`{title}`") if title else F.lit(None).cast("string")).alias("title"), F.col(f"`{text}`").alias("text"),
    )


def voted(rows: Iterable[tuple], read_page: Callable[[tuple], tuple[tuple, Page]]) -> Iterator[tuple[tuple, Page, Counter[int], int]]:
    """(row, page, votes, neighbours) of rows in the order of URLs; `read_page` gives the host and the page of a row."""
    held: deque[list] = deque()
    for row in rows:
        host, page = read_page(row)
        if held and held[-1][1] != host:
            yield from ((r, p, v, n) for r, _, p, v, n in held)
            held.clear()
        now = [row, host, page, Counter(), 0]
        for other in held:
            for i, j in common(other[2].shapes, page.shapes):
                other[3][i] += 1
                now[3][j] += 1
            other[4] += 1
            now[4] += 1
        held.append(now)
        if len(held) > NEAR:
            r, _, p, v, n = held.popleft()
            yield r, p, v, n
    yield from ((r, p, v, n) for r, _, p, v, n in held)


def learn(rows: list[tuple[str, str, bool, str]]) -> np.ndarray:
    """Log odds of furniture from (tbl, host, markup, text) in the order of URLs."""
    yes, no, rest = [], [], []
    for _, page, votes, _ in voted(rows, lambda r: (r[:2], read(r[3], r[2]))):
        for i, line in enumerate(page.lines):
            if line and not page.links[i]:
                s = residue.slots(residue.fold(line))
                if len(s):
                    (no if page.form[i] else yes if votes[i] else rest).append(s)
    return residue.fit_odds(yes, rest, negative=no, start=0.5)


def fit(all_pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Learn from at most `sample` pages, half of each kind, in runs of neighbouring URLs taken by their hash."""
    run = F.xxhash64("host", F.regexp_replace("path", r"[^/]?(\.[a-z]+)?$", ""))
    out = []
    for markup in (True, False):
        own = all_pages.where((F.col("markup") == markup) & (F.length("text") > 0)).select("tbl", "host", "markup", "text", "path", "key", run.alias("h"))
        rows = bounded(own, F.col("h"), sample // 2, ["host", "path", "key"])
        out += [(r["tbl"], r["host"], r["markup"], r["text"]) for r in rows]
    return learn(out)


def differenced(all_pages: DataFrame, odds: np.ndarray | None = None, errors: residue.Model | None = None) -> DataFrame:
    """(tbl, key, kept, dropped, body): for each page the numbers, from 1, of its document lines and its furniture lines,
    and the document lines without markup.

    One exchange: ranges of the order by host and path, so that a host of any size spreads over tasks; neighbours are
    those of the range. With `errors`, a stored page that is an error keeps no line, and a text that is template residue
    or an error loses none. A null or empty text has no row; repeated pages are pages of their own.
    """
    spark = all_pages.sparkSession
    shared_model = spark.sparkContext.broadcast((fit(all_pages) if odds is None else odds, errors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, errors = shared_model.value

        def finish(row: tuple, page: Page, votes: Counter[int], near: int) -> tuple:
            tbl, key, host, markup, title, text = row
            keep = [i for i, s in enumerate(page.lines) if s]
            if errors is not None and residue.verdict(title, "\n".join(page.lines) if markup else text, errors)[0]:
                keep, drop = ([] if markup else keep), []
            else:
                drop = furniture(page, votes, near, weights)
                keep = body(page, drop) if markup else [i for i in keep if not drop[i]]
            number = lambda at: sorted({page.numbers[i] for i in at})
            return tbl, key, number(keep), number(i for i, d in enumerate(drop) if d), "\n".join(page.lines[i] for i in keep)

        rows = (r for b in batches for r in zip(b["tbl"], b["key"], b["host"], b["markup"], b["title"], b["text"]))
        out = []
        for x in voted(rows, lambda r: ((r[0], r[2]), read(r[5], r[3]))):
            out.append(finish(*x))
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=["tbl", "key", "kept", "dropped", "body"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["tbl", "key", "kept", "dropped", "body"])

    order = ["tbl", "host", "path", "key"]
    near = all_pages.where(F.length("text") > 0).repartitionByRange(*order).sortWithinPartitions(*order)
    return near.mapInPandas(run, "tbl string, key string, kept array<int>, dropped array<int>, body string")


def body_texts(all_pages: DataFrame, odds: np.ndarray | None = None, errors: residue.Model | None = None) -> DataFrame:
    """(tbl, key, text): the kept lines of each page, markup taken off; a null or empty text stays what it is."""
    found = differenced(all_pages, odds, errors).select("tbl", "key", F.col("body").alias("text"))
    return found.unionByName(all_pages.where(F.coalesce(F.length("text"), F.lit(0)) == 0).select("tbl", "key", "text"))
