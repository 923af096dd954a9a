"""Splitting oversized texts at natural boundaries with an overlap, by dynamic programming.

Boundaries are paragraph, sentence and clause ends and, inside stretches without any, fixed steps. For each text the
cheapest chain of cuts is chosen: a penalty for the kind of each cut plus the squared deviation of each piece from the
even size, subject to the maximum length (the overlap included) and to the overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAGRAPH, SENTENCE, CLAUSE, HARD = 0, 1, 2, 3
KINDS = ("paragraph", "sentence", "clause", "hard")
PENALTY = (0.0, 0.15, 1.5, 4.0)
#: Characters by which a forced cut may move off a combining sequence.
SHIFT = 8
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
_STOP = re.compile(rf"(?P<line>(?:\r\n|[{LINE_BREAKS}])+)|(?P<mark>[。！？；!?;]+)[”’」』）)\"']*|\.(?= )")
_CLAUSE = re.compile(r"[，、：,:\t |]+")


@dataclass(frozen=True)
class Limits:
    """Sizes in characters. `step`: distance of the forced cut positions in stretches without boundaries."""

    size: int = 2000
    overlap: int = 200
    step: int = 50

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.size or self.step < 1:
            raise ValueError("0 <= overlap < size and step >= 1 are required")


def stops(text: str) -> tuple[dict[int, int], int]:
    """({position: kind} of the natural boundaries, length of the longest stretch without any) by one scan.

    A boundary lies behind the marks and what closes a quotation; the stretch after it begins behind the marks.
    """
    kind: dict[int, int] = {}
    longest = begin = 0
    for m in _STOP.finditer(text):
        line, mark = m.start("line"), m.start("mark")
        longest = max(longest, (m.start() if line >= 0 or mark >= 0 else m.end()) - begin)
        begin = m.end("mark") if mark >= 0 else m.end()
        kind[m.end()] = PARAGRAPH if line >= 0 else SENTENCE
    return kind, max(longest, len(text) - begin)


def boundaries(text: str, limits: Limits) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, kinds, longest stretch): where a piece may end, rising; the end of the text is the last."""
    n = len(text)
    kind, longest = stops(text)
    kind[n] = PARAGRAPH
    room = limits.size - limits.overlap
    step = max(1, min(limits.step, room // 2))
    edges = [0, *sorted(kind)]
    for a, b in zip(edges, edges[1:]):
        if b - a > room // 2:
            inner = [m.end() for m in _CLAUSE.finditer(text, a, b) if a < m.end() < b]
            for p in inner:
                kind[p] = CLAUSE
            for x, y in zip([a, *inner], [*inner, b]):
                if y - x > room // 4:
                    for p in range(x + step, y, step):
                        low = max(x + 1, p - min(SHIFT, step - 1))
                        while p > low and (unicodedata.combining(text[p]) or text[p] in "‍️" or text[p - 1] == "‍"):
                            p -= 1
                        kind.setdefault(p, HARD)
    at = np.array(sorted(kind), dtype=np.int64)
    return at, np.array([kind[p] for p in at.tolist()], dtype=np.int64), longest


def plan(text: str, limits: Limits = Limits()) -> tuple[list[tuple[int, int, int, int]], int]:
    """([(start, end, overlap, kind of the cut at the end)], longest stretch); pieces cover the text without gaps.

    start is where the piece begins, its overlap included; without the overlaps the pieces join to the text. Every piece
    but the first repeats 1 to `limits.overlap` characters of the one before. A text within the limit, the empty one
    included, is one piece.
    """
    n = len(text)
    if n <= limits.size:
        return [(0, n, 0, PARAGRAPH)], stops(text)[1]
    at, kind, longest = boundaries(text, limits)
    # What each next piece repeats: from the first natural boundary in the last `overlap` characters, else all of them.
    natural = at[kind <= SENTENCE]
    first = np.searchsorted(natural, at - limits.overlap, "left")
    repeat = np.where((first < len(natural)) & (natural[np.minimum(first, len(natural) - 1)] < at), at - natural[np.minimum(first, len(natural) - 1)], limits.overlap)
    repeat = np.minimum(repeat, at)
    starts, overlaps = np.concatenate([[0], at]), np.concatenate([[0], repeat])
    even = n / np.ceil(n / (limits.size - limits.overlap / 2))
    m = len(at)
    # (end - begin - even)^2 is expanded, so that each step takes one product, one sum and one minimum over its window.
    begin = (starts - overlaps) / limits.size
    cost = np.full(m + 1, np.inf)
    cost[0] = 0.0
    back = [0] * (m + 1)
    lows = np.searchsorted(starts - overlaps, at - limits.size, "left").tolist()
    ends, pay = ((at - even) / limits.size).tolist(), np.array(PENALTY)[kind].tolist()
    for j in range(1, m + 1):
        c, lo = ends[j - 1], lows[j - 1]
        x = cost[lo:j] - (2 * c) * begin[lo:j]
        k = int(x.argmin())
        back[j] = lo + k
        cost[j] = x[k] + c * c + pay[j - 1] + begin[j] ** 2
    out, j = [], m
    while j:
        i = back[j]
        o = int(overlaps[i])
        out.append((int(starts[i]) - o, int(at[j - 1]), o, int(kind[j - 1])))
        j = i
    return out[::-1], longest


def cuts(text: str, limits: Limits = Limits()) -> list[tuple[int, int, int, int]]:
    """The pieces of plan()."""
    return plan(text, limits)[0]


SUMMARY = "pieces array<struct<start_pos:int,end_pos:int,overlap:int,cut:string>>, longest_stretch int"


def plan_cuts(text: Column, limits: Limits = Limits()) -> Column:
    """Struct (pieces, longest_stretch) of a text over the limit; nulls for null."""

    @F.pandas_udf(SUMMARY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            made = [(None, None) if x is None else ([(a, b, o, KINDS[k]) for a, b, o, k in got], longest) for x in s for got, longest in [plan(x, limits) if x is not None else (None, None)]]
            yield pd.DataFrame(made, columns=["pieces", "longest_stretch"])

    return run(text)


def split_long(df: DataFrame, text: str, limits: Limits = Limits()) -> DataFrame:
    """`df` with a column `split`: struct (pieces, longest_stretch).

    Row-local, one scan, no shuffle. Only texts over the limit go to Python; a text within it is one piece made in
    the JVM. A null text has a null split; an empty one has one empty piece. `longest_stretch` is given for texts
    over the limit.
    """
    t = F.col(f"`{text}`")
    long = F.length(t) > limits.size
    whole = F.array(F.struct(F.lit(0).alias("start_pos"), F.length(t).alias("end_pos"), F.lit(0).alias("overlap"), F.lit(KINDS[0]).alias("cut")))
    made = df.withColumn("split", plan_cuts(F.when(long, t), limits))
    return made.withColumn("split", F.when(long, F.col("split")).when(t.isNotNull(), F.struct(whole.alias("pieces"), F.lit(None).cast("int").alias("longest_stretch"))))


def pieces(df: DataFrame, keys: list[str], text: str, limits: Limits = Limits()) -> DataFrame:
    """(keys, piece_no, n_pieces, start_pos, overlap, cut, piece): the numbered pieces of every non-null text."""
    s = split_long(df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("text")), "text", limits)
    e = s.select(*keys, "text", F.size("split.pieces").alias("n_pieces"), F.posexplode("split.pieces").alias("no", "p"))
    return e.select(*keys, (F.col("no") + 1).alias("piece_no"), "n_pieces", "p.start_pos", "p.overlap", "p.cut", F.expr("substring(text, p.start_pos + 1, p.end_pos - p.start_pos)").alias("piece"))


def oversized(df: DataFrame, key: str, text: str, limits: Limits = Limits()) -> DataFrame:
    """(key, kind) of the texts that were split: `unbroken` if a stretch without boundaries exceeds the limit, else `splittable`."""
    s = split_long(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", limits).where(F.size("split.pieces") > 1)
    return s.select("key", F.when(F.col("split.longest_stretch") > limits.size, "unbroken").otherwise("splittable").alias("kind"))
