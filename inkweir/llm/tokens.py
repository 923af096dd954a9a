"""Encoding with a public byte-level BPE vocabulary: vectorised pre-tokenisation and cached pair merging.

Texts of a batch become one array of code points; each has a class (letter, number, space, other, apostrophe or one
of the letters of contractions). Whether a piece starts depends on a character, its neighbours and contractions, so
boundaries follow from comparing shifted arrays, without a regular expression; only quotes are walked in order. The slices
between boundaries are merged once per distinct slice; `spans` keeps the characters that each token covers.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("INKWEIR_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
CACHE = 400_000
LONG_PIECE = 400


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: letters \\p{L}, numbers \\p{N}, white space, the rest."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        k = unicodedata.category(chr(cp))[0]
        if k == "L":
            out[cp] = LETTER
        elif k == "N":
            out[cp] = NUMBER
    for cp in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[cp] = SPACE
    return out


def starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where pieces start. codes: code points of joined texts; first: True where a text starts.

    The grammar: contractions ('s 't 're 've 'm 'll 'd); an optional blank and a run of letters, numbers or others;
    white space, of which the last character is left to the next piece where that isn't white space.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[codes]
    prev = np.empty(n, dtype=np.uint8)
    prev[0], prev[1:] = 255, kind[:-1]
    prev[first] = 255
    blank = np.zeros(n, dtype=bool)  # the character before is a blank of the same text
    blank[1:] = codes[:-1] == 32
    blank[first] = False
    space = kind == SPACE
    run = kind != prev  # a run of one class starts
    start = run.copy()
    # A word takes the one blank before it: then it starts there.
    joined = run & ~space & blank
    at = np.flatnonzero(joined)
    start[at] = False
    start[at - 1] = True
    # White space before something else of the same text leaves its last character.
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= last
    # Contractions: the quote begins a piece unless a blank, another sign or a quote's run took it.
    quotes = np.flatnonzero(codes == 39)
    if len(quotes):
        ends = np.append(np.flatnonzero(first)[1:], n)
        text_end = ends[np.searchsorted(ends, quotes, "right")]
        for q, end in zip(quotes.tolist(), text_end.tolist()):
            if not start[q]:
                continue
            c = codes[q + 1 : min(q + 3, end)].tolist()
            size = 1 if c and c[0] in (115, 116, 109, 100) else 2 if len(c) == 2 and c in ([114, 101], [118, 101], [108, 108]) else 0
            if size:
                start[q + 1 : q + 1 + size] = False
                if (after := q + 1 + size) < end and kind[after] != SPACE:
                    start[after] = True
                elif after < end:
                    start[after] = True
    return np.flatnonzero(start | first)


class Encoder:
    """Ids of texts by one vocabulary file; merges of pieces are kept in a bounded cache."""

    def __init__(self, path: str = VOCABULARY, cache: int = CACHE) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.cache, self.limit = {}, cache
        try:  # the library's pair merging of a single piece; merge() is the same in Python
            import tiktoken

            self._merge = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        except ImportError:
            self._merge = lambda s: self.merge(s.encode())

    def merge(self, piece: bytes) -> list[int]:
        """Pair merging by lowest rank, leftmost first."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def ids(self, piece: str) -> bytes:
        """The ids of a piece as packed 32-bit integers."""
        if len(self.cache) >= self.limit:
            self.cache.clear()
        got = array("i", self._merge(piece)).tobytes()
        if len(piece) <= LONG_PIECE:
            self.cache[piece] = got
        return got

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text; [] for null and empty texts."""
        return [np.frombuffer(x, dtype=np.int32).tolist() for x in self.packed(texts)]

    def packed(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers; empty for null and empty texts."""
        own = [x or "" for x in texts]
        lengths = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        joined = "".join(own)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        first = np.zeros(len(codes), dtype=bool)
        first[begins[lengths > 0]] = True
        at = starts(codes, first)
        per_text = np.searchsorted(at, begins).tolist() + [len(at)]
        edges = at.tolist() + [len(codes)]
        ids, cache = self.ids, self.cache
        out = []
        for k, n in enumerate(lengths.tolist()):
            row = []
            if n:
                for i in range(per_text[k], per_text[k + 1]):
                    piece = joined[edges[i] : edges[i + 1]]
                    row.append(cache.get(piece) or ids(piece))
            out.append(b"".join(row))
        return out

    def spans(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """(ids, starts, ends) of a text: where each token's bytes begin and end, in characters from 0. A token that holds a
        part of a character spans it whole."""
        ids = self.encode([text])[0]
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        ends = np.cumsum([len(self.bytes_of(i)) for i in ids], dtype=np.int64)
        at = np.cumsum((raw & 0xC0) != 0x80)  # the character, from 1, of each byte
        return ids, (at[np.concatenate([[0], ends[:-1]]).astype(np.int64)] - 1).tolist() if ids else [], at[ends - 1].tolist() if ids else []

    def bytes_of(self, token: int) -> bytes:
        if not hasattr(self, "_bytes"):
            self._bytes = {v: k for k, v in self.ranks.items()}
        return self._bytes[token]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; exact for ids made by encode()."""
        return b"".join(map(self.bytes_of, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> Encoder:
    return Encoder(path)


def _strings(column: pa.Array, most: int = 2_000_000) -> Iterator[list[str | None]]:
    """Slices of a column of at most `most` characters, or single longer texts, so that a batch's arrays stay small."""
    values, held, size = column.to_pylist(), [], 0
    for v in values:
        if held and size + len(v or "") > most:
            yield held
            held, size = [], 0
        held.append(v)
        size += len(v or "")
    if held:
        yield held


def token_ids(text: Column, path: str = VOCABULARY) -> Column:
    """array<int> of token ids without special tokens; an empty list for null and empty texts. Row-local."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        for column in batches:
            flat, sizes = [], [0]
            for part in _strings(column):
                for row in e.packed(part):
                    flat.append(row)
                    sizes.append(sizes[-1] + len(row) // 4)
            yield pa.ListArray.from_arrays(pa.array(np.array(sizes, dtype=np.int32)), pa.array(np.frombuffer(b"".join(flat), dtype=np.int32)))

    return run(text)


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text as int; 0 for null and empty texts."""

    @F.arrow_udf("int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        for column in batches:
            yield pa.array([len(row) // 4 for part in _strings(column) for row in e.packed(part)], pa.int32())

    return run(text)


def token_spans(text: Column, path: str = VOCABULARY) -> Column:
    """struct(ids, starts, ends): token ids with the characters, from 0, each one covers; empty lists for null and empty texts."""

    @F.pandas_udf("ids array<int>, starts array<int>, ends array<int>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([encoder(path).spans(x) for x in s], columns=["ids", "starts", "ends"])

    return run(text)


def encode_corpus(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids) for every row of `df`; no shuffle."""
    return df.select(F.col(f"`{key}`"), token_ids(F.col(f"`{text}`"), path).alias("ids"))
