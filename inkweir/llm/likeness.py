"""Shingle sets of texts, their one-permutation sketches and exact Jaccard likeness, vectorised over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space.
BLANKS = (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@dataclass(frozen=True)
class Likeness:
    """What counts as alike. Shingles are `width` characters of the text without white space.

    `bins` hash ranges give the sketch of 16-bit values. Each of `bands` keys starts at a bin of its own; a key is of two
    values, and while it is held by many texts it takes the next value of its band, up to `depth`. What the keys miss is
    measured by simulation (README). Links are exact but for this and the floor below.
    """

    width: int = 5
    threshold: float = 0.6
    least: int = 80
    bins: int = 128
    bands: int = 40
    depth: int = 3
    #: Values (their low bytes) of a sketch that a pair is compared by first.
    glance: int = 64
    #: Pairs whose sketches agree less than this are not compared in full.
    sketch_floor: float = 0.25


@lru_cache(maxsize=1)
def _blank() -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    out[list(BLANKS)] = True
    return out


def codes_of(text: str) -> np.ndarray:
    """Code points of a text without white space."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return c[~_blank()[c]]


def shingles(codes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` characters; empty for a shorter text."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    h.sort()
    keep = np.empty(n, dtype=bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two sorted distinct arrays; 0 if both are empty."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return both / (len(a) + len(b) - both)


@lru_cache(maxsize=4)
def _steps(bins: int) -> np.ndarray:
    """For each bin the order in which other bins lend it a value, the same in every process."""
    return np.array([np.random.Generator(np.random.PCG64(1000 + b)).permutation(bins) for b in range(bins)], dtype=np.int32)


def sketch(h: np.ndarray, bins: int) -> bytes:
    """16-bit minimum of each hash range, low bytes first; an empty range borrows from the first filled one in its own order."""
    edges = (np.arange(bins, dtype=np.uint64) * np.uint64((1 << 64) // bins))
    at = np.searchsorted(h, edges)
    end = np.append(at[1:], len(h))
    filled = at < end
    low = h[np.minimum(at, len(h) - 1)]
    v = ((low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.uint16)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = _steps(bins)[empty]
        v[empty] = v[order[np.arange(len(empty)), np.argmax(filled[order], axis=1)]]
    return (v & 255).astype(np.uint8).tobytes() + (v >> 8).astype(np.uint8).tobytes()


def values_of(sketches: list[bytes] | pd.Series, bins: int) -> np.ndarray:
    """(texts, bins) 16-bit values of sketches."""
    planes = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), 2, bins)
    return planes[:, 0].astype(np.uint16) | (planes[:, 1].astype(np.uint16) << 8)


@lru_cache(maxsize=4)
def _bands(p: Likeness) -> np.ndarray:
    """(bands, depth) bins of each key; the first ones are all different."""
    g = np.random.Generator(np.random.PCG64(7))
    first = g.choice(p.bins, p.bands, replace=False)
    return np.array([[b, *g.choice(np.setdiff1d(np.arange(p.bins), [b]), p.depth - 1, replace=False)] for b in first])


def prefix_keys(values: np.ndarray, p: Likeness) -> np.ndarray:
    """(texts, bands, depth - 1) 64-bit keys of 2 to `depth` values of each band."""
    picked = values[:, _bands(p)].astype(np.uint64)
    out = np.empty((*picked.shape[:2], p.depth - 1), dtype=np.uint64)
    # The band's number lies above the values, else two bands of a text could have one key and the text would meet itself.
    h = np.broadcast_to((np.arange(p.bands, dtype=np.uint64) + np.uint64(1)) << np.uint64(32), picked.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(p.depth):
            h = (h ^ (picked[:, :, k] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            if k:
                out[:, :, k - 1] = h
    return out.view(np.int64)


def routed(keys: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, bands) of each band the shortest key that isn't in the sorted `hot`, and whether even the longest is.

    What a key is depends on its values only, so texts that agree in them have the same key.
    """
    if not len(hot):
        return keys[:, :, 0], np.zeros(keys.shape[:2], dtype=bool)
    at = np.searchsorted(hot, keys.ravel()).clip(max=len(hot) - 1)
    cold = (hot[at] != keys.ravel()).reshape(keys.shape)
    none = ~cold.any(axis=2)
    level = np.where(none, keys.shape[2] - 1, cold.argmax(axis=2))
    return np.take_along_axis(keys, level[:, :, None], axis=2)[:, :, 0], none


def set_of(title: str | None, content: str | None, p: Likeness) -> np.ndarray | None:
    """Shingles of title followed by content; None where the content is too short to take part."""
    if content is None or len(content) < p.least:
        return None
    body = codes_of(content)
    if len(body) < p.least:
        return None
    return shingles(np.concatenate([codes_of(title), body]) if title else body, p.width)


def sketched(df: DataFrame, key: str, title: str, content: str, p: Likeness = Likeness()) -> DataFrame:
    """(key, digest, sketch) of the rows long enough to take part; others have no row. One pass, no shuffle.

    `digest` is of the shingle set: rows with equal digests are alike by 1. `sketch` is binary.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, digests, sketches = [], [], []
            for k, t, c in zip(b["key"], b["title"], b["content"]):
                h = set_of(t, c, p)
                if h is not None and len(h):
                    keys.append(k)
                    digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    sketches.append(sketch(h, p.bins))
            yield pd.DataFrame({"key": keys, "digest": digests, "sketch": sketches})

    own = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{title}`").alias("title"), F.col(f"`{content}`").alias("content"))
    return own.where(F.length("content") >= p.least).mapInPandas(run, "key long, digest binary, sketch binary")


#: Two bits of each of 128 values of a sketch: the last ones (s1, s2) and those before them (s3, s4).
SIGNS = ("s1", "s2", "s3", "s4")
#: Of the 128 last bits of two texts, those that may differ at most; at likeness 0.6 a fifth differ.
BITS = 52
#: Of the 128 values, those that may differ in one of their two bits; at likeness 0.6 three tenths differ.
APART = 66


def signs_of(values: np.ndarray) -> np.ndarray:
    """(texts, 4) the SIGNS of (texts, bins) values."""
    two = np.stack([values & 1, values >> 1 & 1], axis=1)[:, :, :128].astype(np.uint8)
    packed = np.packbits(np.pad(two, ((0, 0), (0, 0), (0, 128 - two.shape[2]))), axis=2)
    return np.ascontiguousarray(packed).reshape(len(values), 32).view(np.int64)


def key_rows(reps: DataFrame, p: Likeness = Likeness(), hot: np.ndarray | None = None, take: str = "cold", more: str = "") -> DataFrame:
    """(key, more, SIGNS, band): a row for each key of (key, sketch) that isn't hot at full length (`cold`), is (`full`), or
    for all. By the signs pairs can be told to be unlike where they meet. `more`: long columns to keep."""
    kept = ["key", *more.split()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            values = values_of(b["sketch"], p.bins)
            keys, full = routed(prefix_keys(values, p), np.zeros(0, dtype=np.int64) if hot is None else hot)
            signs = signs_of(values)
            wanted = ~full if take == "cold" else full if take == "full" else np.ones_like(full)
            n = wanted.sum(axis=1)
            yield pd.DataFrame({**{k: np.repeat(b[k].to_numpy(), n) for k in kept}, **{k: np.repeat(signs[:, i], n) for i, k in enumerate(SIGNS)}, "band": keys[wanted]})

    return reps.select(*kept, "sketch").mapInPandas(run, ", ".join(f"{k} long" for k in (*kept, *SIGNS, "band")))


def alike_signs(mine: tuple[str, ...], other: tuple[str, ...]) -> Column:
    """Whether two rows of SIGNS allow the likeness."""
    x = [F.col(a).bitwiseXOR(F.col(b)) for a, b in zip(mine, other)]
    return (F.bit_count(x[0]) + F.bit_count(x[1]) <= BITS) & (F.bit_count(x[0].bitwiseOR(x[2])) + F.bit_count(x[1].bitwiseOR(x[3])) <= APART)


def whole_groups(batches: Iterator[pd.DataFrame], column: str, most: int | None = None) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Rows that come sorted by `column`, in frames of whole groups (False), or of some rows of groups of more than `most` (True)."""
    held, over = None, None
    for b in batches:
        if over is not None and len(b):
            n = int(np.argmin(np.append(b[column].to_numpy() == over, False)))
            if n:
                yield b[:n], True
            b = b[n:]
        if not len(b):
            continue
        over = None
        held = b if held is None else pd.concat([held, b])
        key = held[column].to_numpy()
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        large = np.repeat(size > (most or len(key)), size)
        done = np.arange(len(key)) < start[-1]
        if large[-1]:
            over, done = key[-1], np.ones_like(done)
        for frame, crowded in ((held[done & large], True), (held[done & ~large], False)):
            if len(frame):
                yield frame, crowded
        held = None if done.all() else held[~done]
    if held is not None:
        yield held, False


def alike_rows(group: np.ndarray, signs: np.ndarray, small: int = 64, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: all rows of the same group, which lie together, whose SIGNS (rows, 4) allow the likeness.

    Small groups are held against themselves moved by one row, two rows and so on, all at once; others in blocks of `cells` pairs.
    """
    s = [np.ascontiguousarray(signs[:, k]).view(np.uint64) for k in range(4)]
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

    def keep(i: np.ndarray, j: np.ndarray, low: np.ndarray) -> None:
        i, j = i[low <= BITS], j[low <= BITS]
        both = np.bitwise_count((s[0][i] ^ s[0][j]) | (s[2][i] ^ s[2][j])) + np.bitwise_count((s[1][i] ^ s[1][j]) | (s[3][i] ^ s[3][j]))
        left.append(i[both <= APART])
        right.append(j[both <= APART])

    if not len(group):
        return left[0], right[0]
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(start, len(group)))
    end = np.repeat(start + size, size)
    i, d = np.flatnonzero((np.arange(len(group)) + 1 < end) & np.repeat(size <= small, size)), 1
    while len(i):
        keep(i, i + d, np.bitwise_count(s[0][i] ^ s[0][i + d]) + np.bitwise_count(s[1][i] ^ s[1][i + d]))
        d += 1
        i = i[i + d < end[i]]
    for a, z in zip(start[size > small], (start + size)[size > small]):
        step = max(1, cells // int(z - a))
        for x in range(a, z, step):
            own = slice(x, min(x + step, z))
            low = np.bitwise_count(s[0][own, None] ^ s[0][None, x:z]) + np.bitwise_count(s[1][own, None] ^ s[1][None, x:z])
            i, j = np.nonzero(low <= BITS)
            i, j = i[i < j] + x, j[i < j] + x
            keep(i, j, np.zeros(len(i), dtype=np.uint8))
    return np.concatenate(left), np.concatenate(right)


def only(rows: DataFrame, keys: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """The rows whose key is in `keys` (distinct, materialised): filtered at the scan if they are few enough to broadcast."""
    return rows.join(F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys, key, "left_semi")


def crowded_keys(sketches: DataFrame, p: Likeness, most: int) -> DataFrame:
    """(key): the keys of two values that more than `most` of the texts (sketch) hold, counted over all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                key, n = np.unique(prefix_keys(values_of(b["sketch"], p.bins), p)[:, :, 0], return_counts=True)
                yield pd.DataFrame({"key": key, "n": n})

    return sketches.select("sketch").mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("key")


def lengthened(rows: DataFrame, p: Likeness = Likeness()) -> DataFrame:
    """(key, SIGNS, band, full) of rows (key, band, sketch): the key of one more value than `band`; the same where it is of full length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            values = values_of(b["sketch"], p.bins)
            keys, band = prefix_keys(values, p), b["band"].to_numpy(np.int64)
            own = keys[:, :, :-1] == band[:, None, None]
            full = ~own.any(axis=(1, 2))
            longer = np.where(own, keys[:, :, 1:], 0).sum(axis=(1, 2))
            yield pd.DataFrame({"key": b["key"], **dict(zip(SIGNS, signs_of(values).T)), "band": np.where(full, band, longer), "full": full})

    return rows.select("key", "band", "sketch").mapInPandas(run, ", ".join(f"{k} long" for k in ("key", *SIGNS, "band")) + ", full boolean")


def agreement(a: Column, b: Column) -> Column:
    """Share of equal values of two sketches, an estimate of the likeness."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        u, v = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (x, y))
        return pd.Series((u == v).mean(axis=1))

    return run(a, b)


def exact(ta: Column, ca: Column, tb: Column, cb: Column, p: Likeness = Likeness()) -> Column:
    """Exact likeness of (title, content) pairs; 0 where a side takes no part."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for w, x, y, z in batches:
            seen: dict[tuple, np.ndarray | None] = {}
            out = []
            for a, b in zip(zip(w, x), zip(y, z)):
                for t in (a, b):
                    if t not in seen:
                        seen[t] = set_of(*t, p)
                u, v = seen[a], seen[b]
                out.append(0.0 if u is None or v is None else jaccard(u, v))
            yield pd.Series(out, dtype=float)

    return run(ta, ca, tb, cb)
