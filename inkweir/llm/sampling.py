"""Bounded samples for fitting: rows whose hash falls under a share chosen from counts, so that what reaches the driver
is about the bound, however many tasks read the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINE = 1 << 30
#: Rows, by hash from the whole table, among which the kinds of rows are told apart and counted.
POOL = 50_000


def under(h: Column, share: float) -> Column:
    """Whether a 64-bit hash falls under a share."""
    return F.pmod(h, F.lit(FINE)) < int(min(1.0, share) * FINE)


def sample(df: DataFrame, h: Column, n: int, order: list[str], total: int | None = None) -> list:
    """At most `n` rows, those of the smallest hashes of a share that holds about twice as many; n are met or all taken."""
    total = df.count() if total is None else total
    rows = df if total <= 2 * n else df.where(under(h, 2 * n / total))
    return rows.orderBy(F.pmod(h, F.lit(FINE)), *order).limit(n).collect()


def sample_kinds(df: DataFrame, kind: Column, h: Column, bounds: dict[int, int], columns: list[str]) -> dict[int, list]:
    """For each kind of row at most its bound, by hash, from a pool of about POOL rows of the whole table (all of a smaller
    one). The kinds are counted in the pool, then a second scan of it takes the rows; telling kinds apart may be costly."""
    total = df.count()
    part = min(1.0, POOL / max(1, total))
    seen = {r["kind"]: r["n"] for r in df.where(under(h, part)).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {k: part * min(1.0, 1.5 * n / max(1, seen.get(k, 0))) for k, n in bounds.items()}
    take = F.lit(False)
    for k, share in shares.items():
        take = take | (F.col("kind") == k) & under(F.col("h"), share)
    rows = df.where(under(h, max(shares.values()))).select(kind.alias("kind"), h.alias("h"), *columns).where(take).collect()
    out: dict[int, list] = {k: [] for k in bounds}
    for r in sorted(rows, key=lambda r: r["h"] % FINE):
        if len(out[r["kind"]]) < bounds[r["kind"]]:
            out[r["kind"]].append(r)
    return out
