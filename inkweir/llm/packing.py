"""Filling fixed-capacity containers: bulk-synchronous best fit on size classes.

Documents and gaps are sorted by size; sizes are whole numbers up to the capacity, so a sorted range is a size class
with a count and both tables stay as small as the capacity, whatever the corpus. Each superstep takes the largest
class left, sweeps the gap classes from its successor (the smallest gap that takes it) upwards, gives the places out by
rank (all documents of a class at once, no two the same place) and updates the gaps. The result equals sequential
best-fit decreasing. The plan maps (size, rank in its class) to a container; ranks are dealt out in parallel.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweir.llm.tokens import VOCABULARY, token_count
from inkweir.session import cut

CAPACITY = 4096
#: Documents of one size are ranked in groups of about this many.
RANKED_TOGETHER = 200_000


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best fit decreasing of `counts` (size -> number of items). Returns its steps and the number of containers.

    Step: size, first rank, number of items, first container, items per container, tokens and items already in each.
    """
    gaps: list[int] = []
    free: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # gap -> [(first container, containers, items in each)]
    steps, used = [], 0

    def give(gap: int, first: int, n: int, items: int) -> None:
        if n and gap:
            if not free[gap]:
                insort(gaps, gap)
            free[gap].append((first, n, items))

    for size in sorted((s for s in counts if s > 0), reverse=True):
        rank, left = 0, counts[size]
        while left:
            i = bisect_left(gaps, size)
            if i == len(gaps):
                per = capacity // size
                first, n, items, gap = used, -(-left // per), 0, capacity
                used += n
            else:
                gap = gaps[i]
                first, n, items = free[gap].pop()
                if not free[gap]:
                    gaps.pop(i)
                per = gap // size
            take = min(left, n * per)
            whole, rest = divmod(take, per)
            steps.append((size, rank, take, first, per, capacity - gap, items))
            give(gap - per * size, first, whole, items + per)
            if rest:
                give(gap - rest * size, first + whole, 1, items + rest)
            give(gap, first + whole + bool(rest), n - whole - bool(rest), items)
            rank, left = rank + take, left - take
    return np.array(steps, dtype=np.int64).reshape(-1, 7), used


def ranked(items: DataFrame, size: str, order: list[str], n: int) -> DataFrame:
    """`items` with `rank`: 0.. within its size, dense. A size that most rows share is ranked in groups, in parallel."""
    groups = max(1, n // RANKED_TOGETHER) * 8
    g = items.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    before = g.groupBy(size, "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select(size, "_group", F.expr(f"sum(_n) over (partition by {size} order by _group) - _n").alias("_before"))
    within = g.withColumn("_own", F.expr(f"row_number() over (partition by {size}, _group order by {', '.join(order)}) - 1"))
    return within.join(before, [size, "_group"]).withColumn("rank", F.col("_before") + F.col("_own")).drop("_group", "_own", "_before")


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, part_no, start_unit, n_units, container, place, at_unit) for every row of `sizes`.

    An item over the capacity is cut into parts of exactly the capacity and a rest; no other item is cut. `place` is
    the item's number in its container and `at_unit` where it begins there. Items of size 0 or null take no room and
    are dealt to the containers in turn (container 0 if there are no others). Repeated keys are items of their own;
    an empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    s = F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0))
    parts = sizes.select(F.col(f"`{key}`").alias("key"), s.alias("size")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("size") / capacity) - 1).cast("long"))))
    items = cut(parts.select("key", (F.col("part") + 1).alias("part_no"), (F.col("part") * capacity).alias("start_unit"), F.least(F.col("size") - F.col("part") * capacity, F.lit(capacity)).alias("n_units")))
    counts = {r["n_units"]: r["n"] for r in items.groupBy("n_units").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity + 1 rows at most
    steps, used = plan(counts, capacity)
    begin = steps[:, 0] * (1 << 44) + steps[:, 1]
    by_begin = np.argsort(begin)
    shared = items.sparkSession.sparkContext.broadcast((begin[by_begin], steps[by_begin], max(1, used)))  # a few rows for each size up to the capacity

    @F.pandas_udf("container long, place int, at_unit int")
    def where(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        begins, rows, containers = shared.value
        n, rank = n.to_numpy(np.int64), rank.to_numpy(np.int64)
        if not len(rows):
            return pd.DataFrame({"container": np.zeros(len(n), np.int64), "place": rank.astype(np.int32), "at_unit": np.zeros(len(n), np.int32)})
        r = rows[np.maximum(np.searchsorted(begins, n * (1 << 44) + rank, "right") - 1, 0)]
        k = rank - r[:, 1]
        inside = k % r[:, 4]
        none = n == 0
        return pd.DataFrame({"container": np.where(none, rank % containers, r[:, 3] + k // r[:, 4]), "place": np.where(none, -1, r[:, 6] + inside).astype(np.int32), "at_unit": np.where(none, 0, r[:, 5] + inside * n).astype(np.int32)})

    out = ranked(items, "n_units", ["key", "part_no"], sum(counts.values())).withColumn("at", where("n_units", "rank"))
    return out.select(F.col("key").alias(key), F.col("part_no").cast("int").alias("part_no"), "start_unit", F.col("n_units").cast("int").alias("n_units"), "at.container", "at.place", "at.at_unit")


def pack_texts(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """pack() of the texts of `df`, measured in tokens."""
    return pack(df.select(F.col(f"`{key}`").alias("key"), token_count(F.col(f"`{text}`"), path).alias("size")), "key", "size", capacity).withColumnRenamed("key", key)
