"""Helpers for keys that may hold a large part of all rows: no window or group of theirs is one task's work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key whose order numbers fall in the same block of this many are counted in one task.
BLOCK_BITS = 20


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match null keys; the right side's other columns are added."""
    names = {k: f"_r_{k}" for k in keys}
    r = right.select(*[F.col(k).alias(names[k]) if k in names else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[names[k]]) for k in keys])
    return left.join(r, on, how).drop(*names.values())


def running_count(df: DataFrame, keys: list[str], seq: str, flag: Column, name: str, bits: int = BLOCK_BITS) -> DataFrame:
    """`df` with the number of flagged rows of the key up to each row in the order of `seq` (whole numbers).

    Rows are counted inside blocks of the order and the blocks' totals are summed up, so a hot key is spread over tasks.
    """
    d = df.withColumn("_block", F.shiftright(F.col(seq).cast("long"), bits)).withColumn("_flag", F.when(flag, 1).otherwise(0))
    d = d.withColumn("_own", F.sum("_flag").over(Window.partitionBy(*keys, "_block").orderBy(seq)))
    totals = d.groupBy(*keys, "_block").agg(F.sum("_flag").alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_total")).drop("_total")
    return matched(d, before, [*keys, "_block"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_block", "_flag", "_own", "_before")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order: a partial aggregate, no window. Ties go to the smallest row."""
    rest = [c for c in df.columns if c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_x")).select("_x.*").select(*df.columns)
