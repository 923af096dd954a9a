"""Near-duplicate records: one row per distinct text, regions around pivots, and an exact metric join inside them.

The Jaccard distance of unrelated records is near 1, so a Voronoi partition of the whole corpus with triangle-inequality
windows would hold every record in every region. Equal sketch keys therefore lead records to their regions: the region
of a key has its smallest record as pivot. Distances to pivots are computed exactly, the triangle inequality then decides
which of the other pairs of a region can be alike, are alike for sure, or must be compared. Regions that stay large at full
key length are split by more pivots: a record lives with its nearest pivot, the inequality decides which boundary records
are replicated, and the parts join recursively and exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweir.llm.likeness import SIGNS, Likeness, agreement, alike_rows, alike_signs, exact, jaccard, key_rows, lengthened, only, set_of, sketched, whole_groups
from inkweir.llm.sampling import FINE
from inkweir.session import cut

#: Keys of more texts than this get longer; of full length, FULL times as many are compared where they meet, and the texts
#: of keys with more go to the recursive metric join.
BLOCK, FULL = 1024, 4
#: Pivots of a region, texts of a region that isn't split, levels of splitting, rows that are placed together.
PIVOTS, LEAF, LEVELS, TOGETHER = 12, 256, 6, 2000


def classes(sketches: DataFrame) -> DataFrame:
    """(key, rep): every record with the smallest key among the records of the same shingle set."""
    reps = sketches.groupBy("digest").agg(F.min("key").alias("rep"))
    return sketches.select("key", "digest").join(reps, "digest").select("key", "rep")


def _meet(most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """From rows (key, SIGNS, band) sorted by band and key to (a, b, pivot, band, met): pairs of a key that may be alike, or, with met
    false, the texts `a` of a key of more than `most`. The pivot of a pair is the smallest text that may be alike to both, or a."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, crowded in whole_groups(batches, "band", most):
            key, band = rows["key"].to_numpy(np.int64), rows["band"].to_numpy(np.int64)
            if crowded:
                yield pd.DataFrame({"a": key, "b": key, "pivot": key, "band": band, "met": False})
                continue
            i, j = alike_rows(band, rows[list(SIGNS)].to_numpy(np.int64))
            first = np.arange(len(key))
            np.minimum.at(first, j, i)
            first, n = first[j], len(key)
            pivot = np.where(np.isin(first * n + i, i * n + j), first, i)
            yield pd.DataFrame({"a": key[i], "b": key[j], "pivot": key[pivot], "band": band[i], "met": True}).drop_duplicates(["a", "b"])

    return run


def candidates(reps: DataFrame, p: Likeness, block: int, hot: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(a, b, pivot): a < b share a key and may be alike by their signs, each pair once; and
    (key, SIGNS, band): the texts of keys that have more than FULL * `block` texts at full length.

    One exchange by key, then the texts of a key are compared by their signs in the task that has them. Keys of more than
    `block` texts, counted there, are exchanged again with one more value, only for those texts. Keys in `hot` start longer.
    """
    rows = key_rows(reps, p, hot)
    crowd = key_rows(reps, p, hot, "full") if len(hot) else rows.limit(0)
    pairs = None
    for level in range(p.depth - 1):
        last = level == p.depth - 2
        held = cut(rows.repartition("band").sortWithinPartitions("band", "key").mapInPandas(_meet(FULL * block if last else block), "a long, b long, pivot long, band long, met boolean"))
        met = held.where("met").select("a", "b", "pivot")
        pairs = met if pairs is None else pairs.unionByName(met)
        more = held.where("not met").select(F.col("a").alias("key"), "band")
        if not more.limit(1).count():
            break
        longer = cut(lengthened(more.join(reps.select("key", "sketch"), "key"), p))
        crowd = crowd.unionByName(longer.where("full").drop("full"))
        rows = longer.where("not full").drop("full")
    return pairs.groupBy("a", "b").agg(F.min("pivot").alias("pivot")), crowd


def _windows(a: str, b: str, reach: float) -> Column:
    """Whether two arrays of distances to the same pivots allow the distance `reach`."""
    return ~F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y) > reach + 1e-6), lambda x: x)


def metric_pairs(texts: DataFrame, regions: DataFrame, p: Likeness, pivots: int = PIVOTS, leaf: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """(a, b), a < b: every pair of a region (key, SIGNS, band) that may be within the distance, and no pair missed.

    `texts`: (key, title, content). Regions start as those of the keys. All regions of a level are placed in one pass. A region of more than `leaf` texts gets up to `pivots` of them, by
    hash; each text lives with its nearest pivot and, by the triangle inequality, visits those whose radius it comes near
    enough to. A part that keeps nearly all texts of its region isn't split further: there the windows on the distances
    to all pivots, and the signs, decide which pairs are left. Regions pair as equi-joins, salted by the home side.
    """
    reach = 1 - p.threshold
    text = texts.select("key", "title", "content")
    none = F.array().cast("array<double>")
    signs = cut(regions.select("key", *SIGNS).distinct())
    rows = regions.select(F.col("band").cast("string").alias("region"), "key").distinct().select("*", F.lit(True).alias("home"), none.alias("far"), F.lit(None).cast("long").alias("was"))
    done: list[DataFrame] = []
    for level in range(levels + 1):
        rows = cut(rows)
        sizes = cut(rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("was").alias("was"), F.sum(F.col("home").cast("int")).alias("homes")).where("n > 1 and homes > 0"))
        large = (F.col("n") > leaf) & (F.col("was").isNull() | (F.col("n") < 0.9 * F.col("was"))) & F.lit(level < levels)
        sized = rows.join(sizes.select("region", "n", large.alias("large")), "region")
        done.append(sized.where("not large").select("region", "key", "home", "far", "n"))
        if not sizes.where(large).limit(1).count():
            break
        split = cut(sized.where("large").select("region", "key", "home", "n"))
        h = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(FINE))
        some = split.where(h < F.lit(4 * pivots * FINE) / F.col("n")).withColumn("nth", F.row_number().over(Window.partitionBy("region").orderBy(h, "key"))).where(F.col("nth") <= pivots)
        parts = F.ceil(F.col("n") / TOGETHER).cast("int")
        centres = cut(some.join(text, "key").select("region", "n", "title", "content")).toDF("region", "n", "title", "content").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        placing = split.join(text, "key").withColumn("salt", F.pmod(F.xxhash64("key"), parts).cast("int")).select("region", "salt", "key", "home", "n", "title", "content")

        def place(group: tuple, own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
            sets = sorted((x.tobytes() for x in (set_of(t, c, p) for t, c in zip(around["title"], around["content"])) if x is not None))
            at = [np.frombuffer(x, dtype=np.uint64) for x in sets]
            far = [[1 - jaccard(x, c) for c in at] for x in (set_of(t, c, p) for t, c in zip(own["title"], own["content"]))]
            return pd.DataFrame({"region": own["region"], "key": own["key"], "home": own["home"], "n": own["n"], "near": [int(np.argmin(x)) for x in far], "far": far})

        placed = cut(placing.groupBy("region", "salt").cogroup(centres.groupBy("region", "salt")).applyInPandas(place, "region string, key long, home boolean, n long, near int, far array<double>"))
        radii = placed.where("home").groupBy("region", "near").agg(F.max(F.element_at("far", F.col("near") + 1)).alias("radius"))
        visits = placed.select("*", F.posexplode("far").alias("q", "d")).join(radii.withColumnRenamed("near", "q"), ["region", "q"]).where((F.col("q") == F.col("near")) | (F.col("d") <= F.col("radius") + reach + 1e-6))
        rows = visits.select(F.concat_ws(".", "region", F.col("q").cast("string")).alias("region"), "key", (F.col("home") & (F.col("q") == F.col("near"))).alias("home"), "far", F.col("n").alias("was"))
    all_ = done[0]
    for x in done[1:]:
        all_ = all_.unionByName(x)
    salts, theirs = F.ceil(F.col("n") / leaf).cast("int"), ("t1", "t2", "t3", "t4")
    glanced = all_.join(signs, "key")
    homes = glanced.where("home").select("region", F.col("key").alias("x"), F.pmod(F.xxhash64("key"), salts).cast("int").alias("salt"), F.col("far").alias("fx"), *SIGNS)
    guests = glanced.select("region", F.col("key").alias("y"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("far").alias("fy"), *(F.col(k).alias(t) for k, t in zip(SIGNS, theirs)))
    met = homes.join(guests, ["region", "salt"]).where((F.col("x") != F.col("y")) & alike_signs(SIGNS, theirs) & _windows("fx", "fy", reach))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def representative_pairs(records: DataFrame, sketches: DataFrame, p: Likeness = Likeness(), block: int = BLOCK, hot: np.ndarray | None = None, leaf: int = LEAF) -> DataFrame:
    """(a, b), a < b: the representatives alike by the threshold. records: (key, title, content)."""
    reps = sketches.groupBy("digest").agg(F.min(F.struct("key", "sketch")).alias("x")).select("x.key", "x.sketch")
    met, crowd = candidates(reps, p, block, np.zeros(0, dtype=np.int64) if hot is None else hot)
    crowd, likely = cut(crowd), cut(met)

    def distances(pairs: DataFrame) -> DataFrame:
        texts = cut(only(records, cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()), "key"))
        both = pairs.join(texts.select(F.col("key").alias("a"), F.col("title").alias("ta"), F.col("content").alias("ca")), "a").join(texts.select(F.col("key").alias("b"), F.col("title").alias("tb"), F.col("content").alias("cb")), "b")
        return both.select("a", "b", (1 - exact(F.col("ta"), F.col("ca"), F.col("tb"), F.col("cb"), p)).alias("d"))

    reach = 1 - p.threshold + 1e-9
    # To the pivot first; then the triangle inequality on what the two of a pair are from it.
    star = F.col("pivot").isin(F.col("a"), F.col("b"))
    from_pivot = cut(distances(likely.where(star).select("a", "b")))
    alike = from_pivot.where(F.col("d") <= reach).select("a", "b")
    both = from_pivot.unionByName(from_pivot.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    side = lambda k, d: both.select(F.col("a").alias("pivot"), F.col("b").alias(k), F.col("d").alias(d))
    rest = likely.where(~star).join(side("a", "da"), ["pivot", "a"], "left").join(side("b", "db"), ["pivot", "b"], "left")
    rest = cut(rest.where(F.coalesce(F.abs(F.col("da") - F.col("db")) <= reach, F.lit(True))))
    near = F.coalesce(F.col("da") + F.col("db") <= reach - 2e-9, F.lit(False))
    open_ = rest.where(~near).select("a", "b")
    if crowd.limit(1).count():
        sk = reps.select("key", F.substring("sketch", 1, p.glance).alias("sketch"))
        hot_texts = cut(only(records, cut(crowd.select("key").distinct()), "key"))
        more = metric_pairs(hot_texts, crowd, p, leaf=leaf).join(sk.select(F.col("key").alias("a"), F.col("sketch").alias("sa")), "a").join(sk.select(F.col("key").alias("b"), F.col("sketch").alias("sb")), "b")
        more = more.where(agreement(F.col("sa"), F.col("sb")) >= p.sketch_floor).select("a", "b")
        open_ = open_.unionByName(more).distinct().join(alike.unionByName(rest.where(near).select("a", "b")), ["a", "b"], "left_anti")
    alike = alike.unionByName(rest.where(near).select("a", "b"))
    return alike.unionByName(distances(cut(open_)).where(F.col("d") <= reach).select("a", "b")).distinct()


def records_of(df: DataFrame, key: str, title: str, content: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{title}`").alias("title"), F.col(f"`{content}`").alias("content"))


def near_pairs(df: DataFrame, key: str, title: str, content: str, p: Likeness = Likeness(), block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all records alike by at least the threshold, copies included.

    Keys must be unique long numbers. Records whose content is null, empty or shorter than `least` characters without
    white space take no part; a null title counts as empty. An empty table gives an empty result.
    """
    records = records_of(df, key, title, content)
    sketches = cut(sketched(df, key, title, content, p))
    members = classes(sketches)
    alike = representative_pairs(records, sketches, p, block, leaf=leaf)
    copies = members.alias("m").join(members.select("rep", F.col("key").alias("other")), "rep").where("key < other").select(F.col("key").alias("id_a"), F.col("other").alias("id_b"))
    left = alike.join(members.select(F.col("rep").alias("a"), F.col("key").alias("x")), "a")
    across = left.join(members.select(F.col("rep").alias("b"), F.col("key").alias("y")), "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return copies.unionByName(across)


def components(links: DataFrame) -> DataFrame:
    """(a, g): every node of the links (a, b), each held in both directions, with the smallest node of its component.

    A round gives each node, and the node that was its label, the smallest label next to it, then lets labels take their
    own labels. Labels only fall and stay within the component, so rounds end; they do when no label has changed, and then
    neighbours have equal labels. Since labels move with their old roots, long chains need few rounds.
    """
    label = cut(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("g")))
    while True:
        told = links.join(label.select(F.col("a").alias("b"), F.col("g").alias("h")), "b").groupBy("a").agg(F.min("h").alias("h"))
        own = label.join(told, "a")
        offers = own.select("a", F.least("g", "h").alias("g"), F.col("g").alias("old")).unionByName(own.select(F.col("g").alias("a"), F.col("h").alias("g"), F.lit(None).cast("long").alias("old")))
        new = offers.groupBy("a").agg(F.min("g").alias("g"), F.max("old").alias("old"))
        jump = cut(new.join(new.select(F.col("a").alias("g"), F.col("g").alias("gg")), "g").select("a", F.least("g", "gg").alias("g"), "old"))
        label = jump.select("a", "g")
        if not jump.where("g <> old").limit(1).count():
            return label


def near_groups(df: DataFrame, key: str, title: str, content: str, p: Likeness = Likeness()) -> DataFrame:
    """(key, class_id, group_id, links): every record with the class of its exact text, its group and its number of links.

    Groups are the connected components of the representatives' links, named by their smallest key; found by repeated
    minimum exchange with pointer jumping until nothing changes, never outside the cluster. Records that take no part are
    groups of their own.
    """
    records = records_of(df, key, title, content)
    sketches = cut(sketched(df, key, title, content, p))
    members = classes(sketches)
    alike = cut(representative_pairs(records, sketches, p))
    both = cut(alike.unionByName(alike.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = components(both)
    links = both.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    out = records.select("key").join(members, "key", "left").select("key", F.coalesce("rep", "key").alias("class_id"))
    out = out.join(label.withColumnRenamed("a", "class_id"), "class_id", "left").join(links.withColumnRenamed("a", "class_id"), "class_id", "left")
    return out.select(F.col("key").alias(key), "class_id", F.coalesce("g", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
