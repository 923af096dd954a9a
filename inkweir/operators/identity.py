"""Identity keys of documents and decisions of deduplication and versioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweir.functions.text import number_key, title_key
from inkweir.operators.skew import matched, running_count


def identity_key(number: Column, title: Column, authority: Column, source: Column, url: Column) -> Column:
    """Key under which versions of a document are counted.

    By issuing number where there is one; generic ones (公告, 通知, 令) carry the authority or else the source. Without
    a number authority or source and title; without either the hash of the URL. The year and suffixes are kept.
    """
    n = number_key(number)
    who = F.coalesce(F.nullif(authority, F.lit("")), source, F.lit(""))
    t = title_key(title)
    by_number = F.when(n.rlike("^(公告|通知|令)〔"), F.concat(who, F.lit(":"), n)).otherwise(n)
    by_title = F.when(t != "", F.concat(who, F.lit(":"), t)).otherwise(F.sha2(url, 256))
    return F.when(F.coalesce(number, F.lit("")) != "", by_number).otherwise(by_title)


def decisions(batch: DataFrame, links: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(seq, key, decision, version) of a batch of one source run, as if taken one after the other.

    batch: (seq, url, natural, digest, storable), seq unique; rows of failed downloads are left out before. links:
    (url, key) of stored documents, one key for each URL. known: (key, digest, version) of all stored versions.

    A digest already recorded under the key is a `duplicate_skip`; otherwise a row that isn't storable is `excluded`;
    the first of its key is `ingested`; a row of a known URL is `updated`; the rest are `suspected_duplicate`. Firsts
    are partial aggregates joined back and versions are counted in blocks, so a hot key isn't one task's. A null key or
    digest equals nothing but another null.
    """
    spark = batch.sparkSession
    links = links if links is not None else spark.createDataFrame([], "url string, key string")
    known = known if known is not None else spark.createDataFrame([], "key string, digest string, version long")
    o = links.select("url", F.col("key").alias("linked"))
    r = batch.select("seq", "url", "natural", "digest", "storable").join(o, "url", "left").withColumn("key", F.coalesce("linked", "natural"))
    stored = known.groupBy("key").agg(F.max("version").alias("top"))
    digests = known.select("key", "digest", F.lit(True).alias("recorded")).distinct()
    x = matched(matched(r, stored, ["key"]), digests, ["key", "digest"])
    # The first storable row of a key, and of a key's digest among linked rows: partial aggregates, joined back.
    anchors = x.where("storable").groupBy("key").agg(F.min(F.struct("seq", "digest")).alias("a")).select("key", F.col("a.seq").alias("anchor"), F.col("a.digest").alias("anchor_digest"))
    updates = x.where(F.col("storable") & F.col("linked").isNotNull()).groupBy("key", "digest").agg(F.min("seq").alias("upd"))
    x = matched(matched(x, anchors, ["key"]), updates, ["key", "digest"])
    record = F.when(F.col("recorded"), F.lit(-1).cast("long")).when(F.col("top").isNotNull(), F.col("upd")).when(F.col("anchor").isNotNull() & F.col("digest").eqNullSafe(F.col("anchor_digest")), F.col("anchor"))
    later = F.coalesce(F.col("seq") > F.col("anchor"), F.lit(False))
    decision = (
        F.when(F.col("seq") > record, "duplicate_skip").when(~F.col("storable"), "excluded").when(F.col("top").isNull() & ~later, "ingested")
        .when(F.col("linked").isNull(), "suspected_duplicate").otherwise("updated")
    )
    d = x.select("seq", "url", "key", "digest", decision.alias("decision"), F.coalesce("top", F.lit(0)).alias("top"))
    d = running_count(d, ["key"], "seq", F.col("decision").isin("ingested", "updated"), "counted")
    version = F.when(F.col("decision").isin("ingested", "updated"), F.col("top") + F.col("counted")).when(F.col("decision") == "suspected_duplicate", F.lit(1))
    return d.select("seq", "url", "key", "digest", "decision", version.cast("long").alias("version"))


def stored_key(decision: Column, key: Column, url: Column) -> tuple[Column, Column]:
    """(policy_key, related_policy_key) of a decided row: a suspected duplicate is a record of its own beside the key."""
    suspected = decision == "suspected_duplicate"
    return F.when(suspected, F.concat(key, F.lit(":variant:"), F.substring(F.sha2(url, 256), 1, 16))).otherwise(key), F.when(suspected, key).otherwise(F.lit(""))


def snapshot_versions(df: DataFrame, key: str, seq: str, digest: str) -> DataFrame:
    """`df` with `version`: the number of distinct digests of the key seen so far; a digest seen before adds none."""
    first = df.groupBy(key, digest).agg(F.min(seq).alias("_first"))
    return running_count(matched(df, first, [key, digest]), [key], seq, F.col(seq) == F.col("_first"), "version").drop("_first")
