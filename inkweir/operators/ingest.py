"""The ingest stage as one plan: what becomes of each fetched document, and how a record is reviewed afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweir.operators.identity import decisions, stored_key

#: Review states a person has set; such records aren't classified again.
DECIDED = ("confirmed", "adjusted", "rejected")


def valid(content: Column, attachments: Column, error: Column) -> Column:
    """Why a document can't be taken, '' if it can: without text and attachments there is nothing to store."""
    empty = (F.trim(F.coalesce(content, F.lit(""))) == "") & (F.coalesce(attachments, F.lit(0)) == 0)
    return F.when(empty, F.coalesce(F.nullif(error, F.lit("")), F.lit("empty"))).otherwise("")


def named(title: Column, listed: Column) -> Column:
    """The title of a document: its own, else the one of the list it was found on, else one to be checked."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(listed, F.lit("")), F.lit("待核实标题"))


def review_status(needs: Column, relevance: Column) -> Column:
    """The state of a record nobody has looked at: pending, else rejected where it isn't relevant, else confirmed."""
    return F.when(needs, "pending").when(relevance == "no", "rejected").otherwise("confirmed_auto")


def ingest_decisions(batch: DataFrame, links: DataFrame | None = None, known: DataFrame | None = None, states: DataFrame | None = None, again: bool = False) -> DataFrame:
    """What becomes of each document of a batch, as if they were taken one after the other.

    batch: (seq, url, natural, digest, content, error, files, failed, whole, read, relevance, needs): the number of its
    attachments, of those whose download failed, of those read in full and of those with text; relevance and needs as
    classified. links, known: as in identity.decisions. states: (key, review_status) of the records. again: classify
    duplicates again that nobody has decided.

    Gives (seq, url, policy_key, related_policy_key, version, outcome, status, relevance, need_review, review_status, note):
    `failed` for what is empty or would replace a stored version while an attachment is missing; `duplicate` or
    `reclassified`; `excluded`; else `ingested`, `updated` or `suspected_duplicate`. Incomplete material is never excluded
    and is reviewed; so are suspected duplicates and new versions, which go back to pending.
    """
    spark = batch.sparkSession
    links = links if links is not None else spark.createDataFrame([], "url string, key string")
    states = states if states is not None else spark.createDataFrame([], "key string, review_status string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    b = batch.join(links.select("url", F.lit(True).alias("stored")), "url", "left")
    missing = zero("failed") > 0
    partly = (F.coalesce(F.col("error"), F.lit("")) != "") | missing | (zero("whole") < zero("files"))
    unread = (zero("files") > 0) & (zero("read") == 0)
    why = F.when(valid(F.col("content"), F.col("files"), F.col("error")) != "", valid(F.col("content"), F.col("files"), F.col("error"))).when(F.col("stored") & missing, "attachment")
    relevance = F.when((F.col("relevance") == "no") & (partly | unread), "pending").otherwise(F.col("relevance"))
    b = b.select("seq", "url", "natural", "digest", why.alias("why"), partly.alias("partly"), unread.alias("unread"), missing.alias("missing"), relevance.alias("relevance"), F.coalesce("needs", F.lit(False)).alias("needs"))
    taken = b.where("why is null").withColumn("storable", F.coalesce(F.col("relevance"), F.lit("")) != "no")
    decided = decisions(taken.select("seq", "url", "natural", "digest", "storable"), links, known).select("seq", "key", "decision", "version")
    x = b.join(decided, "seq", "left").join(states.select("key", F.col("review_status").alias("state")), "key", "left")
    free = F.lit(again) & ~F.col("partly") & ~F.coalesce(F.col("state"), F.lit("")).isin(*DECIDED)
    duplicate = F.col("decision") == "duplicate_skip"
    outcome = F.when(F.col("why").isNotNull(), "failed").when(duplicate & free, "reclassified").when(duplicate, "duplicate").otherwise(F.col("decision"))
    status = F.when(F.col("why").isNotNull(), "failed").when(F.col("decision") == "excluded", "excluded").when(F.col("missing"), "failed").otherwise("processed")
    key, related = stored_key(F.col("decision"), F.col("key"), F.col("url"))
    kept = F.col("decision").isin("ingested", "updated", "suspected_duplicate")
    needs = F.col("needs") | F.col("partly") | F.col("unread") | F.col("decision").isin("suspected_duplicate", "updated")
    note = F.concat_ws(";", F.col("why"), F.when(kept & F.col("partly"), "incomplete"), F.when(kept & F.col("unread"), "unread"), F.when(F.col("decision") == "suspected_duplicate", "compare"))
    return x.select(
        "seq", "url", key.alias("policy_key"), related.alias("related_policy_key"), "version", outcome.alias("outcome"), status.alias("status"), "relevance",
        F.when(kept, needs).alias("need_review"), F.when(kept, review_status(needs, F.col("relevance"))).alias("review_status"), note.alias("note"),
    )


def counters(decided: DataFrame) -> DataFrame:
    """(outcome, n, need_review) of a run, one row for each outcome."""
    return decided.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("need_review"), F.lit(False)).cast("int")).alias("need_review"))
