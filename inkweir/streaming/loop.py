"""Incremental collection: micro-batches of fetched pages folded into versioned tables by one writer."""

from __future__ import annotations

import os
import signal
import threading
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweir.functions.text import fingerprint
from inkweir.operators.identity import decisions, identity_key, stored_key
from inkweir.sources.sinks import Versioned
from inkweir.session import cut

PAGES = "seq long, source_id long, site string, url string, title string, wenhao string, issuing_authority string, content string, storable boolean"
POLICIES = "policy_key string, version long, url string, title string, wenhao string, issuing_authority string, content string, digest string, related_policy_key string, source_id long"
LINKS = "policy_key string, url string, source_id long, batch long"


class Busy(RuntimeError):
    """Another writer holds the lock."""


@contextmanager
def single_writer(path: str):  # noqa: ANN201
    """A lock file on the driver, taken without waiting; a second writer gets Busy. Gone with its process."""
    import fcntl

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise Busy(path) from e
        yield


def absorb(store: Versioned, pages: DataFrame, batch_id: int) -> DataFrame:
    """Fold one batch of parsed pages (PAGES) into the store; returns (seq, url, decision, policy_key, version).

    Decisions follow the stored versions and the pages' own order; new versions, provenance and the batch's decisions are
    published together, so a batch that is replayed after a failure (same id) changes nothing.
    """
    spark = pages.sparkSession
    done = store.read("decisions")
    policies = store.read("policies")
    links = store.read("links")
    policies = policies if policies is not None else spark.createDataFrame([], POLICIES)
    links = links if links is not None else spark.createDataFrame([], LINKS)
    if done is not None and done.where(F.col("batch") == batch_id).limit(1).count():
        return done.where(F.col("batch") == batch_id).drop("batch")
    # One key for each URL, the latest linked; a URL keeps its key.
    known = links.groupBy("url").agg(F.max_by("policy_key", "batch").alias("key"))
    rows = cut(pages.withColumn("natural", identity_key(F.col("wenhao"), F.col("title"), F.col("issuing_authority"), F.col("site"), F.col("url"))).withColumn("digest", fingerprint(F.col("content"))))
    decided = decisions(rows.select("seq", "url", "natural", "digest", "storable"), known, policies.select(F.col("policy_key").alias("key"), "digest", "version"))
    key, related = stored_key(F.col("decision"), F.col("key"), F.col("url"))
    made = cut(decided.select("seq", "url", "digest", "decision", key.alias("policy_key"), related.alias("related_policy_key"), "version"))
    full = made.join(rows.drop("url", "digest"), "seq")
    fresh = full.where(F.col("decision").isin("ingested", "updated", "suspected_duplicate")).select(*policies.columns)
    # A page of the same URL whose variant is stored already isn't stored again.
    fresh = fresh.join(policies.where("related_policy_key <> ''").select("policy_key", "digest"), ["policy_key", "digest"], "left_anti").select(*policies.columns)
    linked = full.where("decision <> 'excluded'").select("policy_key", "url", "source_id", F.lit(batch_id).cast("long").alias("batch"))
    log = made.select("seq", "url", "decision", "policy_key", "version", F.lit(batch_id).cast("long").alias("batch"))
    store.publish({"policies": policies.unionByName(fresh), "links": links.unionByName(linked).groupBy("policy_key", "url", "source_id").agg(F.max("batch").alias("batch")), "decisions": log if done is None else done.unionByName(log)})
    return store.read("decisions").where(F.col("batch") == batch_id).drop("batch")


def stream(spark: SparkSession, folder: str, store: Versioned, checkpoint: str, trigger: dict | None = None):  # noqa: ANN201
    """A started query that folds arriving page files (Parquet of PAGES) into the store. The default trigger takes what
    is there and ends, one cycle; {"processingTime": "60 minutes"} keeps it running. Recovery is by the checkpoint."""
    source = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1000).parquet(folder)
    return source.writeStream.foreachBatch(lambda df, i: absorb(store, df, i) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def schedule(cycle: Callable[[], bool], minutes: float, cycles: int | None = None, stop: threading.Event | None = None) -> int:
    """Run cycle() again and again, `minutes` after each end, until stopped by a signal or after `cycles`; errors don't end
    it. 1 if any cycle failed, else 0."""
    stop, failed, n = stop or threading.Event(), False, 0
    if threading.current_thread() is threading.main_thread():
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())
    while not stop.is_set() and (cycles is None or n < cycles):
        try:
            failed = not cycle() or failed
        except Exception as e:  # noqa: BLE001 - the next cycle may do
            print(f"cycle {n + 1}: {e}")
            failed = True
        n += 1
        if cycles is None or n < cycles:
            stop.wait(minutes * 60)
    return int(failed)
