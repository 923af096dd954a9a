"""Deduplicating new batches against all history: a persistent fingerprint store with partitioned Bloom filters.

The store holds all that a later batch needs: the marks of every record (digest of its content, skeletons of its issuing
number and its key), postings of its content's fingerprints, and the records themselves by the place they were written to.
Fingerprints are minima of hash ranges, combined into keys; postings carry two bits of each of 128 values of the sketch. A batch is staged once;
its keys and marks are screened by the Bloom filters of their partition, positives are looked up in the files of those
partitions only, shared coverage is told by these bits, and the survivors' texts are read from the places the postings
name. Then the batch is absorbed: its postings, marks and filters become a segment of the store, and segments of equal
rank are merged, so their number stays logarithmic. History is neither fingerprinted nor grouped again.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweir.llm.likeness import SIGNS, Likeness, alike_rows, alike_signs, codes_of, crowded_keys, exact, key_rows, only, shingles, sketch, whole_groups
from inkweir.llm.skeletons import skeleton_of
from inkweir.session import cut, shared_dir

BITS_PER_KEY = 12
HASHES = 4
#: A first look verifies at most so many known texts for each candidate; candidates it leaves open see all.
WITNESSES = 4
#: Rows of a key in a batch up to which they are held against each other all keys at once; 4,096 times GROUPS pairs of more at once.
PREVIOUS, GROUPS = 64, 64
#: Texts that hold a key, by which the store's keys start longer.
LEAST = 512
#: Not read any more, as a lookup takes all texts of a key; tests set it.
FIRST = 8
#: Keys of a Bloom filter that are screened together; segments of one rank that are merged.
TOGETHER, FAN = 200_000, 4
#: Bytes of a segment's filters up to which they go to every task.
BROADCAST = 4 << 20
#: A record's place: the number of its stage and of the task that wrote it.
TASKS = 1 << 20

RECORD = "doc long, batch int, cand long, marks array<struct<t:string,mark:long,proof:long>>, digest binary, sketch binary, title string, content string"


def _mark(kind: str, value: bytes) -> tuple[str, int, int]:
    h = hashlib.blake2b(value, digest_size=16, person=kind.encode()).digest()
    return kind, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def fingerprinted(df: DataFrame, p: Likeness = Likeness()) -> DataFrame:
    """RECORD of rows (doc, batch, cand, title, content, wenhao, policy_key).

    `marks`: of the content without white space (d), and of the skeletons of wenhao (w) and policy_key (k), none for what is
    null, empty or without visible characters. `sketch` is null for content too short to take part. One pass, no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            marks, digests, sketches = [], [], []
            for t, c, w, k in zip(b["title"], b["content"], b["wenhao"], b["policy_key"]):
                body = codes_of(c) if c else ()
                own = [_mark("d", body.tobytes())] if len(body) else []
                own += [_mark(kind, s.encode("utf-8", "surrogatepass")) for kind, x in (("w", w), ("k", k)) if x and (s := skeleton_of(x, True))]
                h = shingles(np.concatenate([codes_of(t), body]) if t else body, p.width) if len(body) >= p.least else ()
                marks.append([{"t": a, "mark": m, "proof": o} for a, m, o in own])
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                sketches.append(sketch(h, p.bins) if len(h) else None)
            yield pd.DataFrame({"doc": b["doc"], "batch": b["batch"], "cand": b["cand"], "marks": marks, "digest": digests, "sketch": sketches, "title": b["title"], "content": b["content"]})

    return df.select("doc", "batch", "cand", "title", "content", "wenhao", "policy_key").mapInPandas(run, RECORD)


def _positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """(HASHES, keys) bit positions by double hashing."""
    u = keys.view(np.uint64)
    with np.errstate(over="ignore"):
        a = (u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        b = ((u ^ (u >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20) | np.uint64(1)
        return ((a[None, :] + np.arange(HASHES, dtype=np.uint64)[:, None] * b[None, :]) % np.uint64(bits)).astype(np.int64)


def bloom(keys: np.ndarray) -> bytes:
    """A Bloom filter of the keys; its size follows their number."""
    bits = max(1024, 1 << int(np.ceil(np.log2(max(1, len(keys)) * BITS_PER_KEY))))
    out = np.zeros(bits // 8, dtype=np.uint8)
    at = np.unique(_positions(keys, bits).ravel())
    np.bitwise_or.at(out, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    return out.tobytes()


def may_hold(filters: list[bytes], keys: np.ndarray) -> np.ndarray:
    """True for keys that one of the filters may hold; never False for one that it does."""
    out = np.zeros(len(keys), dtype=bool)
    for f in filters:
        packed = np.frombuffer(f, dtype=np.uint8)
        at = _positions(keys, len(packed) * 8)
        out |= ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
    return out


class FingerprintStore:
    """A store in a folder that all executors share. One writer at a time; a lost job leaves it whole.

    stages: `records/seq=N/loc=M` as fingerprinted. segments: `postings`, `marks` (bucketed and sorted by key) and
    `filters` of the stages LO to HI, visible through the marker `segments/LO-HI`; one that lies within another is outdated.
    `partitions` is that of the first segment; merged ones have as many more as they have keys, so that a bucket and its
    filters stay of one size.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, partitions: int | None = None, p: Likeness = Likeness()) -> None:
        self.spark, self.p = spark, p
        self.partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._hot: np.ndarray | None = None
        self.folder = folder or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"

    def _fs(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._fs(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def segments(self) -> list[str]:
        """The current segments, LO-HI-PARTITIONS each."""
        spans = [(int(lo), -int(hi), n) for n in self._names("segments") for lo, hi in [n.split("-")[:2]]]
        out, end = [], -1
        for lo, hi, n in sorted(spans):
            if -hi > end:
                out.append(n)
                end = -hi
        return out

    def drop(self) -> None:
        """Forget the store: its tables in the catalog and its folder."""
        self.close()
        path, fs = self._fs("")
        fs.delete(path, True)

    def close(self) -> None:
        """Take the store's tables out of the session's catalog; the folder stays."""
        for n in self._names("segments"):
            for kind in ("postings", "marks"):
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(kind, n)}")

    def _table(self, kind: str, segment: str) -> str:
        return "inkweir_" + hashlib.md5(f"{self.folder}/{kind}/{segment}".encode()).hexdigest()

    def _read(self, kind: str, segment: str, parts: list[int] | None = None, signs: bool = False) -> DataFrame:
        """Rows of a segment: of some buckets only, from their files, or known to the planner as bucketed by key. `signs`: with all four SIGNS."""
        columns, key = {"postings": ("band BIGINT, nth INT, doc BIGINT, loc BIGINT, s1 BIGINT, s2 BIGINT, s3 BIGINT, s4 BIGINT", "band"), "marks": ("mark BIGINT, proof BIGINT", "mark")}[kind]
        if parts is not None:
            files = [f"{self.folder}/{kind}/{segment}/{n}" for n in self._names(f"{kind}/{segment}") if (m := re.search(r"_(\d{5,})\.c\d", n)) and int(m.group(1)) in set(parts)]
            out = self.spark.read.schema(columns).parquet(*files) if files else self.spark.createDataFrame([], columns)
        else:
            name, n = self._table(kind, segment), int(segment.split("-")[2])
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{self.folder}/{kind}/{segment}'")
            out = self.spark.table(name)
        return out if signs else out.drop("s3", "s4")

    def met(self, kind: str, segment: str, keys: DataFrame, key: str, signs: bool = False) -> DataFrame:
        """Rows of a segment that can meet `keys`: the buckets of few keys only, by one bounded list of bucket numbers."""
        n = int(segment.split("-")[2])
        parts = [r["part"] for r in keys.select(_part(key, n).alias("part")).distinct().limit(n).collect()]
        return self._read(kind, segment, parts if len(parts) <= n // 2 else None, signs)

    def hot(self) -> np.ndarray | None:
        """Sorted keys that start longer, at most bands / LEAST for each text of the first stage."""
        path, fs = self._fs("hot")
        if self._hot is None and fs.exists(path):
            self._hot = np.sort(self.spark.read.schema("key long").parquet(f"{self.folder}/hot").toPandas()["key"].to_numpy(np.int64))
        return self._hot

    def stage(self, rows: DataFrame) -> int:
        """Fingerprint rows (doc, batch, cand, title, content, wenhao, policy_key) and write them; docs must be new. No shuffle."""
        last = max([int(n.split("-")[1]) for n in self._names("segments")], default=-1)
        seq = last + 1
        fingerprinted(rows, self.p).withColumn("loc", F.lit(seq * TASKS) + F.spark_partition_id()).write.mode("overwrite").option("compression", "zstd").partitionBy("loc").parquet(f"{self.folder}/records/seq={seq}")
        if self.hot() is None:
            crowded_keys(self.records(seqs=[seq]).where("sketch is not null"), self.p, LEAST).write.mode("overwrite").parquet(f"{self.folder}/hot")
        return seq

    def records(self, seqs: list[int] | None = None, locs: list[int] | None = None) -> DataFrame:
        """Staged records with their `loc`: of whole stages, or of single places."""
        base = f"{self.folder}/records"
        paths = [f"{base}/seq={s}" for s in seqs] if locs is None else [f"{base}/seq={x // TASKS}/loc={x}" for x in locs]
        empty = self.spark.createDataFrame([], RECORD + ", loc long")
        paths = [x for x in paths if self._names(x[len(self.folder) + 1 :])]
        return self.spark.read.schema(RECORD + ", loc long").option("basePath", base).parquet(*paths).drop("seq") if paths else empty

    def keys(self, records: DataFrame, *more: str) -> DataFrame:
        """(band, SIGNS, doc, loc, more) of the records that have a sketch."""
        own = records.where("sketch is not null").select(F.col("doc").alias("key"), "loc", *more, "sketch")
        return key_rows(own, self.p, self.hot(), take="all", more=" ".join(("loc", *more))).withColumnRenamed("key", "doc")

    def marks(self, records: DataFrame, *more: str) -> DataFrame:
        return records.select(F.explode("marks").alias("m"), *more).select("m.t", "m.mark", "m.proof", *more)

    def absorb(self, seq: int) -> None:
        """Make a stage known: one exchange of its keys, then its marker; then merge segments of one rank."""
        own = self.records(seqs=[seq])
        self._publish(f"{seq:08d}-{seq:08d}-{self.partitions}", self.keys(own), self.marks(own).select("mark", "proof"))
        tail = self.segments()
        rank = lambda n: int(n.split("-")[1]) - int(n.split("-")[0])
        while len(tail) >= FAN and len({rank(n) for n in tail[-FAN:]}) == 1:
            some = tail[-FAN:]
            postings, marks = (self._all(kind, some) for kind in ("postings", "marks"))
            self._publish(f"{some[0].split('-')[0]}-{some[-1].split('-')[1]}-{sum(int(n.split('-')[2]) for n in some)}", postings, marks)
            tail = self.segments()

    def _all(self, kind: str, segments: list[str]) -> DataFrame:
        out = self._read(kind, segments[0], signs=True)
        for n in segments[1:]:
            out = out.unionByName(self._read(kind, n, signs=True))
        return out

    def _publish(self, name: str, keys: DataFrame, marks: DataFrame) -> None:
        n = int(name.split("-")[2])
        rows = keys.select("band", F.floor(F.col("loc") / TASKS).cast("int").alias("nth"), "doc", "loc", *SIGNS).repartition(n, "band")  # nth: its stage
        for kind, df, key in (("postings", rows, "band"), ("marks", marks.distinct().repartition(n, "mark"), "mark")):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(kind, name)}")
            df.write.format("parquet").mode("overwrite").bucketBy(n, key).sortBy(key).option("path", f"{self.folder}/{kind}/{name}").saveAsTable(self._table(kind, name))

        def filters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # Rows come bucket by bucket: only one bucket's keys are held.
            part, held = None, []
            for b in batches:
                for x, own in b.groupby("part", sort=False)["key"]:
                    if part is not None and x != part:
                        yield pd.DataFrame({"part": [part], "bits": [bloom(np.unique(np.concatenate(held)))]})
                        held = []
                    part = x
                    held.append(np.unique(own.to_numpy(np.int64)))
            if held:
                yield pd.DataFrame({"part": [part], "bits": [bloom(np.unique(np.concatenate(held)))]})

        for kind, key in (("postings", "band"), ("marks", "mark")):
            self._read(kind, name).select(_part(key, n).alias("part"), F.col(key).alias("key")).mapInPandas(filters, "part int, bits binary").write.mode("overwrite").parquet(f"{self.folder}/filters/{name}/kind={kind}")
        path, fs = self._fs(f"segments/{name}")
        fs.mkdirs(path)

    def prescreen(self, kind: str, segment: str, keys: DataFrame, key: str) -> DataFrame:
        """The rows of `keys` whose key the filters of their bucket in a segment may hold: without an exchange while the filters are of
        at most BROADCAST bytes, else by bucket, with salt where a bucket has many rows."""
        n = int(segment.split("-")[2])
        filters = self.spark.read.schema("part int, bits binary").parquet(f"{self.folder}/filters/{segment}/kind={kind}")
        size = filters.agg(F.sum(F.length("bits"))).first()[0] or 0
        own = keys.withColumn("part", _part(key, n))
        if size <= BROADCAST:
            held: dict[int, list[bytes]] = {}
            for r in filters.collect():
                held.setdefault(r["part"], []).append(bytes(r["bits"]))
            shared = self.spark.sparkContext.broadcast(held)

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    at, part = b[key].to_numpy(np.int64), b["part"].to_numpy()
                    keep = np.zeros(len(b), dtype=bool)
                    order = np.argsort(part, kind="stable")
                    for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(b) else ():
                        keep[rows] = may_hold(shared.value.get(int(part[rows[0]]), []), at[rows])
                    yield b[keep]

            return own.mapInPandas(run, own.schema).drop("part")
        salts = 1 + keys.count() // (n * TOGETHER)
        own = own.withColumn("salt", F.pmod(F.xxhash64(*keys.columns), F.lit(salts)).cast("int"))
        filters = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def pick(_key: tuple, rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
            return rows[may_hold(list(bits["bits"]), rows[key].to_numpy(np.int64))] if len(rows) else rows

        return own.groupBy("part", "salt").cogroup(filters.groupBy("part", "salt")).applyInPandas(pick, own.schema).drop("part", "salt")

    def screen(self, seq: int) -> DataFrame:
        """(cand, kind) of the staged rows that repeat something known or an earlier row of the stage by (batch, cand).

        kind: `exact`, else `near`, else `key`. Empty values repeat nothing. Materialised: the store may grow afterwards.
        """
        p = self.p
        own = self.records(seqs=[seq])
        order = F.struct("batch", "cand")
        marks = cut(self.marks(own, "batch", "cand", "doc"))
        first = marks.groupBy("t", "mark", "proof").agg(F.min(order).alias("first"))
        seen = marks.join(first, ["t", "mark", "proof"]).where(F.col("first") < order).select("t", "cand", "doc")
        for s in self.segments():
            positive = cut(self.prescreen("marks", s, marks.select("t", "mark", "proof", "cand", "doc"), "mark"))
            seen = seen.unionByName(positive.join(self.met("marks", s, positive, "mark"), ["mark", "proof"], "left_semi").select("t", "cand", "doc"))
        seen = cut(seen.distinct())
        same = seen.where("t = 'd'")

        some = own.select("doc", "loc", "batch", "cand", "sketch")
        fresh = some.join(same.select("doc"), "doc", "left_anti")
        still = fresh.select(F.col("doc").alias("mine"))
        hits = earlier_in_batch(self.keys(some, "batch", "cand")).join(still, "mine", "left_semi")
        opened = self.keys(fresh).select("band", *SIGNS, F.col("doc").alias("mine"))
        for s in self.segments():
            hits = hits.unionByName(self.lookup(s, cut(self.prescreen("postings", s, opened, "band"))))
        hits = cut(hits.groupBy("mine", "doc", "loc").agg(F.sum("n").alias("n")))
        here = own.select(F.col("doc").alias("mine"), F.col("title").alias("ta"), F.col("content").alias("ca"))

        def verified(pairs: DataFrame) -> DataFrame:
            """(mine) of the pairs that are alike; only the places that hold a needed text are read."""
            pairs = cut(pairs)
            places = [r["loc"] for r in pairs.select("loc").distinct().collect()]  # one for each file at most
            docs = cut(pairs.select("doc").distinct())
            texts = only(self.records(locs=places).select("doc", "title", "content"), docs, "doc")
            both = pairs.join(texts.select("doc", F.col("title").alias("tb"), F.col("content").alias("cb")), "doc").join(only(here, cut(pairs.select("mine").distinct()), "mine"), "mine")
            return cut(both.where(exact(F.col("ta"), F.col("ca"), F.col("tb"), F.col("cb"), p) >= p.threshold).select("mine").distinct())

        # The known texts that share most come first; a candidate they leave open sees the others met.
        ranked = hits.withColumn("nth", F.row_number().over(Window.partitionBy("mine").orderBy(F.desc("n"), "doc")))
        near = verified(ranked.where(F.col("nth") <= WITNESSES).select("mine", "doc", "loc"))
        rest = ranked.where(F.col("nth") > WITNESSES).select("mine", "doc", "loc").join(near, "mine", "left_anti")
        if rest.limit(1).count():
            near = near.unionByName(verified(rest))
        kinds = same.select("cand", F.lit(0).alias("k")).unionByName(near.join(own.select(F.col("doc").alias("mine"), "cand"), "mine").select("cand", F.lit(1).alias("k"))).unionByName(seen.where("t <> 'd'").select("cand", F.lit(2).alias("k")))
        return cut(kinds.groupBy("cand").agg(F.min("k").alias("k")).select("cand", F.element_at(F.array(F.lit("exact"), F.lit("near"), F.lit("key")), F.col("k") + 1).alias("kind")))

    def lookup(self, segment: str, positive: DataFrame) -> DataFrame:
        """(mine, doc, loc, n): all texts of a segment that share keys with the positives (band, SIGNS, mine) and whose signs
        allow the likeness."""
        theirs = ("t1", "t2", "t3", "t4")
        own = self.met("postings", segment, positive, "band", True).select("band", "doc", "loc", *(F.col(k).alias(t) for k, t in zip(SIGNS, theirs)))
        return positive.join(own, "band").where(alike_signs(SIGNS, theirs)).groupBy("mine", "doc", "loc").agg(F.count(F.lit(1)).alias("n"))


def _part(key: str, n: int) -> Column:
    """The bucket of a key."""
    return F.pmod(F.hash(key), F.lit(n)).cast("int")


def earlier_in_batch(keys: DataFrame) -> DataFrame:
    """(mine, doc, loc, n): every earlier row of the batch (band, SIGNS, doc, loc, batch, cand) that shares keys with a row and whose
    signs allow the likeness; compared where the rows of a key meet. What one key costs grows with the square of its rows in the batch."""
    small, cells = PREVIOUS, GROUPS << 12

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, _ in whole_groups(batches, "band"):
            i, j = alike_rows(rows["band"].to_numpy(np.int64), rows[list(SIGNS)].to_numpy(np.int64), small, cells)
            doc = rows["doc"].to_numpy(np.int64)
            yield pd.DataFrame({"mine": doc[j], "doc": doc[i], "loc": rows["loc"].to_numpy(np.int64)[i]})

    met = keys.repartition("band").sortWithinPartitions("band", "batch", "cand").mapInPandas(run, "mine long, doc long, loc long")
    return met.where("mine <> doc").groupBy("mine", "doc", "loc").agg(F.count(F.lit(1)).alias("n"))


def history_rows(df: DataFrame, key: str) -> DataFrame:
    """Accepted records as rows for the store: even docs, order before every batch."""
    return df.select((F.col(f"`{key}`") * 2).alias("doc"), F.lit(0).alias("batch"), F.lit(0).cast("long").alias("cand"), "title", "content", "wenhao", "policy_key")


def batch_rows(df: DataFrame, key: str, batch: str) -> DataFrame:
    """Candidates as rows for the store: odd docs. A candidate without a batch number comes after all batches."""
    return df.select((F.col(f"`{key}`") * 2 + 1).alias("doc"), F.coalesce(F.col(f"`{batch}`").cast("int"), F.lit(2**31 - 1)).alias("batch"), F.col(f"`{key}`").alias("cand"), "title", "content", "wenhao", "policy_key")


def repeated_candidates(accepted: DataFrame | None, intake: DataFrame, key: str = "id", cand: str = "cand_id", batch: str = "batch_no", store: FingerprintStore | None = None, p: Likeness = Likeness(), waves: int = 2) -> DataFrame:
    """(cand, kind): the candidates of all batches that repeat an accepted record or an earlier candidate.

    Without a store a new one is filled with the accepted records, used and dropped; with one, `accepted` isn't read: the
    store has what was absorbed before. The batches are taken in order in `waves` runs of consecutive batches; each is
    staged, screened against the store and itself, and absorbed, so the next one meets it there.
    """
    own = FingerprintStore(intake.sparkSession, p=p) if store is None else store
    if store is None and accepted is not None:
        own.absorb(own.stage(history_rows(accepted, key)))
    rows = batch_rows(intake, cand, batch)
    sizes = sorted((r["batch"], r["n"]) for r in rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each batch
    total, past, ends = sum(n for _, n in sizes), 0, []
    for b, n in sizes:
        past += n
        if past * waves >= total * (len(ends) + 1):
            ends.append(b)
    found, low = intake.sparkSession.createDataFrame([], "cand long, kind string"), -(2**31)
    for high in ends:
        seq = own.stage(rows.where((F.col("batch") > low) & (F.col("batch") <= high)) if low > -(2**31) else rows.where(F.col("batch") <= high))
        found = found.unionByName(own.screen(seq))
        own.absorb(seq)
        low = high
    if store is None:
        own.drop()
    return found.withColumnRenamed("cand", cand)
