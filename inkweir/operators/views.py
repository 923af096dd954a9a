"""Relational views: current versions, search, dashboards, queues, runs, provenance, review, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweir.functions.text import holds


def current(policies: DataFrame) -> DataFrame:
    """The latest version of each key; ties go to the larger id. The ids come from a partial aggregate of narrow columns
    and a semi-join on the unique id, so that a key of many versions is never one task's."""
    return policies.join(current_ids(policies), "id", "left_semi")


def current_ids(policies: DataFrame) -> DataFrame:
    """(id) of the current versions: a partial aggregate, so that no wide column is exchanged and no key is a hot task."""
    return policies.groupBy("policy_key").agg(F.max(F.struct("version", "id")).alias("x")).select(F.col("x.id").alias("id"))


def search(policies: DataFrame, region: str = "", category: str = "", keyword: str = "", review_status: str = "") -> DataFrame:
    """Current policies by region, category (code or name), keyword in title, text or number, and review status.

    Rejected ones are hidden unless asked for. The current version is chosen first. Keywords have no wildcards.
    """
    d = current(policies)
    d = d.where(F.col("review_status") == review_status) if review_status else d.where(F.coalesce("review_status", F.lit("")) != "rejected")
    if region:
        d = d.where(F.col("region") == region)
    if category:
        d = d.where(holds(F.col("category"), category) | holds(F.col("category_names"), category))
    if keyword:
        d = d.where(holds(F.col("title"), keyword) | holds(F.col("content"), keyword) | holds(F.col("wenhao"), keyword))
    return d


def paged(df: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of rows, newest id first."""
    return df.orderBy(F.desc("id")).offset(offset).limit(limit)


def regions(policies: DataFrame) -> DataFrame:
    return current(policies).where("region <> ''").select("region").distinct()


def category_counts(policies: DataFrame, none: str = "未分类") -> DataFrame:
    """(category_names, n) of current policies that aren't rejected; ties in order of the newest record."""
    g = search(policies).groupBy(F.coalesce(F.nullif("category_names", F.lit("")), F.lit(none)).alias("category_names")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("newest"))
    return g.orderBy(F.desc("n"), F.desc("newest"))


def dashboard(sources: DataFrame, policies: DataFrame, fetches: DataFrame, runs: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row of counters; each table is read once and aggregated before the single rows are put together."""
    status = F.coalesce("review_status", F.lit(""))
    newest = policies.groupBy("policy_key").agg(F.max(F.struct("version", "id", "review_status", "need_review")).alias("x")).select("x.review_status", "x.need_review")
    p = newest.agg(F.count_if(status != "rejected").alias("policies"), F.count_if(F.col("need_review")).alias("pending_review"), F.count_if(status.isin("confirmed", "adjusted")).alias("confirmed"), F.count_if(status == "rejected").alias("rejected"))
    s = sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if("enabled").alias("sources_enabled"))
    out = s.crossJoin(p)  # single rows
    for name, df in (("fetches", fetches), ("runs", runs), ("attachments", attachments)):
        out = out.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))
    return out


def queue_order(records: DataFrame) -> list[Column]:
    """Unfinished records first, then the longest unvisited, then by id."""
    return [F.when(F.col("status").isin("discovered", "failed", "downloaded"), 0).otherwise(1), F.col("last_checked_at").asc_nulls_first(), F.col("id")]


def rotation(records: DataFrame, source_id: int, limit: int, retry_only: bool = False) -> DataFrame:
    """The next `limit` records of a source (TakeOrderedAndProject)."""
    d = records.where(F.col("source_id") == source_id)
    return (d.where("status = 'failed'") if retry_only else d).orderBy(*queue_order(d)).limit(limit)


def rotation_all(records: DataFrame, limit: int, salts: int = 16) -> DataFrame:
    """The next `limit` records of every source, with `place`. Each source is ranked in salted parts first and the parts'
    heads are ranked together, so a source of a third of the rows is never sorted in one task."""
    order = queue_order(records)
    part = F.pmod(F.xxhash64("id"), F.lit(salts))
    heads = records.withColumn("_s", part).withColumn("_n", F.row_number().over(Window.partitionBy("source_id", "_s").orderBy(*order))).where(F.col("_n") <= limit)
    return heads.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(*order))).where(F.col("place") <= limit).drop("_s", "_n")


COUNTERS = ("discovered", "downloaded", "ingested", "duplicate", "updated", "suspected", "excluded", "failed", "attachments_downloaded", "attachments_failed", "attachments_unparsed", "llm_fallback", "input_tokens", "output_tokens")


def run_counters(runs: DataFrame, names: tuple[str, ...] = COUNTERS) -> DataFrame:
    """`runs` with a column for each counter of its summary (JSON); a missing counter is 0."""
    s = F.from_json("summary", "map<string,string>")
    return runs.select("*", *[F.coalesce(F.try_element_at(s, F.lit(n)).try_cast("long"), F.lit(0)).alias(n) for n in names])


def run_status(failed: Column, downloaded: Column, has_errors: Column) -> Column:
    return F.when((failed > 0) & (downloaded == 0), "failed").when(has_errors, "partial").otherwise("ok")


def run_totals(runs: DataFrame, by: list[str], names: tuple[str, ...] = COUNTERS) -> DataFrame:
    """The sum of each counter and the derived status, by the given columns."""
    g = run_counters(runs, names).groupBy(*by).agg(*[F.sum(n).alias(n) for n in names])
    errors = F.lit(False)
    for n in ("failed", "attachments_failed", "llm_fallback"):
        errors = errors | (F.col(n) > 0) if n in names else errors
    return g.withColumn("status", run_status(F.col("failed"), F.col("downloaded"), errors))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last event of each run id: a run is opened and closed by appended rows."""
    return runs.groupBy("run_id").agg(F.max_by(F.struct(*runs.columns), F.struct(F.coalesce("finished_at", "started_at"), "id")).alias("x")).select("x.*")


def recovered(runs: DataFrame) -> DataFrame:
    """Runs left `running` by an interrupted process become failed, with a note."""
    open_ = F.col("status") == "running"
    return runs.withColumn("note", F.when(open_, F.concat(F.coalesce("note", F.lit("")), F.lit("；interrupted"))).otherwise(F.col("note"))).withColumn("status", F.when(open_, "failed").otherwise(F.col("status")))


def run_view(runs: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs with the name of their source; a missing source shows its id, no source '-'. `any_running` holds for all."""
    names = sources.select(F.col("id").alias("source_id"), "name")
    d = runs.join(names, "source_id", "left").withColumn("source_name", F.coalesce("name", F.col("source_id").cast("string"), F.lit("-"))).drop("name")
    d = d.crossJoin(runs.agg(F.coalesce(F.bool_or(F.col("status") == "running"), F.lit(False)).alias("any_running")))
    return d.orderBy(F.desc("id")).limit(limit) if limit else d


def policy_of_url(policies: DataFrame, sources: DataFrame) -> DataFrame:
    """(page_url, policy_id, policy_key): the latest policy linked to each URL."""
    p = policies.select(F.col("id").alias("policy_id"), "policy_key")
    return sources.select("page_url", "policy_id").join(p, "policy_id").groupBy("page_url").agg(F.max(F.struct("policy_id", "policy_key")).alias("x")).select("page_url", "x.policy_id", "x.policy_key")


def matching_version(policies: DataFrame) -> DataFrame:
    """(policy_key, content_sha256, id, version): the latest version of each key that has a digest."""
    return policies.groupBy("policy_key", "content_sha256").agg(F.max(F.struct("version", "id")).alias("x")).select("policy_key", "content_sha256", "x.id", "x.version")


def provenance(policies: DataFrame, sources: DataFrame, configs: DataFrame) -> DataFrame:
    """Distinct (policy_key, page_url, site, region, last_seen_at) of every key; links without a source keep nulls."""
    p = policies.select(F.col("id").alias("policy_id"), "policy_key")
    c = configs.select(F.col("id").alias("source_id"), "site", "region")
    return sources.join(p, "policy_id").join(c, "source_id", "left").select("policy_key", "page_url", "site", "region", "last_seen_at").distinct()


def upserted(rows: DataFrame, keys: list[str], latest: list[str]) -> DataFrame:
    """One row for each key, the last by the given order: an upsert of appended rows. Null keys are kept as they are."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    with_key = rows.where(whole).groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*latest)).alias("x")).select("x.*")
    return with_key.unionByName(rows.where(~whole))


def backfilled(sources: DataFrame, policies: DataFrame, fetches: DataFrame) -> DataFrame:
    """Links (policy_id, fetch_id, source_id, page_url) that stored policies imply and `sources` doesn't have; equal keys
    with a null source are distinct, as in a unique index."""
    f = fetches.select(F.col("id").alias("fetch_id"), "source_id", "page_url").distinct()
    implied = policies.select(F.col("id").alias("policy_id"), F.col("source_fetch_id").alias("fetch_id")).join(f, "fetch_id")
    known = sources.select("policy_id", "source_id", "page_url").distinct()
    return implied.join(known, ["policy_id", "source_id", "page_url"], "left_anti").select("policy_id", "fetch_id", "source_id", "page_url").distinct()


def exported(policies: DataFrame, attachments: DataFrame, sources: DataFrame) -> DataFrame:
    """Current policies with nested lists of attachments and sources (empty lists where there are none)."""
    a = attachments.dropDuplicates(["id"]).groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("id", "name", "url", "fmt", "sha256", "parse_status"))).alias("attachments"))
    s = sources.select("policy_id", "source_id", "page_url").distinct().groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("page_url", "source_id"))).alias("sources"))
    d = search(policies).join(a.withColumnRenamed("policy_id", "id"), "id", "left").join(s.withColumnRenamed("policy_id", "id"), "id", "left")
    empty = {f.name: f.dataType for f in d.schema.fields if f.name in ("attachments", "sources")}
    for c, t in empty.items():
        d = d.withColumn(c, F.coalesce(F.col(c), F.array().cast(t)))
    return d


def reviewed(policies: DataFrame, events: DataFrame) -> DataFrame:
    """`policies` with the latest review event of each (policy_id, action, categories, at, id) folded in."""
    last = events.groupBy(F.col("policy_id").alias("id")).agg(F.max_by(F.struct("action", "categories"), F.struct("at", "id")).alias("e"))
    status = F.create_map(*[F.lit(x) for x in ("confirm", "confirmed", "adjust", "adjusted", "reject", "rejected")])
    d = policies.join(last, "id", "left")
    done = F.col("e").isNotNull()
    return (
        d.withColumn("review_status", F.when(done, F.try_element_at(status, F.col("e.action"))).otherwise(F.col("review_status")))
        .withColumn("need_review", F.when(done, F.lit(False)).otherwise(F.col("need_review")))
        .withColumn("is_investment_policy", F.when(F.col("e.action") == "reject", "no").when(done, "yes").otherwise(F.col("is_investment_policy")))
        .withColumn("category", F.when(F.col("e.action") == "adjust", F.array_join(F.array_distinct("e.categories"), ",")).otherwise(F.col("category"))).drop("e")
    )


def review_errors(events: DataFrame, policies: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """(id, error) of review events that can't be applied."""
    p = policies.select(F.col("id").alias("policy_id"), "category", F.lit(True).alias("known"))
    cats = F.coalesce("categories", F.array().cast("array<string>"))
    error = (
        F.when(F.col("known").isNull(), "unknown policy").when(~F.col("action").isin("confirm", "adjust", "reject"), "unknown action")
        .when((F.col("action") == "adjust") & ((F.size(cats) == 0) | (F.size(F.array_except(cats, F.array(*map(F.lit, codes)))) > 0)), "invalid labels").when((F.col("action") == "confirm") & (F.coalesce("category", F.lit("")) == ""), "no label to confirm")
    )
    return events.join(p, "policy_id", "left").select("id", error.alias("error")).where("error is not null")


def detail(policies: DataFrame, attachments: DataFrame, sources: DataFrame, configs: DataFrame, policy_id: int) -> DataFrame:
    """One policy with its versions, attachments and provenance, nested."""
    own = policies.where(F.col("id") == policy_id)
    key = own.select("policy_key")
    versions = policies.join(key, "policy_key", "left_semi").groupBy("policy_key").agg(F.sort_array(F.collect_list(F.struct("version", "id", "title")), asc=False).alias("versions"))
    files = attachments.where(F.col("policy_id") == policy_id).groupBy(F.col("policy_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("id", "name", "parse_status"))).alias("attachments"))
    where_ = provenance(policies.join(key, "policy_key", "left_semi"), sources, configs).groupBy("policy_key").agg(F.array_sort(F.collect_set(F.struct("page_url", "site", "region"))).alias("provenance"))
    return own.join(versions, "policy_key", "left").join(files, "id", "left").join(where_, "policy_key", "left")


def source_overview(sources: DataFrame, configured: DataFrame) -> DataFrame:
    """Stored sources with `in_config` and the note of the configuration."""
    c = configured.select("name", F.lit(True).alias("in_config"), "note")
    return sources.join(c, "name", "left").withColumn("in_config", F.coalesce("in_config", F.lit(False))).withColumn("note", F.coalesce("note", F.lit("")))


def migrated(df: DataFrame, schema: DataFrame) -> DataFrame:
    """`df` with the columns that a newer schema adds, as nulls."""
    return schema.limit(0).unionByName(df, allowMissingColumns=True)
