"""The queries of the engine over a folder of tables, with SQL for each that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweir.functions import text as T
from inkweir.functions import urls as U
from inkweir.operators import classify as C
from inkweir.operators import identity as I
from inkweir.operators import ingest as G
from inkweir.operators import views as V
from inkweir.sources import html, lists

# The lexicon of the test corpus; the operators take any.
LEXICON = C.Lexicon(
    relevance=("投资", "项目", "资金", "管网", "储能", "公路", "基础设施", "跨境结算"),
    exclude=("测试", "Error", "错误"),
    categories=(
        ("guide", "引导类", ("发展规划", "示范工程", "建设导则", "招商目录")),
        ("access", "准入类", ("准入条件", "批复", "前置", "负面清单", "审查")),
        ("guarantee", "保障类", ("资金方案", "用地指标", "融资安排", "利息补贴", "用能预算")),
        ("incentive", "激励约束类", ("奖补细则", "绩效目标", "考核指标", "退出安排", "监测数据")),
    ),
    types=(("征求意见稿", ("征求意见",)), ("解读", ("解读", "一图看懂")), ("项目批复", ("批复",)), ("申报通知", ("申报通知",)), ("正式政策", ("规划", "办法", "方案", "通知", "意见", "规定", "导则", "计划", "措施"))),
    strong=("申报通知", "项目批复"), weak=("正式政策", "征求意见稿"), boundary=(("实施方案", "mixed"),),
)
CODES = tuple(c for c, _, _ in LEXICON.categories)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w.lower().replace(' ', '')}'" for w in words) + "]"


def _sql_hits(words: tuple[str, ...], col: str = "t") -> str:
    return f"list_filter({_list(words)}, lambda w: contains({col}, w))"


def _sql_any(words: tuple[str, ...], col: str) -> str:
    return "(" + " or ".join(f"contains({col}, '{w.lower()}')" for w in words) + ")"


# Unicode white space for RE2, with the separators that Python counts as such.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CURRENT = "select * from policies qualify row_number() over (partition by policy_key order by version desc, id desc) = 1"
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_S: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        _Q[f.__name__] = f
        if sql:
            _S[f.__name__] = sql
        return f

    return add


_TEXT = "lower(replace(replace(concat_ws(' ', coalesce(title, ''), coalesce(content, '')), ' ', ''), chr(10), ''))"
_TITLE = "lower(replace(replace(coalesce(title, ''), ' ', ''), chr(10), ''))"
_TYPE = "case " + " ".join(f"when {_sql_any(w, 'tt')} then '{n}'" for n, w in LEXICON.types) + " else '其他' end"
_LABELS = f"""
with a as (select id, {_TEXT} t, {_TITLE} tt, lower(replace(replace(concat_ws(' ', coalesce(title, ''), substring(coalesce(content, ''), 1, 400)), ' ', ''), chr(10), '')) h from policies),
b as (select *, {_TYPE} ty, len({_sql_hits(LEXICON.relevance)}) n, {_sql_any(LEXICON.exclude, 'tt')} ex,
  {', '.join(f"{_sql_hits(w)} f{i}" for i, (_, _, w) in enumerate(LEXICON.categories))} from a),
c as (select *, list_sort(list_filter([{', '.join(f"{{'n': -len(f{i}), 'pos': {i}, 'code': '{c}', 'name': '{n}'}}" for i, (c, n, _) in enumerate(LEXICON.categories))}], lambda s: s.n < 0)) r,
  list_filter([{', '.join(f"case when len(f{i}) > 0 then '{n}:' || array_to_string(f{i}[1:3], '、') end" for i, (_, n, _) in enumerate(LEXICON.categories))}], lambda s: s is not null) ev from b)
select id, n as n_hits, case when ex then 'no' when n >= 2 or ty in ('申报通知', '项目批复') then 'yes' when n = 1 or ty in ('正式政策', '征求意见稿') then 'pending' else 'no' end as relevance,
  case when ex then '其他' else ty end as doc_type, case when ex then '' else array_to_string(list_transform(r, lambda s: s.code), ',') end as category,
  case when ex then '' else array_to_string(list_transform(r, lambda s: s.name), ',') end as category_names,
  case when ex then 'excluded' when len(r) > 0 then array_to_string(ev, '；') else '' end as reason,
  case when ex then '' when contains(h, '实施方案') then 'boundary:实施方案；mixed' when len(r) >= 3 then 'many' when len(r) = 2 and r[1].n = r[2].n then 'tie' else '' end as hint
from c"""


@query(_LABELS)
def lexicon_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Relevance, type, ranked labels, evidence words and review hint of every policy."""
    return C.labelled(table(spark, folder, "policies").select("id", "title", "content"), "title", "content", LEXICON).drop("title", "content")


@query(f"select relevance, doc_type, count(*) as n from ({_LABELS}) group by all")
def relevance_counts(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon_labels(spark, folder).groupBy("relevance", "doc_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"select id, sha256(regexp_replace(coalesce(content, ''), '{BLANK}+', '', 'g')) as digest from policies")
def content_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of the content without white space."""
    return table(spark, folder, "policies").select("id", T.fingerprint(F.col("content")).alias("digest"))


@query(
    f"""with a as (select policy_id, list_sort(list_distinct(list(coalesce(nullif(sha256, ''), 'missing:' || url)))) m from attachments group by 1)
select id, sha256(regexp_replace(coalesce(content, ''), '{BLANK}+', '', 'g') || chr(30) || coalesce(array_to_string(m, chr(31)), '')) as digest from policies left join a on policy_id = id"""
)
def document_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of the content and the sorted distinct marks of the attachments."""
    marks = F.collect_list(F.struct("sha256", "url"))
    a = table(spark, folder, "attachments").groupBy(F.col("policy_id").alias("id")).agg(marks.alias("files"))
    p = table(spark, folder, "policies").select("id", "content").join(a, "id", "left")
    return p.select("id", T.fingerprint(F.col("content"), F.coalesce("files", F.array().cast("array<struct<sha256:string,url:string>>"))).alias("digest"))


@query()
def identity_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Identity key of every policy (NFKC has no SQL; tested against a plain version)."""
    p = table(spark, folder, "policies")
    return p.select("id", I.identity_key(F.col("wenhao"), F.col("title"), F.col("issuing_authority"), F.col("site"), F.col("page_url")).alias("policy_key"))


_BATCH = f"""b as (select id seq, page_url url, coalesce(nullif(wenhao, ''), coalesce(issuing_authority, '') || ':' || coalesce(title, '')) natural_key,
  sha256(regexp_replace(coalesce(content, ''), '{BLANK}+', '', 'g')) digest, coalesce(is_investment_policy, '') <> 'no' st from policies)"""
_DECISIONS = f"""with {_BATCH},
a as (select *, min(case when st then seq end) over (partition by natural_key) anchor from b),
c as (select *, max(case when seq = anchor then digest end) over (partition by natural_key) ad from a),
d as (select *, case when seq > (case when digest = ad then anchor end) then 'duplicate_skip' when not st then 'excluded' when not coalesce(seq > anchor, false) then 'ingested' else 'suspected_duplicate' end decision from c)
select seq, url, natural_key as key, digest, decision, cast(case when decision = 'ingested' then sum(case when decision = 'ingested' then 1 else 0 end) over (partition by natural_key order by seq) when decision = 'suspected_duplicate' then 1 end as bigint) as version from d"""


def _batch(spark: SparkSession, folder: str) -> DataFrame:
    natural = F.coalesce(F.nullif("wenhao", F.lit("")), F.concat(F.coalesce("issuing_authority", F.lit("")), F.lit(":"), F.coalesce("title", F.lit(""))))
    return table(spark, folder, "policies").select(F.col("id").alias("seq"), F.col("page_url").alias("url"), natural.alias("natural"), T.fingerprint(F.col("content")).alias("digest"), (F.coalesce("is_investment_policy", F.lit("")) != "no").alias("storable"))


@query(_DECISIONS)
def dedup_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions over all policies as one batch of a fresh store."""
    return I.decisions(_batch(spark, folder))


# Candidates of the intake at new addresses, and every policy fetched again with its reviewer's hint put before the text.
_FETCHED = f"""files as (select policy_id, count(*) files, count(*) filter (parse_status = 'failed') failed, count(*) filter (parse_status = 'ok') whole, count(*) filter (coalesce(parsed_text, '') <> '') n_read from (select distinct id, policy_id, parse_status, parsed_text from attachments) group by 1),
fetched as (select cand_id seq, page_url url, policy_key natural_key, content, '' error, null::bigint files, null::bigint failed, null::bigint whole, null::bigint n_read, case when contains(content, '项目') then 'yes' else 'no' end relevance, false needs from intake
  union all select 1000000000 + p.id, page_url, policy_key, coalesce(reviewer_hint, '') || coalesce(content, ''), coalesce(fallback_reason, ''), files, failed, whole, n_read, is_investment_policy, need_review from policies p left join files f on f.policy_id = p.id),
links as (select page_url url, max(policy_key) lkey from policies group by 1),
known as (select policy_key kkey, sha256(regexp_replace(coalesce(content, ''), '{BLANK}+', '', 'g')) kdigest, version from policies),
states as (select policy_key skey, max_by(review_status, version) state from policies group by 1),
b as (select f.*, sha256(regexp_replace(coalesce(content, ''), '{BLANK}+', '', 'g')) digest, lkey, error <> '' or coalesce(failed, 0) > 0 or coalesce(whole, 0) < coalesce(files, 0) partly, coalesce(files, 0) > 0 and coalesce(n_read, 0) = 0 unread from fetched f left join links l on l.url = f.url),
c as (select *, case when trim(coalesce(content, '')) = '' and coalesce(files, 0) = 0 then coalesce(nullif(error, ''), 'empty') when lkey is not null and coalesce(failed, 0) > 0 then 'attachment' end why, case when relevance = 'no' and (partly or unread) then 'pending' else relevance end rel, coalesce(lkey, natural_key) as key from b),
t as (select *, coalesce(rel, '') <> 'no' st, (select max(version) from known where kkey = c.key) top, exists (select 1 from known where kkey = c.key and kdigest = c.digest) recorded from c where why is null),
u as (select *, min(case when st then seq end) over (partition by key) anchor, min(case when st and lkey is not null then seq end) over (partition by key, digest) upd from t),
v as (select *, max(case when seq = anchor then digest end) over (partition by key) ad from u),
w as (select *, case when seq > (case when recorded then -1 when top is not null then upd when digest = ad then anchor end) then 'duplicate_skip' when not st then 'excluded' when top is null and not coalesce(seq > anchor, false) then 'ingested' when lkey is null then 'suspected_duplicate' else 'updated' end decision from v),
d as (select *, case when decision in ('ingested', 'updated') then coalesce(top, 0) + sum(case when decision in ('ingested', 'updated') then 1 else 0 end) over (partition by key order by seq) when decision = 'suspected_duplicate' then 1 end ver from w),
e as (select c.seq, c.url, d.key, c.why, c.partly, c.unread, c.rel, c.needs, coalesce(c.failed, 0) > 0 missing, d.decision, d.ver, state, coalesce(d.decision in ('ingested', 'updated', 'suspected_duplicate'), false) kept from c left join d on d.seq = c.seq left join states on skey = d.key),
o as (select *, case when kept then coalesce(needs, false) or partly or unread or decision in ('suspected_duplicate', 'updated') end nr from e),
ingest as (select seq, url, case when decision = 'suspected_duplicate' then key || ':variant:' || substring(sha256(url), 1, 16) else key end policy_key, case when decision = 'suspected_duplicate' then key else '' end related_policy_key, cast(ver as bigint) as version,
  case when why is not null then 'failed' when decision = 'duplicate_skip' and not partly and coalesce(state, '') not in ('confirmed', 'adjusted', 'rejected') then 'reclassified' when decision = 'duplicate_skip' then 'duplicate' else decision end outcome,
  case when why is not null then 'failed' when decision = 'excluded' then 'excluded' when missing then 'failed' else 'processed' end status, rel relevance, nr need_review,
  case when kept then case when nr then 'pending' when rel = 'no' then 'rejected' else 'confirmed_auto' end end review_status,
  concat_ws(';', why, case when kept and partly then 'incomplete' end, case when kept and unread then 'unread' end, case when decision = 'suspected_duplicate' then 'compare' end) note from o)"""


def _ingested(spark: SparkSession, folder: str) -> DataFrame:
    p, c = table(spark, folder, "policies"), table(spark, folder, "intake")
    state = F.col("parse_status")
    a = table(spark, folder, "attachments").select("id", "policy_id", "parse_status", "parsed_text").distinct().groupBy("policy_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(state == "failed").alias("failed"), F.count_if(state == "ok").alias("whole"), F.count_if(F.coalesce("parsed_text", F.lit("")) != "").alias("read"))
    none = [F.lit(None).cast("long").alias(x) for x in ("files", "failed", "whole", "read")]
    fresh = c.select(F.col("cand_id").alias("seq"), F.col("page_url").alias("url"), F.col("policy_key").alias("natural"), "content", F.lit("").alias("error"), *none, F.when(F.col("content").contains("项目"), "yes").otherwise("no").alias("relevance"), F.lit(False).alias("needs"))
    text = F.concat(F.coalesce("reviewer_hint", F.lit("")), F.coalesce("content", F.lit("")))
    again = p.join(a.withColumnRenamed("policy_id", "id"), "id", "left").select((F.col("id") + 1000000000).alias("seq"), F.col("page_url").alias("url"), F.col("policy_key").alias("natural"), text.alias("content"), F.coalesce("fallback_reason", F.lit("")).alias("error"), "files", "failed", "whole", "read", F.col("is_investment_policy").alias("relevance"), F.col("need_review").alias("needs"))
    batch = fresh.unionByName(again).withColumn("digest", T.fingerprint(F.col("content")))
    links = p.groupBy(F.col("page_url").alias("url")).agg(F.max("policy_key").alias("key"))
    known = p.select(F.col("policy_key").alias("key"), T.fingerprint(F.col("content")).alias("digest"), "version")
    states = p.groupBy(F.col("policy_key").alias("key")).agg(F.max_by("review_status", "version").alias("review_status"))
    return G.ingest_decisions(batch, links, known, states, again=True)


@query(f"with {_FETCHED} select * from ingest")
def ingest_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of the intake's candidates and of all stored pages fetched again."""
    return _ingested(spark, folder)


@query(f"with {_FETCHED} select outcome, count(*) as n, cast(count(*) filter (need_review) as bigint) as need_review from ingest group by 1")
def ingest_counters(spark: SparkSession, folder: str) -> DataFrame:
    return G.counters(_ingested(spark, folder))


@query("select id, case when need_review then 'pending' when is_investment_policy = 'no' then 'rejected' else 'confirmed_auto' end as review_status, case when trim(coalesce(content, '')) = '' then 'empty' else '' end as problem, coalesce(nullif(title, ''), '待核实标题') as title from policies")
def review_status_derived(spark: SparkSession, folder: str) -> DataFrame:
    """The state each record has before anyone looks at it, whether it can be taken, and the title it gets."""
    return table(spark, folder, "policies").select("id", G.review_status(F.col("need_review"), F.col("is_investment_policy")).alias("review_status"), G.valid(F.col("content"), F.lit(0), F.lit("")).alias("problem"), G.named(F.col("title"), F.lit(None)).alias("title"))


@query(f"with {_BATCH}, f as (select *, row_number() over (partition by natural_key, digest order by seq) = 1 first_seen from b) select seq, natural_key as key, cast(sum(cast(first_seen as int)) over (partition by natural_key order by seq) as bigint) as version from f")
def snapshot_versions(spark: SparkSession, folder: str) -> DataFrame:
    return I.snapshot_versions(_batch(spark, folder), "natural", "seq", "digest").select("seq", F.col("natural").alias("key"), "version")


@query("select id, policy_key, version, title from policies p where version = (select max(version) from policies v where v.policy_key = p.policy_key)")
def current_policies(spark: SparkSession, folder: str) -> DataFrame:
    return V.current(table(spark, folder, "policies").select("id", "policy_key", "version", "title"))


@query(f"""select id, title from ({CURRENT}) where coalesce(review_status, '') <> 'rejected' and region = '岚泽省' and (contains(lower(coalesce(category, '')), 'guide') or contains(lower(coalesce(category_names, '')), 'guide'))
 and (contains(title, '资金') or contains(content, '资金') or contains(wenhao, '资金')) order by id desc limit 20 offset 20""")
def policy_search(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of a search (the limit is the page size)."""
    return V.paged(V.search(table(spark, folder, "policies"), region="岚泽省", category="guide", keyword="资金").select("id", "title"), 20, 20)


@query(f"select id, title from ({CURRENT}) where coalesce(review_status, '') <> 'rejected' and (contains(title, '资金') or contains(content, '资金') or contains(wenhao, '资金'))")
def keyword_matches(spark: SparkSession, folder: str) -> DataFrame:
    return V.search(table(spark, folder, "policies"), keyword="资金").select("id", "title")


@query(f"select distinct region from ({CURRENT}) where region <> ''")
def region_list(spark: SparkSession, folder: str) -> DataFrame:
    return V.regions(table(spark, folder, "policies"))


@query(f"select coalesce(nullif(category_names, ''), '未分类') as category_names, count(*) as n, max(id) as newest from ({CURRENT}) where coalesce(review_status, '') <> 'rejected' group by 1")
def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return V.category_counts(table(spark, folder, "policies"))


@query(f"""with c as ({CURRENT}) select (select count(*) from source_configs) as sources, (select count(*) from source_configs where enabled) as sources_enabled,
 (select count(*) from c where coalesce(review_status, '') <> 'rejected') as policies, (select count(*) from c where need_review) as pending_review, (select count(*) from c where review_status in ('confirmed', 'adjusted')) as confirmed,
 (select count(*) from c where review_status = 'rejected') as rejected, (select count(*) from fetch_records) as fetches, (select count(*) from run_logs) as runs, (select count(*) from attachments) as attachments""")
def dashboard_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    return V.dashboard(t("source_configs"), t("policies"), t("fetch_records"), t("run_logs"), t("attachments"))


_QUEUE = "case when status in ('discovered', 'failed', 'downloaded') then 0 else 1 end, last_checked_at asc nulls first, id"


@query(f"select distinct source_id, id, cast(place as int) as place from (select *, row_number() over (partition by source_id order by {_QUEUE}) place from (select distinct id, source_id, status, last_checked_at from fetch_records)) where place <= 20")
def fair_rotation_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The next 20 records of every source (the limit is the queue's length)."""
    return V.rotation_all(table(spark, folder, "fetch_records").select("id", "source_id", "status", "last_checked_at").distinct(), 20).select("source_id", "id", "place")


@query(f"select id from (select distinct id, source_id, status, last_checked_at from fetch_records where source_id = 7 and status = 'failed') order by {_QUEUE} limit 50")
def retry_queue(spark: SparkSession, folder: str) -> DataFrame:
    return V.rotation(table(spark, folder, "fetch_records").select("id", "source_id", "status", "last_checked_at").distinct(), 7, 50, retry_only=True).select("id")


_C5 = ("discovered", "downloaded", "ingested", "duplicate", "failed")


@query(f"""with a as (select source_id, {', '.join(f"coalesce(try_cast(json_extract_string(summary, '$.{c}') as bigint), 0) {c}" for c in _C5)} from run_logs)
select source_id, {', '.join(f"cast(sum({c}) as bigint) as {c}" for c in _C5)}, case when sum(failed) > 0 and sum(downloaded) = 0 then 'failed' when sum(failed) > 0 then 'partial' else 'ok' end as status from a group by 1""")
def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    return V.run_totals(table(spark, folder, "run_logs"), ["source_id"], _C5)


@query("select distinct r.id, r.run_id, r.status, coalesce(s.name, cast(r.source_id as varchar), '-') as source_name, (select coalesce(bool_or(status = 'running'), false) from run_logs) as any_running from run_logs r left join source_configs s on s.id = r.source_id")
def run_view(spark: SparkSession, folder: str) -> DataFrame:
    return V.run_view(table(spark, folder, "run_logs"), table(spark, folder, "source_configs")).select("id", "run_id", "status", "source_name", "any_running").distinct()


@query("select id, case when status = 'running' then 'failed' else status end as status, case when status = 'running' then coalesce(note, '') || '；interrupted' else note end as note from run_logs")
def runs_recovered(spark: SparkSession, folder: str) -> DataFrame:
    return V.recovered(table(spark, folder, "run_logs")).select("id", "status", "note")


_NORM = r"""case when regexp_extract({u}, '^\s*([A-Za-z][A-Za-z0-9+.\-]*):', 1) <> '' then lower(regexp_extract({u}, '^\s*([A-Za-z][A-Za-z0-9+.\-]*):', 1)) || ':' else '' end
 || case when regexp_matches({u}, '^[^/?#]*//') then '//' || lower(regexp_extract({u}, '^[^/?#]*//([^/?#]*)', 1)) else '' end || regexp_extract({u}, '^(?:[^/?#]*//[^/?#]*)?([^?#]*)', 1) || nullif(regexp_extract({u}, '^[^?#]*(\?[^#]*)?', 1), '?')"""


@query("select id, " + _NORM.format(u="page_url").replace("nullif(regexp_extract(page_url, '^[^?#]*(\\?[^#]*)?', 1), '?')", "coalesce(nullif(regexp_extract(page_url, '^[^?#]*(\\?[^#]*)?', 1), '?'), '')") + " as url from fetch_records")
def url_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetch_records").select("id", U.normalized(F.col("page_url")).alias("url"))


@query(r"""with s as (select id source_id, lower(regexp_extract(list_url, '^[a-z]+://([^/?#:]*)', 1)) h, cast(json(include) as varchar[]) inc, cast(json(exclude) as varchar[]) exc from source_configs)
select f.id, coalesce(regexp_matches(page_url, '^https?://[^/?#]') and lower(regexp_extract(page_url, '^[a-z]+://([^/?#:]*)', 1)) = h and (len(coalesce(inc, [])) = 0 or len(list_filter(inc, lambda k: contains(page_url, k))) > 0)
 and len(list_filter(coalesce(exc, []), lambda k: contains(page_url, k))) = 0 and not regexp_matches(regexp_extract(page_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(?i)\.(jpg|jpeg|png|gif|css|js|svg)$'), false) as allowed
from fetch_records f left join s using (source_id)""")
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each recorded URL passes its source's filter."""
    as_list = lambda c: F.from_json(c, "array<string>")
    s = table(spark, folder, "source_configs").select(F.col("id").alias("source_id"), "list_url", as_list("include").alias("include"), as_list("exclude").alias("exclude"))
    f = table(spark, folder, "fetch_records").select("id", "source_id", "page_url").join(s, "source_id", "left")
    return f.select("id", U.allowed(F.col("page_url"), F.col("list_url"), F.col("include"), F.col("exclude")).alias("allowed"))


@query("select id as source_id, g.n as page, replace(replace(list_url, '{page0}', cast(g.n - 1 as varchar)), '{page}', cast(g.n as varchar)) as url from source_configs, lateral (select unnest(range(1, greatest(1, coalesce(max_pages, 1)) + 1)) n) g")
def list_pages(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "source_configs")
    p = s.select(F.col("id").alias("source_id"), F.explode(U.page_urls(F.col("list_url"), F.lit(""), F.col("max_pages"))).alias("p"))
    return p.select("source_id", F.col("p.page").cast("long").alias("page"), "p.url")


@query("select source_id, page_url as url, cand_id from intake i where not exists (select 1 from fetch_records f where f.source_id = i.source_id and f.page_url = i.page_url) or source_id is null or page_url is null")
def new_links(spark: SparkSession, folder: str) -> DataFrame:
    return lists.new_links(table(spark, folder, "intake").select("source_id", F.col("page_url").alias("url"), "cand_id"), table(spark, folder, "fetch_records"))


@query("select s.page_url, max(p.id) as policy_id, max_by(p.policy_key, p.id) as policy_key from policy_sources s join policies p on p.id = s.policy_id group by 1")
def policy_of_url(spark: SparkSession, folder: str) -> DataFrame:
    return V.policy_of_url(table(spark, folder, "policies"), table(spark, folder, "policy_sources"))


@query("select policy_key, content_sha256, max_by(id, version) as id, max(version) as version from policies group by 1, 2")
def matching_versions(spark: SparkSession, folder: str) -> DataFrame:
    return V.matching_version(table(spark, folder, "policies"))


@query("select distinct p.policy_key, s.page_url, c.site, c.region, strftime(s.last_seen_at, '%Y-%m-%d %H:%M:%S') as last_seen_at from policy_sources s join policies p on p.id = s.policy_id left join source_configs c on c.id = s.source_id")
def provenance(spark: SparkSession, folder: str) -> DataFrame:
    d = V.provenance(table(spark, folder, "policies"), table(spark, folder, "policy_sources"), table(spark, folder, "source_configs"))
    return d.withColumn("last_seen_at", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss")).distinct()


@query("""select distinct p.id as policy_id, f.id as fetch_id, f.source_id, f.page_url from policies p join fetch_records f on f.id = p.source_fetch_id
where not exists (select 1 from policy_sources s where s.fetch_id is null and s.policy_id = p.id and s.source_id = f.source_id and s.page_url = f.page_url)""")
def provenance_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Links that the stored policies imply beside those recorded without a fetch, as before links had fetches."""
    return V.backfilled(table(spark, folder, "policy_sources").where("fetch_id is null"), table(spark, folder, "policies"), table(spark, folder, "fetch_records"))


@query("select policy_id, source_id, page_url, strftime(max(last_seen_at), '%Y-%m-%d %H:%M:%S') as last_seen_at from policy_sources where policy_id is not null and source_id is not null and page_url is not null group by 1, 2, 3")
def provenance_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated links as one row with the last time seen."""
    d = V.upserted(table(spark, folder, "policy_sources"), ["policy_id", "source_id", "page_url"], ["last_seen_at", "fetch_id"])
    return d.select("policy_id", "source_id", "page_url", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen_at")).where("policy_id is not null and source_id is not null and page_url is not null")


@query(f"""with a as (select policy_id, count(*) na, string_agg(name || ':' || parse_status, '|' order by id) files from (select distinct on (id) * from attachments) group by 1),
s as (select policy_id, count(*) ns, string_agg(page_url, '|' order by page_url, source_id) urls from (select distinct policy_id, source_id, page_url from policy_sources) group by 1)
select p.id, coalesce(na, 0) as n_attachments, coalesce(files, '') as files, coalesce(ns, 0) as n_sources, coalesce(urls, '') as urls from ({CURRENT}) p left join a on a.policy_id = p.id left join s on s.policy_id = p.id where coalesce(review_status, '') <> 'rejected'""")
def export_nested(spark: SparkSession, folder: str) -> DataFrame:
    """The export with its nested lists, flattened to texts for comparison."""
    d = V.exported(table(spark, folder, "policies").select("id", "policy_key", "version", "review_status"), table(spark, folder, "attachments"), table(spark, folder, "policy_sources"))
    files = F.array_join(F.transform("attachments", lambda a: F.concat(a["name"], F.lit(":"), a["parse_status"])), "|")
    return d.select("id", F.size("attachments").cast("long").alias("n_attachments"), files.alias("files"), F.size("sources").cast("long").alias("n_sources"), F.array_join(F.transform("sources", lambda s: s["page_url"]), "|").alias("urls"))


@query(r"select id, case when regexp_matches(regexp_replace(title, '^" + BLANK + r"+', ''), '^[=+\-@]') then '''' || title else title end as title from policies")
def csv_guard(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "policies").select("id", T.guarded(F.col("title")).alias("title"))


_GOLD = "select id, review_status <> 'rejected' relevant, case when review_status = 'rejected' then [] else list_filter(string_split(coalesce(category, ''), ','), lambda x: x in ('guide', 'access', 'guarantee', 'incentive')) end cats from policies where review_status in ('confirmed', 'adjusted', 'rejected')"


@query(f"""with g as ({_GOLD}), p as (select id, relevance, list_filter(string_split(category, ','), lambda x: x <> '') c from ({_LABELS})), j as (select relevant, cats, relevance, case when relevance = 'yes' then c else [] end pred from g join p using (id)),
s as (select count(*) n, sum(cast(relevance = 'yes' and relevant as int)) tp, sum(cast(relevance = 'yes' and not relevant as int)) fp, sum(cast(relevance <> 'yes' and relevant as int)) fn,
 sum(len(list_filter(cats, lambda x: list_contains(pred, x)))) ct, sum(len(list_filter(pred, lambda x: not list_contains(cats, x)))) cp, sum(len(list_filter(cats, lambda x: not list_contains(pred, x)))) cn,
 sum(cast(list_sort(pred) = list_sort(cats) and (relevance = 'yes') = relevant and relevance <> 'pending' as int)) ex, sum(cast(relevance = 'pending' as int)) pe from j)
select n as labeled_records, round(cast(tp as double) / nullif(tp + fp, 0), 4) as relevance_precision, round(cast(tp as double) / nullif(tp + fn, 0), 4) as relevance_recall, round(cast(ct as double) / nullif(ct + cp, 0), 4) as category_micro_precision,
 round(cast(ct as double) / nullif(ct + cn, 0), 4) as category_micro_recall, round(cast(ex as double) / nullif(n, 0), 4) as exact_match, cast(pe as bigint) as pending, cast(0 as bigint) as rule_fallback from s""")
def evaluate_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The lexicon's results against the reviewed records."""
    status = F.col("review_status")
    own = F.filter(F.split(F.coalesce("category", F.lit("")), ","), lambda x: x.isin(*CODES))
    reviewed = table(spark, folder, "policies").where(status.isin("confirmed", "adjusted", "rejected"))  # only these are labelled
    gold = reviewed.select("id", (status != "rejected").alias("relevant"), F.when(status == "rejected", F.array().cast("array<string>")).otherwise(own).alias("categories"))
    made = C.labelled(reviewed.select("id", "title", "content"), "title", "content", LEXICON)
    return C.evaluated(gold, made.select("id", "relevance", "category", F.lit("rule").alias("method")))


@query("select id, cast(g.i as int) as idx, cast(greatest(1, ceil(length(coalesce(content, '')) / 500.0)) as int) as n_chunks, length(coalesce(content, '')) > 4000 as truncated, substring(coalesce(content, ''), g.i * 500 + 1, 500) as chunk from policies, lateral (select unnest(range(0, least(8, cast(greatest(1, ceil(length(coalesce(content, '')) / 500.0)) as bigint)))) i) g")
def chunk_text(spark: SparkSession, folder: str) -> DataFrame:
    """Slices of 500 characters, eight at most (the limit is the model's window)."""
    return C.in_chunks(table(spark, folder, "policies"), ["id"], "content", 500, 8).select("id", "idx", "n_chunks", "truncated", "chunk")


@query(f"""with k as (select id, cast(g.i as int) idx, length(coalesce(content, '')) > 4000 truncated, lower(replace(replace(substring(coalesce(content, ''), g.i * 500 + 1, 500), ' ', ''), chr(10), '')) t
 from policies, lateral (select unnest(range(0, least(8, cast(greatest(1, ceil(length(coalesce(content, '')) / 500.0)) as bigint)))) i) g), l as (select *, len({_sql_hits(LEXICON.relevance)}) n from k),
m as (select *, case when n >= 2 then 'yes' when n = 1 then 'pending' else 'no' end r from l)
select id, case when bool_or(r = 'yes') then 'yes' when bool_and(r = 'no') and not bool_or(truncated) then 'no' else 'pending' end as relevance, bool_or(truncated) as truncated,
 array_to_string(list_distinct_ordered, '；') as reason from (select id, r, truncated, list_transform(list_filter(list_transform(w, lambda x, i: {{'x': x, 'i': i}}), lambda s: list_position(w, s.x) = s.i), lambda s: s.x) list_distinct_ordered
 from (select m.id, r, truncated, w from m join (select id, list('hits ' || n order by idx) w from m group by id) q using (id))) group by id, list_distinct_ordered""")
def chunk_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Results of the slices merged for each text."""
    c = C.in_chunks(table(spark, folder, "policies"), ["id"], "content", 500, 8)
    n = F.size(C.hits(T.for_match(F.col("chunk")), LEXICON.relevance))
    parts = c.select("id", "idx", "truncated", F.when(n >= 2, "yes").when(n == 1, "pending").otherwise("no").alias("relevance"), F.array().cast("array<string>").alias("labels"), F.lit("其他").alias("doc_type"), F.lit(False).alias("need_review"), F.concat(F.lit("hits "), n.cast("string")).alias("reason"), F.lit("").alias("evidence"), F.lit("").alias("hint"))
    return C.merged(parts, ["id"]).select("id", "relevance", "truncated", "reason")


@query("select id, coalesce(json_extract_string(classification_json, '$.relevance'), '') as relevance, coalesce(json_extract_string(classification_json, '$.method'), '') as method from fetch_records")
def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    j = F.from_json("classification_json", "struct<relevance:string,method:string>")
    return table(spark, folder, "fetch_records").withColumn("j", j).select("id", F.coalesce("j.relevance", F.lit("")).alias("relevance"), F.coalesce("j.method", F.lit("")).alias("method"))


@query("select coalesce(classification_method, '') as method, count(*) as n, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from policies group by 1")
def method_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and token sums by classification method."""
    return table(spark, folder, "policies").groupBy(F.coalesce("classification_method", F.lit("")).alias("method")).agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query("""with e as (select event_id, user_id % 500 + 1 policy_id, case event_type when 'view' then 'confirm' when 'purchase' then 'adjust' when 'error' then 'reject' end act, ts from events where event_type in ('view', 'purchase', 'error')),
l as (select policy_id, max_by(act, (ts, event_id)) act from e group by 1)
select p.id, case act when 'confirm' then 'confirmed' when 'adjust' then 'adjusted' when 'reject' then 'rejected' else review_status end as review_status, case when act is not null then false else need_review end as need_review,
 case when act = 'reject' then 'no' when act is not null then 'yes' else is_investment_policy end as is_investment_policy, case when act = 'adjust' then 'guide,access' else category end as category from policies p left join l on l.policy_id = p.id""")
def review_fold(spark: SparkSession, folder: str) -> DataFrame:
    """A log of review actions (taken from the event stream) folded onto the records."""
    kind = F.col("event_type")
    e = table(spark, folder, "events").where(kind.isin("view", "purchase", "error")).select(
        F.col("event_id").alias("id"), (F.col("user_id") % 500 + 1).alias("policy_id"), F.when(kind == "view", "confirm").when(kind == "purchase", "adjust").otherwise("reject").alias("action"), F.array(F.lit("guide"), F.lit("access"), F.lit("guide")).alias("categories"), F.col("ts").alias("at")
    )
    p = table(spark, folder, "policies").select("id", "review_status", "need_review", "is_investment_policy", "category")
    return V.reviewed(p, e)


_DAY = r"coalesce(strftime(try_strptime(regexp_extract({x}, '((?:19|20)\d{{2}})\s*[-/年.]\s*(\d{{1,2}})\s*[-/月.]\s*(\d{{1,2}})', 1) || '-' || lpad(regexp_extract({x}, '((?:19|20)\d{{2}})\s*[-/年.]\s*(\d{{1,2}})\s*[-/月.]\s*(\d{{1,2}})', 2), 2, '0') || '-' || lpad(regexp_extract({x}, '((?:19|20)\d{{2}})\s*[-/年.]\s*(\d{{1,2}})\s*[-/月.]\s*(\d{{1,2}})', 3), 2, '0'), '%Y-%m-%d'), '%Y-%m-%d'), '')"


@query("select id, " + _DAY.format(x="coalesce(content, '')") + " as first_date from policies")
def date_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The first date of every text."""
    return table(spark, folder, "policies").select("id", T.iso_date(F.coalesce("content", F.lit(""))).alias("first_date"))


@query(r"with d as (select id, list_last(regexp_extract_all(coalesce(content, ''), '(?m)^[\s\x{3000}]*((?:19|20)\d{2}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日)[\s\x{3000}]*$', 1)) x from policies) select id, " + _DAY.format(x="coalesce(x, '')") + " as doc_date from d")
def signature_dates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "policies").select("id", T.signature_date(F.col("content")).alias("doc_date"))


@query()
def document_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Issuing number, signature date and signers found in every text (tested against a plain version)."""
    return table(spark, folder, "policies").select("id", T.issuing_number(F.col("content"), F.col("title")).alias("wenhao"), T.signature_date(F.col("content")).alias("doc_date"), T.signers(F.col("content")).alias("issuers"))


@query(r"""select raw_path, case when length(html) < 2000 then 'shell' when regexp_matches(html, '(?i)AuthorizedRead[^"'']*unitbuild') or contains(html, 'unitbuild.js') then 'unitbuild' when contains(html, '<recordset>') and contains(html, '<a ') then 'recordset'
 when len(list_distinct(list_filter(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1), lambda h: regexp_matches(h, '/(?:art|content|detail|info|t\d{8}_\d+|20\d{2}/)')))) >= 5 then 'html-static' else 'js-render' end as kind from raw_pages""")
def list_kind_probe(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_pages").select("raw_path", lists.list_kind(F.col("html")).alias("kind"))


@query()
def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """Title, text, dates, number, authority and attachments of every stored page."""
    d = table(spark, folder, "raw_pages").select("raw_path", html.parsed(F.col("html"), F.lit("https://site.example/")).alias("p"))
    return d.select("raw_path", "p.title", "p.content", "p.page_date", "p.wenhao", "p.issuing_authority", "p.doc_date", F.size("p.attachments").alias("n_attachments"), "p.parse_error")


@query()
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """The links of every stored page, resolved, filtered and kept once."""
    none = F.array().cast("array<string>")
    base = F.concat(F.lit("https://"), F.regexp_extract("raw_path", "downloads/([^/]+)/", 1), F.lit(".example/"))
    pages = table(spark, folder, "raw_pages").select(F.xxhash64("raw_path").alias("source_id"), F.lit(1).alias("page"), base.alias("page_url"), base.alias("list_url"), none.alias("include"), none.alias("exclude"), "html")
    return lists.page_links(pages)


@query("select parse_status, fmt, count(distinct id) as n, cast(count(distinct case when parsed_text <> '' then id end) as bigint) as with_text from attachments group by all")
def attachment_status(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "attachments").groupBy("id", "parse_status", "fmt").agg(F.max(F.when(F.col("parsed_text") != "", 1).otherwise(0)).alias("t"))
    return a.groupBy("parse_status", "fmt").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("with_text"))


@query("select source_id, status, count(*) as n, count(distinct page_url) as urls, cast(sum(case when coalesce(raw_path, '') = '' then 0 else 1 end) as bigint) as stored from fetch_records group by all")
def fetch_status(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "fetch_records").groupBy("source_id", "status", "page_url").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.coalesce("raw_path", F.lit("")) == "", 0).otherwise(1)).alias("stored"))
    return f.groupBy("source_id", "status").agg(F.sum("n").alias("n"), F.count("page_url").alias("urls"), F.sum("stored").alias("stored"))


@query("select source_id, content_sha256, count(*) as n, min(id) as first_id from fetch_records where content_sha256 <> '' and raw_path <> '' group by 1, 2")
def stored_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """The content-addressed store: one blob for each source and digest."""
    f = table(spark, folder, "fetch_records").where("content_sha256 <> '' and raw_path <> ''")
    return f.groupBy("source_id", "content_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("select id, name, site, region from source_configs where enabled order by id")
def enabled_sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_configs").where("enabled").select("id", "name", "site", "region").orderBy("id")


@query("select id, array_to_string(list_transform(list_filter(string_split(coalesce(category, ''), ','), lambda x: x <> ''), lambda x: case x when 'guide' then '引导类' when 'access' then '准入类' when 'guarantee' then '保障类' when 'incentive' then '激励约束类' else x end), '、') as names from policies")
def category_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "policies").select("id", F.array_join(T.label_names(F.col("category"), {c: n for c, n, _ in LEXICON.categories}), "、").alias("names"))


@query("""with a as (select policy_id, string_agg('[附件：' || coalesce(name, '') || ']' || chr(10) || parsed_text, chr(10) || chr(10) order by id) t from (select distinct on (id) * from attachments) where length(parsed_text) > 0 group by 1)
select id, sha256(concat_ws(chr(10) || chr(10), '[正文]' || chr(10) || coalesce(content, ''), t)) as digest, length(concat_ws(chr(10) || chr(10), '[正文]' || chr(10) || coalesce(content, ''), t)) as n_chars from policies left join a on policy_id = id""")
def analysis_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Body and attachment texts put together, as digest and length."""
    a = table(spark, folder, "attachments").dropDuplicates(["id"]).where("length(parsed_text) > 0").groupBy(F.col("policy_id").alias("key")).agg(F.array_sort(F.collect_list(F.struct("id", "name", "parsed_text"))).alias("files"))
    p = table(spark, folder, "policies").select("id", "content").join(a.withColumnRenamed("key", "id"), "id", "left")
    t = T.analysis_text(F.col("content"), F.coalesce("files", F.array().cast("array<struct<id:bigint,name:string,parsed_text:string>>")))
    return p.select("id", F.sha2(t, 256).alias("digest"), F.length(t).cast("long").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_decisions(spark, folder)
