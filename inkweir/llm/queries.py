"""The pN_ queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweir.llm import boilerplate, intake, neardup, packing, personal, residue, skeletons, splitting, tokens


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


FIELDS = {"title": False, "wenhao": True}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of policies whose title or issuing number read the same and are stored differently."""
    return skeletons.same_reading_pairs(table(spark, folder, "policies"), "id", FIELDS)


def p1_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every title and issuing number."""
    return skeletons.consistent_forms(table(spark, folder, "policies"), "id", FIELDS)


def _long_texts(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame]]:
    return [("policies", table(spark, folder, "policies").select("id", F.col("content").alias("text"))), ("attachments", table(spark, folder, "attachments").select("id", F.col("parsed_text").alias("text")))]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Contents and parsed texts over 2,000 characters and whether they have boundaries to cut at."""
    parts = [splitting.oversized(df, "id", "text").select(F.lit(name).alias("tbl"), F.col("key").alias("item_id"), "kind") for name, df in _long_texts(spark, folder)]
    return parts[0].unionByName(parts[1]).distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The numbered pieces of every content and parsed text."""
    parts = [splitting.pieces(df.dropDuplicates(["id"]) if name == "attachments" else df, ["id"], "text").withColumn("tbl", F.lit(name)) for name, df in _long_texts(spark, folder)]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of policies alike by at least 0.6."""
    return neardup.near_pairs(table(spark, folder, "policies"), "id", "title", "content")


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every policy with the class of its exact text, its group of alike records and its number of links."""
    return neardup.near_groups(table(spark, folder, "policies"), "id", "title", "content")


def _pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    policies = table(spark, folder, "policies")
    urls = table(spark, folder, "fetch_records").where("raw_path <> ''").groupBy("raw_path").agg(F.min("page_url").alias("page_url"))
    stored = table(spark, folder, "raw_pages").join(urls, "raw_path", "left").withColumn("url", F.coalesce("page_url", "raw_path"))
    both = boilerplate.pages(policies, "policies", "id", "page_url", "content", False, "title").unionByName(boilerplate.pages(stored, "raw_pages", "raw_path", "url", "html", True))
    return policies, both


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Furniture lines of policies and document lines of the stored pages."""
    policies, both = _pages(spark, folder)
    found = boilerplate.differenced(both, errors=residue.fit(policies))
    lines = F.when(F.col("tbl") == "policies", F.col("dropped")).otherwise(F.col("kept"))
    return found.select("tbl", F.col("key").alias("item_key"), F.explode(lines).alias("line_no")).distinct()


def p4_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every policy and stored page without furniture."""
    policies, both = _pages(spark, folder)
    return boilerplate.body_texts(both, errors=residue.fit(policies))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Policies that are template residue, filler or error pages."""
    return residue.judged(table(spark, folder, "policies")).where("residue").select("id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of the intake that repeat a policy or an earlier candidate, and how."""
    return intake.repeated_candidates(table(spark, folder, "policies"), table(spark, folder, "intake")).select("cand_id", "kind")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container and place of every document, cut only above 4,096 tokens."""
    return packing.pack_texts(table(spark, folder, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of personal information in the documents."""
    return personal.find(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "kind", "start_pos").distinct()


def p9_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with typed placeholders for the personal information."""
    return personal.masked(table(spark, folder, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


# Unicode white space for RE2.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: A full stop and the blank after it belong to different stretches.
STRETCHES = r"regexp_split_to_array(replace(text, '. ', '.' || chr(1) || ' '), '[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}。！？；!?;\x01]')"


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query over whole tables in reasonable time."""
    return {
        "p2_found": f"""select distinct tbl, id as item_id, case when list_max(list_transform({STRETCHES}, lambda x: length(x))) > 2000 then 'unbroken' else 'splittable' end as kind
from (select 'policies' tbl, id, content as text from policies union all select 'attachments', id, parsed_text from attachments) where length(text) > 2000""",
        "p3_found": f"""with d as (select id, regexp_replace(coalesce(title, '') || content, '{BLANK}', '', 'g') s from policies where length(regexp_replace(content, '{BLANK}', '', 'g')) >= 80),
g as (select distinct id, substring(s, cast(i as int), 5) t from (select id, s, unnest(range(1, length(s) - 3)) i from d)), n as (select id, count(*) c from g group by 1),
o as (select a.id x, b.id y, count(*) k from g a join g b on a.t = b.t and a.id < b.id group by 1, 2)
select x as id_a, y as id_b from o join n p on p.id = x join n q on q.id = y where 5 * k >= 3 * (p.c + q.c - k)""",
    }
