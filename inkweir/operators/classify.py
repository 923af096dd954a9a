"""Lexicon labelling of documents and the handling of an external model's replies, as native columns.

Lexicons are parameters. Words are matched as substrings of the text in the form for matching; a word counts once,
however often it occurs, and overlapping words all count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkweir.functions.text import chunks, confidence, for_match, located


def _form(word: str) -> str:
    return word.lower().replace(" ", "").replace("\n", "")


@dataclass(frozen=True)
class Lexicon:
    """relevance: words of relevant texts. exclude: title words that exclude. categories: code -> (name, words), in
    order of preference on equal counts. types: (type, title words), first match wins. strong / weak: types that make a
    text relevant, or pending, by themselves. boundary: (word, note) that call for a review.
    """

    relevance: tuple[str, ...]
    exclude: tuple[str, ...]
    categories: tuple[tuple[str, str, tuple[str, ...]], ...]
    types: tuple[tuple[str, tuple[str, ...]], ...]
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    boundary: tuple[tuple[str, str], ...] = ()
    other: str = "其他"
    head: int = 400


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """array<string>: the words that a text in the form for matching holds, in their order."""
    forms = [_form(w) for w in words]
    return F.filter(F.array(*[F.lit(w) for w in forms]), lambda w: F.contains(text, w)) if forms else F.array().cast("array<string>")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(_form(w)))
    return F.coalesce(out, F.lit(False))


def document_type(title: Column, lexicon: Lexicon) -> Column:
    """First type one of whose words the title holds."""
    t, out = for_match(title), F.lit(lexicon.other)
    for name, words in reversed(lexicon.types):
        out = F.when(any_of(t, words), name).otherwise(out)
    return out


def labelled(df: DataFrame, title: str, text: str, lexicon: Lexicon) -> DataFrame:
    """`df` with relevance, doc_type, category, category_names, reason, hint, n_hits. One scan, no shuffle, no Python."""
    t = for_match(F.col(title))
    body = F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    d = df.withColumn("_text", for_match(body)).withColumn("_head", for_match(F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.substring(F.coalesce(F.col(text), F.lit("")), 1, lexicon.head))))
    d = d.withColumn("n_hits", F.size(hits(F.col("_text"), lexicon.relevance)))
    scored = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"), F.lit(i).alias("pos"), hits(F.col("_text"), words).alias("found")) for i, (code, name, words) in enumerate(lexicon.categories)])
    ranked = F.array_sort(F.transform(F.filter(scored, lambda s: F.size(s["found"]) > 0), lambda s: F.struct((-F.size(s["found"])).alias("n"), s["pos"].alias("pos"), s["code"].alias("code"), s["name"].alias("name"), s["found"].alias("found"))))
    d = d.withColumn("_ranked", ranked).withColumn("doc_type", document_type(F.col(title), lexicon))
    excluded = any_of(t, lexicon.exclude)
    relevance = F.when(excluded, "no").when((F.col("n_hits") >= 2) | F.col("doc_type").isin(*lexicon.strong), "yes").when((F.col("n_hits") == 1) | F.col("doc_type").isin(*lexicon.weak), "pending").otherwise("no")
    in_order = F.array_sort(F.col("_ranked"), lambda a, b: a["pos"] - b["pos"])
    evidence = F.array_join(F.transform(in_order, lambda s: F.concat(s["name"], F.lit(":"), F.array_join(F.slice(s["found"], 1, 3), "、"))), "；")
    hint = F.lit("")
    first, second = F.get(F.col("_ranked"), F.lit(0))["n"], F.get(F.col("_ranked"), F.lit(1))["n"]
    hint = F.when(F.size("_ranked") >= 3, "many").when((F.size("_ranked") == 2) & (first == second), "tie").otherwise(hint)
    for word, note in reversed(lexicon.boundary):
        hint = F.when(F.contains(F.col("_head"), F.lit(_form(word))), f"boundary:{word}；{note}").otherwise(hint)
    none = F.array().cast("array<string>")
    codes = F.when(excluded, none).otherwise(F.transform("_ranked", lambda s: s["code"]))
    names = F.when(excluded, none).otherwise(F.transform("_ranked", lambda s: s["name"]))
    d = d.withColumn("relevance", relevance).withColumn("category", F.array_join(codes, ",")).withColumn("category_names", F.array_join(names, ","))
    d = d.withColumn("reason", F.when(excluded, "excluded").when(F.size("_ranked") > 0, evidence).otherwise("")).withColumn("hint", F.when(excluded, "").otherwise(hint))
    return d.withColumn("doc_type", F.when(excluded, lexicon.other).otherwise(F.col("doc_type"))).drop("_text", "_head", "_ranked")


REPLY = "is_investment_policy string, category array<string>, doc_type string, need_review string, evidence string, confidence string, category_reason string, reviewer_hint string"


def checked(reply: Column, source: Column, codes: tuple[str, ...], types: tuple[str, ...], other: str = "其他") -> Column:
    """Struct of a model's reply (JSON text) after validation against the source text.

    Unknown enums, labels or types, a review flag that isn't a boolean, evidence that the source doesn't hold, and a
    relevant text without labels are errors; any error makes the text pending and due for review. A confidence that is
    missing, invalid or below 0.8 calls for review.
    """
    r = F.from_json(reply, REPLY)
    none = F.array().cast("array<string>")
    inv_ok = r["is_investment_policy"].isin("yes", "no", "pending")
    cats_ok = r["category"].isNotNull() & F.forall(r["category"], lambda c: F.coalesce(c.isin(*codes), F.lit(False))) | ~F.coalesce(reply.rlike('"category"'), F.lit(False))
    cats_ok = F.coalesce(cats_ok, F.lit(False))
    cats = F.when(cats_ok, F.array_distinct(F.coalesce(r["category"], none))).otherwise(none)
    type_ok = F.coalesce(F.coalesce(r["doc_type"], F.lit(other)).isin(*types, other), F.lit(False))
    flag_ok = F.coalesce(reply.rlike(r'"need_review"\s*:\s*(true|false)\b'), F.lit(False))
    found = located(r["evidence"], source)
    bare = F.coalesce(r["is_investment_policy"] == "yes", F.lit(False)) & (F.size(cats) == 0)
    errors = F.filter(
        F.array(*[F.when(cond, F.lit(name)) for cond, name in ((~F.coalesce(inv_ok, F.lit(False)), "relevance"), (~cats_ok, "labels"), (~type_ok, "type"), (~flag_ok, "flag"), (~found, "evidence"), (bare, "unlabelled"))]), lambda e: e.isNotNull()
    )
    bad = F.size(errors) > 0
    number = F.when(reply.rlike(r'"confidence"\s*:\s*-?[0-9]'), confidence(r["confidence"]))
    relevance = F.when(bad, "pending").otherwise(r["is_investment_policy"])
    review = bad | F.coalesce(r["need_review"] == "true", F.lit(True)) | number.isNull() | (number < 0.8) | (relevance == "pending")
    return F.struct(
        relevance.alias("relevance"), cats.alias("labels"), F.when(type_ok, F.coalesce(r["doc_type"], F.lit(other))).otherwise(other).alias("doc_type"), review.alias("need_review"),
        F.when(found, r["evidence"]).otherwise("").alias("evidence"), number.alias("confidence"), F.substring(F.coalesce(r["category_reason"], F.lit("")), 1, 1000).alias("reason"), F.coalesce(r["reviewer_hint"], F.lit("")).alias("hint"), errors.alias("errors"),
    )


def in_chunks(df: DataFrame, keys: list[str], text: str, size: int = 10000, most: int = 24) -> DataFrame:
    """(keys, idx, n_chunks, truncated, chunk): the slices of each text that a model sees, `most` of them at most."""
    c = df.select(*keys, chunks(F.col(text), max(1, size)).alias("_c"))
    return c.select(*keys, F.size("_c").alias("n_chunks"), (F.size("_c") > most).alias("truncated"), F.posexplode(F.slice("_c", 1, most)).alias("idx", "chunk"))


def merged(parts: DataFrame, keys: list[str], other: str = "其他") -> DataFrame:
    """One row for each text from its slices' results (keys, idx, truncated, relevance, labels, doc_type, need_review, reason, evidence, hint).

    Relevant if any slice is, irrelevant if all are (and nothing was cut off), else pending. Labels, reasons, evidence and
    hints are distinct in order of the slices; the type is the first that says something.
    """
    ordered = F.array_sort(F.collect_list(F.struct("idx", "labels", "reason", "evidence", "hint", "doc_type")))
    g = parts.groupBy(*keys).agg(
        F.bool_or(F.col("relevance") == "yes").alias("_any"), F.bool_and(F.col("relevance") == "no").alias("_none"), F.bool_or("truncated").alias("truncated"), F.bool_or("need_review").alias("_review"), ordered.alias("_p"),
    )
    relevance = F.when(F.col("_any"), "yes").when(F.col("_none") & ~F.col("truncated"), "no").otherwise("pending")
    said = lambda f, joint: F.array_join(F.array_distinct(F.filter(F.transform("_p", lambda x: x[f]), lambda v: v != "")), joint)
    return g.select(
        *keys, relevance.alias("relevance"), F.array_join(F.array_distinct(F.flatten(F.transform("_p", lambda x: x["labels"]))), ",").alias("category"),
        F.coalesce(F.get(F.filter(F.transform("_p", lambda x: x["doc_type"]), lambda t: t != other), F.lit(0)), F.lit(other)).alias("doc_type"),
        (F.col("truncated") | F.col("_review") | (relevance == "pending")).alias("need_review"), said("reason", "；").alias("reason"), said("evidence", "\n").alias("evidence"), said("hint", "；").alias("hint"), "truncated",
    )


def by_model(parts: DataFrame, keys: list[str], client: Callable[[], Callable[[str], str | None]], header: str | None = None) -> DataFrame:
    """(keys, idx, truncated, source, reply): each slice answered by a client, made once for each task.

    client() gives a function from a prompt to a JSON text or None (failure). Only for slices; batches stream.
    """
    schema = parts.select(*keys, "idx", "truncated", F.concat(F.lit("") if header is None else F.col(header), F.col("chunk")).alias("source"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for b in batches:
            yield b.assign(reply=[ask(s) for s in b["source"]])

    return schema.mapInPandas(run, StructType([*schema.schema.fields, StructField("reply", StringType())]))


def with_fallback(model: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, relevance, category, doc_type, method): the model's result, else the rules'; rules alone never exclude."""
    m = model.select(*keys, F.col("relevance").alias("_r"), F.col("category").alias("_c"), F.col("doc_type").alias("_t"))
    j = rules.select(*keys, "relevance", "category", "doc_type").join(m, keys, "left")
    return j.select(
        *keys, F.coalesce("_r", F.when(F.col("relevance") == "no", "pending").otherwise(F.col("relevance"))).alias("relevance"), F.when(F.col("_r").isNotNull(), F.col("_c")).otherwise(F.col("category")).alias("category"),
        F.coalesce("_t", "doc_type").alias("doc_type"), F.when(F.col("_r").isNotNull(), "llm").otherwise("rule_fallback").alias("method"),
    )


def evaluated(labels: DataFrame, records: DataFrame) -> DataFrame:
    """One row of metrics of records (id, relevance, category, method) against labels (id, relevant, categories).

    Precision and recall of relevance, micro precision and recall of the labels of records predicted relevant, exact
    matches (a pending record never matches); null where the denominator is 0; rounded to 4 places.
    """
    none = F.array().cast("array<string>")
    j = labels.join(records.select("id", "relevance", F.filter(F.split(F.coalesce("category", F.lit("")), ","), lambda x: x != "").alias("_c"), "method"), "id", "left")
    yes = F.col("relevance") == "yes"
    pred, gold = F.when(yes, F.col("_c")).otherwise(none), F.col("categories")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    s = j.agg(
        F.count(F.lit(1)).alias("labeled_records"), n(yes & F.col("relevant")).alias("tp"), n(yes & ~F.col("relevant")).alias("fp"), n(~yes & F.col("relevant")).alias("fn"),
        F.sum(F.size(F.array_intersect(gold, pred))).alias("ct"), F.sum(F.size(F.array_except(pred, gold))).alias("cp"), F.sum(F.size(F.array_except(gold, pred))).alias("cn"),
        n((F.array_sort(F.array_distinct(pred)) == F.array_sort(F.array_distinct(gold))) & (yes == F.col("relevant")) & (F.col("relevance") != "pending")).alias("exact"), n(F.col("relevance") == "pending").alias("pending"), n(F.col("method") == "rule_fallback").alias("rule_fallback"),
    )
    rate = lambda a, b, name: F.round(F.try_divide(F.col(a).cast("double"), b), 4).alias(name)
    return s.select(
        "labeled_records", rate("tp", F.col("tp") + F.col("fp"), "relevance_precision"), rate("tp", F.col("tp") + F.col("fn"), "relevance_recall"), rate("ct", F.col("ct") + F.col("cp"), "category_micro_precision"),
        rate("ct", F.col("ct") + F.col("cn"), "category_micro_recall"), rate("exact", F.col("labeled_records"), "exact_match"), "pending", "rule_fallback",
    )


def label_errors(labels: DataFrame, records: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """(id, error) of labels that can't be used: repeated or unknown ids, unknown codes, labels on irrelevant texts."""
    known = records.select("id", F.lit(True).alias("known")).distinct()
    n = labels.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    j = labels.join(known, "id", "left").join(n, "id")
    error = F.when(F.col("n") > 1, "repeated id").when(F.col("known").isNull(), "unknown id").when(F.col("relevant").isNull(), "relevance missing").when(F.size(F.array_except("categories", F.array(*map(F.lit, codes)))) > 0, "unknown label").when(~F.col("relevant") & (F.size("categories") > 0), "labels on an irrelevant text")
    return j.select("id", error.alias("error")).where("error is not null").distinct()
