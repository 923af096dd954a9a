"""Scalar text functions as native columns; a pandas UDF only where Spark has no builtin (NFKC)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Java's \s is ASCII only; (?U) adds Unicode white space, and the separators 1C-1F are named.
BLANK = r"(?U)[\s\x1c-\x1f]"
NUMBER = r"[A-Za-z一-鿿]{2,24}[〔\[【（(]\s*\d{4}\s*[〕\]】）)]\s*\d{1,6}\s*号"
DATE = r"((?:19|20)\d{2})\s*[-/年.]\s*(\d{1,2})\s*[-/月.]\s*(\d{1,2})"
SIGNED = r"(?m)^[\s　]*((?:19|20)\d{2}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日)[\s　]*$"
ISSUER = r"(人民政府|委员会|部|局|厅|办公室|发展改革委)$"


def for_match(c: Column) -> Column:
    """Lower case without ASCII spaces and line feeds; tabs and wide blanks stay. Null counts as empty."""
    return F.lower(F.translate(F.coalesce(c, F.lit("")), " \n", ""))


def without_blanks(c: Column) -> Column:
    """All Unicode white space removed."""
    return F.regexp_replace(c, BLANK, "")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition; null for null."""
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))


def title_key(c: Column) -> Column:
    """Title for comparison: NFKC, without title marks, quotes and white space, lower case. Null counts as empty."""
    return F.lower(F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), rf'[《》"“”]|{BLANK}', ""))


def number_key(c: Column) -> Column:
    """Issuing number for comparison: NFKC, without white space, one style of brackets around the year."""
    return F.translate(without_blanks(nfkc(F.coalesce(c, F.lit("")))), "[【(]】)", "〔〔〔〕〕〕")


def iso_date(c: Column) -> Column:
    """First date in a text as YYYY-MM-DD; '' where there is none or it isn't a day of the calendar."""
    part = [F.regexp_extract(c, DATE, i) for i in (1, 2, 3)]
    day = F.try_to_date(F.concat_ws("-", *part), "yyyy-M-d")
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def issuing_number(content: Column, title: Column) -> Column:
    """A line of its own among the first 30 that is an issuing number, else the first one in the title, else ''."""
    lines = F.transform(F.slice(F.split(F.coalesce(content, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x85\x{2028}\x{2029}]"), 1, 30), lambda x: F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", ""))
    own = F.get(F.filter(lines, lambda x: x.rlike(f"^(?:{NUMBER})$")), F.lit(0))
    return without_blanks(F.coalesce(own, F.regexp_extract(F.coalesce(title, F.lit("")), f"({NUMBER})", 1)))


def signature_date(content: Column) -> Column:
    """The last date that has a line of its own, as YYYY-MM-DD, else ''."""
    return F.coalesce(iso_date(F.try_element_at(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(SIGNED), F.lit(1)), F.lit(-1))), F.lit(""))


def signers(content: Column, before: int = 5, longest: int = 45) -> Column:
    """The run of issuer lines right above the last signature date, joined by '、'; '' without one."""
    text = F.coalesce(content, F.lit(""))
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(SIGNED), F.lit(1)), F.lit(-1))
    head = F.get(F.split(text, F.concat(F.lit(r"(?m)^[\s　]*\Q"), last, F.lit(r"\E[\s　]*$(?![\s\S]*^[\s　]*\Q"), last, F.lit(r"\E[\s　]*$)"))), F.lit(0))
    lines = F.filter(F.transform(F.split(head, "\n"), lambda x: F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", "")), lambda x: x != "")
    nearest = F.slice(F.reverse(lines), 1, before)
    stop = F.array_position(F.transform(nearest, lambda x: (F.length(x) <= longest) & x.rlike(ISSUER)), False)
    run = F.when(stop > 0, F.slice(nearest, F.lit(1), (stop - 1).cast("int"))).otherwise(nearest)
    return F.when(last.isNotNull(), F.array_join(F.reverse(run), "、")).otherwise(F.lit(""))


def tidy(c: Column) -> Column:
    """Wide blanks as spaces, three or more line feeds as two, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "　", " "), r"\n{3,}", "\n\n"), rf"^{BLANK}+|{BLANK}+$", "")


def chunks(c: Column, size: int) -> Column:
    """array<string>: consecutive slices of `size` characters; a null or empty text is one empty slice."""
    text = F.coalesce(c, F.lit(""))
    last = F.greatest(F.lit(0), F.ceil(F.length(text) / size) - 1).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: text.substr(i * size + 1, F.lit(size)))


def guarded(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula is prefixed with an apostrophe."""
    return F.when(F.regexp_replace(c, rf"^{BLANK}+", "").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def analysis_text(content: Column, attachments: Column) -> Column:
    """Body block, then a block for each attachment (name, parsed_text) that has text."""
    full = F.filter(attachments, lambda a: F.length(a["parsed_text"]) > 0)
    blocks = F.transform(full, lambda a: F.concat(F.lit("[附件："), F.coalesce(a["name"], F.lit("")), F.lit("]\n"), a["parsed_text"]))
    return F.array_join(F.concat(F.array(F.concat(F.lit("[正文]\n"), F.coalesce(content, F.lit("")))), F.coalesce(blocks, F.array().cast("array<string>"))), "\n\n")


def fingerprint(content: Column, attachments: Column | None = None) -> Column:
    """SHA-256 of the content without white space and the sorted distinct marks of the attachments (sha256, else the URL)."""
    parts = [without_blanks(F.coalesce(content, F.lit("")))]
    if attachments is not None:
        marks = F.transform(attachments, lambda a: F.coalesce(F.nullif(a["sha256"], F.lit("")), F.concat(F.lit("missing:"), a["url"])))
        parts.append(F.coalesce(F.array_join(F.array_sort(F.array_distinct(marks)), "\x1f"), F.lit("")))
    return F.sha2(F.concat_ws("\x1e", *parts), 256)


def located(evidence: Column, source: Column) -> Column:
    """Whether a non-blank evidence occurs in the source, both in the form for matching."""
    return F.coalesce((F.trim(evidence) != "") & F.contains(for_match(source), for_match(evidence)), F.lit(False))


def confidence(c: Column) -> Column:
    """A number from 0 to 1, else null."""
    x = F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
    return F.when(x.between(0, 1), x)


def label_names(codes: Column, names: dict[str, str]) -> Column:
    """Comma list of codes as a list of names; unknown codes stay, empty ones fall away."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    return F.transform(F.filter(F.split(F.coalesce(codes, F.lit("")), ","), lambda x: x != ""), lambda x: F.coalesce(F.try_element_at(table, x), x))


def holds(c: Column, keyword: str) -> Column:
    """Keyword search without wildcards; ASCII letters in either case are equal, other letters are not folded."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.contains(F.translate(c, upper, lower), F.lit(keyword.translate(str.maketrans(upper, lower)))), F.lit(False))
