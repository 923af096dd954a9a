"""Visually identical text with different characters: confusables skeletons.

`skeleton` decomposes a text, replaces every character by the prototype of its look-alike class and decomposes
again. Two texts read the same when their skeletons are equal. The skeleton is a key for comparisons; `form` is
the readable consistent spelling of the same text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike characters, each line a prototype followed by the characters that read like it
# (from the public Unicode lists of confusables and of equivalent unified ideographs).
LOOK_ALIKES = """
A ΑАᎪꓮ
B ΒВᏴꓐ
C СϹᏟꓚ
D Ꭰꓓ
E ΕЕᎬꓰ
F Ϝꓝ
G ԌᏀꓖ
H ΗНᎻꓧ
I ΙІӀ
J ЈᎫꓙ
K ΚКᏦꓗ
L Ꮮꓡ
M ΜМᎷꓟ
N Νꓠ
O ΟОՕꓳ
P ΡРᏢꓑ
Q Ԛ
R Ꭱꓣ
S ЅՏᏚꓢ
T ΤТᎢꓔ
U Սꓴ
V ѴᏙꓦ
W ԜᎳꓪ
X ΧХꓫ
Y ΥҮꓬ
Z ΖᏃꓜ
a аαɑ
c сϲ
d ԁ
e е
g ɡ
h һ
i іıι
j јϳ
l ӏ
o оοօ
p рρ
q ԛ
s ѕ
u υս
v νѵ
w ԝ
x хχ
y уγү
- ‐‑‒–−⁃˗➖
· ‧・•∙⋅᛫･
〇 ○◯⚪
工 エ
二 ニ
力 カ
八 ハ
口 ロ囗
夕 タ
卜 ト
才 オ
丿 ノ
一 ー
" “”„‟〝〞
' ‘’‚‛′
~ ～〜∼
"""

# Radical forms without a decomposition, each followed by the ideograph of the same shape.
RADICALS = (
    "⺁厂⺄乙⺅亻⺈刀⺊卜⺌小⺍小⺎兀⺒巳⺓幺⺗㣺⺘扌⺙攵⺜日⺝月⺞歺⺠民⺡氵⺢氺⺣灬⺤爫⺥爫⺦丬⺧牛⺨犭⺩王⺫目⺬示⺭礻⺮竹⺯糹⺰纟⺱罓⺲罒"
    "⺶羊⺷羊⺸羋⺹耂⺺肀⺻聿⺼肉⺾艹⺿艹⻀艹⻁虎⻂衤⻃覀⻄西⻅见⻆角⻈讠⻉贝⻋车⻌辶⻍辶⻎辶⻐钅⻑長⻒镸⻓长⻔门⻖阝⻗雨⻘青⻙韦⻚页"
    "⻛风⻜飞⻝食⻟飠⻠饣⻢马⻣骨⻤鬼⻥鱼⻦鸟⻧卤⻨麦⻩黄⻪黾⻫斉⻬齐⻭歯⻮齿⻯竜⻰龙⻱龜⻲亀"
)

OPENING, CLOSING = "([{<〔【〈《「『〖〘︵︹︻", ")]}>〕】〉》」』〗〙︶︺︼"
# Ranges that are drawn as nothing although they aren't format characters.
INVISIBLE = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
# Blocks that hold decompositions, blanks or format characters; the large ideograph and syllable blocks hold none.
SCANNED = ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))
# Compatibility forms that read like their decomposition; circles, fractions, super- and subscripts don't.
SAME_READING = ("<wide>", "<narrow>", "<small>", "<font>", "<compat>", "<noBreak>", "<vertical>")


@lru_cache(maxsize=1)
def table() -> dict[int, str]:
    """Code point -> its prototype, fully decomposed; made by rule from the Unicode data plus the lists above."""
    to: dict[int, str] = {}
    for line in LOOK_ALIKES.split("\n"):
        if line:
            for c in line[2:]:
                to[ord(c)] = line[0]
    to |= {ord(a): b for a, b in zip(RADICALS[::2], RADICALS[1::2])}

    def expand(c: str, depth: int = 0) -> str:
        if ord(c) in to:
            return to[ord(c)]
        kind, _, rest = unicodedata.decomposition(c).rpartition("> ")
        parts = rest or unicodedata.decomposition(c)
        if parts and depth < 8 and (not kind or kind + ">" in SAME_READING):
            return "".join(expand(chr(int(x, 16)), depth + 1) for x in parts.split())
        return c

    out = dict(to)
    for cp in (cp for block in SCANNED for cp in range(*block)):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if kind == "Cf" or any(a <= cp <= b for a, b in INVISIBLE):
            out[cp] = ""
        elif kind == "Zs":
            out[cp] = " "
        elif (x := expand(c)) != c:
            out[cp] = x
    out |= {cp: "" for cp in range(0x20)} | {cp: " " for cp in (9, 10, 11, 12, 13, 0x85, 0x2028, 0x2029)} | {0x7F: ""}
    return out


def _marks(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFD", s)


@lru_cache(maxsize=1)
def _scripts() -> list[tuple[re.Pattern, re.Pattern, dict[int, str]]]:
    """For each script that lends look-alikes: runs of its letters and their prototypes, its unmistakable letters, and
    prototype -> its letter. Made from the list above."""
    out = []
    for low, high, others, marks in ((0x30A1, 0x30FE, "ヵヶ・", "\u3099\u309a"), (0x400, 0x52F, "", "\u0300-\u036f"), (0x370, 0x3FF, "", "\u0300-\u036f")):
        back = {}
        for line in LOOK_ALIKES.split("\n"):
            own = [c for c in line[2:] if low <= ord(c) <= high and c not in others]
            if own:
                back[ord(line[0])] = own[0]
        taken = {ord(c) for line in LOOK_ALIKES.split("\n") for c in line[2:]}
        sure = "".join(chr(c) for c in range(low, high + 1) if c not in taken and chr(c) not in others and unicodedata.category(chr(c))[0] == "L")
        plain = "" if low == 0x30A1 else "A-Za-z"
        out.append((re.compile(f"[{sure}{marks}{''.join(map(chr, back))}{plain}]+"), re.compile(f"[{sure}{marks if not plain else ''}]"), back))
    return out


def form_of(text: str) -> str:
    """The consistent readable spelling: made from the skeleton alone, so texts that read the same have the same form.

    In a run that holds an unmistakable letter of Katakana, Cyrillic or Greek, and no Latin letter that these lack, the
    prototypes become letters of that script again; elsewhere they stay. Composed, without invisible characters and outer blanks.
    """
    t = table()
    s = _marks(_marks(text).translate(t)).translate(t)
    if not s.isascii():
        for run, sure, back in _scripts():
            s = run.sub(lambda m: m.group().translate(back) if sure.search(m.group()) and not any(c.isascii() and ord(c) not in back for c in m.group()) else m.group(), s)
    return unicodedata.normalize("NFC", s).strip()


_BRACKETS = str.maketrans(OPENING + CLOSING, "〔" * len(OPENING) + "〕" * len(CLOSING))


# Look-alikes within ASCII of the public list. They make other digits and letters of texts, so they are an option.
_ASCII = str.maketrans({"0": "O", "1": "l", "I": "l", "|": "l", "m": "rn"})


def skeleton_of(text: str, number: bool = False, loose: bool = False) -> str:
    """`text` decomposed, mapped to prototypes and decomposed again; `number`: bracket style and white space fall away;
    `loose`: 0 and O, 1, l, I and |, rn and m read the same too."""
    t = table()
    s = _marks(_marks(text).translate(t)).translate(t)
    if loose:
        s = s.translate(_ASCII)
    if number:
        return "".join(s.translate(_BRACKETS).split())
    return s.strip()


def skeleton(col: Column, number: bool = False) -> Column:
    """Skeleton of a string column; null for null. Arrow batches, one pass over each value."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else skeleton_of(x, number))

    return run(col)


def form(col: Column) -> Column:
    """Consistent readable spelling of a string column; null for null."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else form_of(x))

    return run(col)


def values_of(df: DataFrame, id_col: str, fields: dict[str, bool]) -> DataFrame:
    """(field, id, value) of the non-empty values; each row is read once for all fields.

    `fields`: column -> whether it holds issuing numbers.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in fields])
    return df.select(F.col(f"`{id_col}`").alias("id"), F.explode(cells).alias("c")).select("c.field", "id", "c.value").where(F.col("value").isNotNull() & (F.col("value") != ""))


def spellings(values: DataFrame, fields: dict[str, bool]) -> DataFrame:
    """(field, value, skeleton): one row for each stored spelling. Repeated values are collapsed before Python sees them."""
    numbers = [f for f, n in fields.items() if n]
    one = values.groupBy("field", "value").agg(F.lit(1).alias("one"))
    key = F.when(F.col("field").isin(numbers), skeleton(F.col("value"), True)).otherwise(skeleton(F.col("value"))) if numbers else skeleton(F.col("value"))
    return one.select("field", "value", key.alias("skeleton")).where(F.col("skeleton") != "")


def consistent_forms(df: DataFrame, id_col: str, fields: dict[str, bool]) -> DataFrame:
    """(field, id, value, form, class_key): every non-empty value with its consistent form and the key of its class.

    Null and empty values have no row; values of invisible characters only have an empty form and key. Row-local:
    no shuffle, so equal keys group equal-looking values anywhere in the corpus.
    """
    numbers = [f for f, n in fields.items() if n]

    @F.pandas_udf("form string, class_key string")
    def both(field: pd.Series, value: pd.Series) -> pd.DataFrame:
        seen: dict[tuple[str, str], tuple[str, str]] = {}
        out = []
        for f, v in zip(field, value):
            if (got := seen.get((f, v))) is None:
                n = f in numbers
                made = form_of(v)
                got = seen[f, v] = ("".join(made.translate(_BRACKETS).split()) if n else made, skeleton_of(v, n))
            out.append(got)
        return pd.DataFrame(out, columns=["form", "class_key"])

    return values_of(df, id_col, fields).withColumn("x", both("field", "value")).select("field", "id", "value", "x.form", "x.class_key")


def same_reading_pairs(df: DataFrame, id_col: str, fields: dict[str, bool]) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b: values stored as different strings that read the same.

    Spellings are paired, not rows: a value that a third of the rows share is one spelling, and rows enter only for
    spellings that have a partner. Empty and null values take no part; a repeated row gives its pairs once.
    """
    values = values_of(df, id_col, fields)
    s = spellings(values, fields)
    o = s.select("field", "skeleton", F.col("value").alias("other"))
    pairs = s.join(o, ["field", "skeleton"]).where(F.col("value") < F.col("other")).select("field", "value", "other")
    rows = values.distinct()
    a = pairs.join(rows.withColumnRenamed("id", "a"), ["field", "value"])
    b = a.join(rows.select("field", F.col("value").alias("other"), F.col("id").alias("b")), ["field", "other"])
    return b.where(F.col("a") != F.col("b")).select("field", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
