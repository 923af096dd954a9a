"""Template residue and error pages: positive-unlabelled naive Bayes by expectation-maximisation.

Records that plainly are errors, notices or filler, and plain placeholders, are trusted positives; everything else is
unlabelled. Naive Bayes is fitted by EM in which the positives stay fixed and every unlabelled passage or span has a
posterior. One model, over character bigrams, tells error and filler passages from policy text; a second one, over what
encloses a span, what it consists of and what stands beside it, tells placeholders from other bracketed or marked spans.
The notations of placeholders only choose what is trusted; any span is scored. Passages are scored up to the first one of
substance, which settles the record; a record is residue if it has none and most of it reads like an error, or if it holds
an unfilled placeholder or a hint to the writer.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweir.llm.sampling import sample_kinds

SLOTS = 1 << 17
#: Bounds of the fitting sample, in records, each taken by the hash of the key from the whole table.
TRUSTED, SHORT, OTHER = 4000, 3000, 1500
ROUNDS = 8
#: Least sum of log odds of a placeholder.
SPAN = 2.0

# Texts that are trusted to be errors, notices about scripts, or filler.
ERRORS = (
    r"404|50[0234] |403 |not found on this server|Access Denied|Whitelabel Error|Bad Gateway|Internal Server Error|Service Unavailable|Forbidden|Exception|errno|ORA-\d|页面不存在|已被删除|已过期下线|系统繁忙|登录已超时|数据库连接"
    r"|启用 ?JavaScript|enable J|turn on scripts|不支持 ?JS|浏览器支持脚本|脚本被关闭|浏览器版本过低|校验浏览器|安全验证|访问过于频繁|请求已被|敬请期待|待发布|正在整理|暂无内容|示例文本|[Ll]orem ipsum|(?:文字){3}|(?:正文){3}|(?:内容){3}|(?:test ?){3}|(?:asdf){2}"
)
# Notations of unfilled placeholders and hints to the writer that are trusted in fitting.
PLACEHOLDER = (
    r"\{\{[^{}\n]{1,40}\}\}|\$\{[^{}\n]{1,40}\}|\[\[[^\[\]\n]{1,40}\]\]|<%=?[^%\n]{1,40}%>|@@[^@\n]{1,40}@@|%\{[^{}\n]{1,40}\}|\{%[^%\n]{1,40}%\}|\{\$[^$\n]{1,40}\$\}|__[A-Za-z一-鿿][A-Za-z_.一-鿿]{0,38}__|#[A-Za-z_][A-Za-z_.]{1,30}#|#[一-鿿]{2,8}#"
    r"|20[Xx×]{2}年|[Xx×]{1,2}月[Xx×]{1,2}日|[Xx×]{3}(?=局|部|厅|省|市|县|单位|公司)"
    r"|[（(【\[<〔《](?=[^）)】\]>〕》\n]{0,30}(?:此处|待补充|待填|待定|插入|请输入|请在|请填|粘贴|发布前|请删除|请替换|示例文字|TODO|TBD))[^）)】\]>〕》\n]{2,36}[）)】\]>〕》]"
)
# Bracketed spans that are trusted to be no placeholders, so that a corpus with few of them has some.
ORDINARY = "（第一批） （试行） （暂行） （征求意见稿） （市、区） （含税） （以下简称） （BIM） （REITs） （Software） 《管理办法》 《实施细则》 【相关阅读】 [大] [中] [附件]"
_ERRORS, _PLACEHOLDER = re.compile(ERRORS), re.compile(PLACEHOLDER)
#: Spans that may be placeholders: enclosed by signs or brackets, or of crosses.
_SPAN = re.compile(
    r"(?P<open>[{<\[$%@#«‹_]{1,3}=?) ?(?P<inner>[A-Za-z一-鿿][A-Za-z0-9_.一-鿿 ：:，,]{0,38}?) ?(?P<close>[}>\]$%@#»›_]{1,3})"
    r"|(?P<cross>20[Xx×]{2}(?=年)|[Xx×]{1,3}(?=[月日局部厅省市县单公]))|(?P<left>[（(【〔《])(?P<note>[^\n（(【〔《）)】〕》{}$%@#<>_\[\]]{2,36})(?P<right>[）)】〕》])"
)
_MIRROR = str.maketrans("{<[«‹（(【〔《", "}>]»›）)】〕》")


def _slot(s: str) -> int:
    return zlib.crc32(s.encode()) % SLOTS


def _kind(c: str) -> str:
    return "字" if "一" <= c <= "鿿" else "a" if c.isalpha() else "9" if c.isdigit() else "|" if c in "\n" else c


@lru_cache(maxsize=1 << 16)
def _about(opening: str, inner: str, closing: str, before: str, after: str) -> np.ndarray:
    """Slots of what a span is like: its signs, how they pair, what is inside and beside it."""
    latin, han = any(c.isascii() and c.isalpha() for c in inner), sum("一" <= c <= "鿿" for c in inner)
    made = "mixed" if latin and han else "han" if han else "words" if " " in inner.strip() else "name" if latin and any(c in "._" for c in inner) or latin and inner[:1].islower() else "word" if latin else "other"
    signs = "cjk" if opening[:1] in "（【〔《" else "ascii" if opening.isascii() and opening else "cross" if not opening else "rare"
    pair = "pair" if opening.replace("=", "")[::-1].translate(_MIRROR) == closing else "run" if opening == closing else "other"
    out = [f"({opening}", f"){closing}", f"{signs} {pair} {made}", f"{signs} {len(opening)}", f"{made} {min(han, 9)}", f"beside {_kind(before)} {made}", f"{signs} beside {_kind(after)}", f"digits {any(c.isdigit() for c in inner)} {signs}"]
    if not opening:
        out += [f"cross {len(inner)} {inner[:1]}", f"cross {after}", f"cross {after} {_kind(before)}"]
    out += [f"has {inner[k:k + 2]}" for k in range(len(inner) - 1) if "一" <= inner[k] <= "鿿"]
    return np.array([_slot(x) for x in out], dtype=np.int64)


def spans(text: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, slots) of the spans of a text that may be placeholders."""
    for m in _SPAN.finditer(text):
        a, b = m.span()
        before, after = text[a - 1 : a] or "\n", text[b : b + 1] or "\n"
        if m["open"]:
            yield a, b, _about(m["open"], m["inner"], m["close"], before, after)
        elif m["cross"]:
            yield a, b, _about("", m["cross"], "", before, after)
        else:
            yield a, b, _about(m["left"], m["note"], m["right"], before, after)


def fold(text: str) -> np.ndarray:
    """Code points with digits as one and line breaks kept; letters in lower case."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    c[(c >= 48) & (c <= 57)] = 48
    return c


def slots(c: np.ndarray) -> np.ndarray:
    """Slot of the bigram at each position; one less than the characters."""
    if len(c) < 2:
        return np.zeros(0, dtype=np.int64)
    return ((c[:-1].astype(np.uint64) * np.uint64(40503) + c[1:]) * np.uint64(0x9E3779B1) >> np.uint64(7)).astype(np.int64) % SLOTS


def passages(text: str) -> list[str]:
    return [p for p in (x.strip() for x in text.split("\n")) if p]


@dataclass
class Model:
    """Log odds of each bigram, error or filler against policy, and of each trait of a span, placeholder against other spans."""

    error: np.ndarray
    placeholder: np.ndarray


def fit_odds(positive: list[np.ndarray], unlabelled: list[np.ndarray], rounds: int = ROUNDS, negative: list[np.ndarray] = [], start: float = 0.01) -> np.ndarray:  # noqa: B006
    """EM of a two-class naive Bayes in which `positive` and `negative` stay what they are; log odds of each slot, clipped."""
    def joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate(docs) if docs else np.zeros(0, np.int64)), np.array([len(d) for d in docs], dtype=np.int64)

    def counts(at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(at, weights=weights, minlength=SLOTS).astype(np.float64)

    fixed, against = counts(joined(positive)[0]), counts(joined(negative)[0])
    at, sizes = joined(unlabelled)
    post = np.full(len(unlabelled), start)
    edges, every = np.cumsum([0, *sizes])[:-1], counts(at)
    a = 0.05
    for _ in range(rounds):
        mine = counts(at, np.repeat(post, sizes)) if len(at) else 0.0
        yes, no = fixed + mine, against + every - mine
        odds = np.log((yes + a) / (yes.sum() + a * SLOTS)) - np.log((no + a) / (no.sum() + a * SLOTS))
        odds = np.clip(odds, -4, 4)
        if not len(unlabelled):
            break
        prior = np.log(max(post.mean(), 1e-4) / max(1 - post.mean(), 1e-4))
        total = np.add.reduceat(odds[at], edges) * np.minimum(1, 12 / np.maximum(1, sizes)) + prior
        post = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    return odds.astype(np.float32)


def learn(trusted: list[tuple[str | None, str | None]], others: list[tuple[str | None, str | None]]) -> Model:
    """A model from trusted and unlabelled records (title, content)."""
    errors = [slots(fold(p)) for _, c in trusted if c and len(c) < 400 and _ERRORS.search(c) for p in passages(c)]
    plain = [slots(fold(p)) for t, c in others for p in passages(c or "")]
    errors, plain = ([d for d in x if len(d)] for x in (errors, plain))
    sure, open_ = [], []
    for x in (x for record in (*trusted, *others) for x in record if x):
        seeds = [m.span() for m in _PLACEHOLDER.finditer(x)]
        for a, b, traits in spans(x):
            (sure if any(a < d and c < b for c, d in seeds) else open_).append(traits)
    never = [traits for *_, traits in spans(ORDINARY)]
    return Model(fit_odds(errors, plain), fit_odds(sure, open_, negative=never))


def _repetitive(p: str) -> bool:
    return len(p) >= 8 and len(set(p)) <= 12 and len(set(p)) < 0.3 * len(p)


def verdict(title: str | None, content: str | None, model: Model) -> tuple[bool, float, bool]:
    """(residue, strongest placeholder span, whether the content has a passage of substance).

    A passage of substance reads like policy text and is a sentence or of some length. Content without any is an error,
    a notice or filler if most of its characters are in passages that read so.
    """
    span = max((float(model.placeholder[traits].sum()) for x in (title, content) if x for *_, traits in spans(x)), default=0.0)
    holds = span >= SPAN
    if not content or not content.strip():
        return holds, span, False
    at = slots(fold(content))
    # Each line's score is the mean over the bigrams that start in it.
    lines = content.split("\n")
    begins = np.cumsum([0, *(len(x) + 1 for x in lines)])
    total = np.concatenate([[0.0], np.cumsum(model.error[at], dtype=np.float64)])
    ends = np.minimum(begins[1:] - 2, len(at))
    sums = total[np.maximum(ends, 0)] - total[np.minimum(begins[:-1], len(at))]
    bad = good = 0
    for line, score in zip(lines, sums.tolist()):
        p = line.strip()
        if not p:
            continue
        if score > 0 or _repetitive(p):
            bad += len(p)
        else:
            good += len(p)
            if len(p) >= 12 and p[-1] in "。;；！：:.!" or len(p) >= 40:
                return holds, span, True
    return holds or bad > good, span, False


def fit(df: DataFrame, key: str = "id", title: str = "title", content: str = "content") -> Model:
    """Learn from a bounded sample of trusted and unlabelled records."""
    rows = df.select(F.xxhash64(F.col(f"`{key}`")).alias("h"), F.col(f"`{key}`").alias("key"), F.col(f"`{title}`").alias("t"), F.col(f"`{content}`").alias("c"))
    # Java's notation of the same patterns; a record is trusted by its own text alone.
    sure = (F.coalesce(F.length("c"), F.lit(0)) < 400) & F.coalesce(F.col("c").rlike(ERRORS), F.lit(False)) | F.coalesce(F.col("t").rlike(PLACEHOLDER), F.lit(False)) | F.coalesce(F.col("c").rlike(PLACEHOLDER), F.lit(False))
    kind = F.when(sure, 0).when(F.length("c") < 300, 1).otherwise(2)

    got = sample_kinds(rows, kind, F.col("h"), {0: TRUSTED, 1: SHORT, 2: OTHER}, ["t", "c"])
    pairs = {k: [(r["t"], r["c"]) for r in x] for k, x in got.items()}
    return learn(pairs[0], pairs[1] + pairs[2])


def judged(df: DataFrame, key: str = "id", title: str = "title", content: str = "content", model: Model | None = None) -> DataFrame:
    """(key, residue, span_score, substance) of every record; empty and null texts are no residue. One pass."""
    shared = df.sparkSession.sparkContext.broadcast(model or fit(df, key, title, content))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *verdict(t, c, shared.value)) for k, t, c in zip(b["key"], b["t"], b["c"])]
            yield pd.DataFrame(out, columns=["key", "residue", "span_score", "substance"])

    own = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{title}`").alias("t"), F.col(f"`{content}`").alias("c"))
    return own.mapInPandas(run, "key long, residue boolean, span_score double, substance boolean").withColumnRenamed("key", key)
