"""Personal information in free text: a skip-chain conditional random field over candidate mentions.

Nodes are candidate mentions (electronic mail, telephone and identity numbers, postal addresses, names) with a label
true or false. Neighbours in the text are joined by chain edges, repeated or similar mentions anywhere in a document by
skip edges; loopy message passing makes their labels consistent. Weights are learned by pseudo-likelihood from mentions
whose surroundings decide them, on a bounded sample of documents; the learned weights are applied to every document.
Which names are candidates doesn't depend on the sample: characters of given names are counted over all documents, and a
name after a decisive word is a candidate in its document whatever its characters.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweir.llm.sampling import sample as bounded

KINDS = ("email", "phone", "idnum", "address", "name")
#: Documents from which the weights are learned.
SAMPLE = 3000
FEATURES = 1 << 14
ROUNDS = 4
NEAR = 60

# Family names, simplified and traditional.
FAMILY = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
    "温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷盛曲翁冉骆蓝路游辛靳管柴蒙鲍华喻祁蒲房滕屈饶解牟艾尤阳时穆农司卓古吉缪简车项连芦麦褚娄窦戚岑"
    "景党宫费卜冷晏席卫米柏宗瞿桂全佟应臧闵苟邬边卞姬师和仇栾隋商刁沙荣巫寇桑郎甄丛仲虞敖巩明佘池查麻苑迟邝官封谈匡鞠惠荆乐冀郁胥南班储原栗燕楚鄢劳谌奚皮粟冼蔺楼盘满闻位厉伊仝区郜海阚花权强帅屠豆朴盖练廉禹井"
    "巴漆丰计伏危"
    "張劉陳楊黃趙吳孫馬鄭羅許韓馮鄧蕭蔣葉蘇魏呂盧鍾譚陸範賈韋鄒閆龍賀顧龔萬錢嚴湯溫龐顏莊聶魯歐關蘭寧紀淩畢單藍遊華饒陽農繆簡車項連蘆麥婁竇黨宮費衛應臧閔鄔邊師欒榮叢鞏邝談樂儲勞樓滿聞厲權強帥蓋練豐計駱鮑縈"
)
# Family names in Latin letters.
FAMILY_LATIN = frozenset(
    "Wang Li Zhang Liu Chen Yang Huang Zhao Wu Zhou Xu Sun Ma Zhu Hu Guo He Gao Lin Luo Zheng Liang Xie Song Tang Han Feng Deng Cao Peng Zeng Xiao Tian Dong Yuan Pan Yu Jiang Cai Du Ye Cheng Su Wei Lu Ding Ren Shen Yao Cui Zhong Tan "
    "Fan Jin Shi Liao Jia Xia Fu Fang Bai Zou Meng Xiong Qin Qiu Yin Xue Yan Duan Lei Hou Long Tao Mao Hao Gong Shao Wan Qian Dai Mo Kong Xiang Wen Kang Niu Ge Xing An Qi Yi Qiao Pang Ni Zhuang Nie Yue Zhai Zhan Ou Geng Guan Lan Zuo Gan "
    "Bao Ning Shang Shu Ruan Ke Ji Mei Tong Ling Bi Shan Pei Huo Miao Gu Sheng Qu Weng Ran Bian Bo Cen Chu Dou Jing Kui Lou Mu Qiong Rao Tu Xi Zang Zong Diao Dang Sha Rong Bu Leng Zhen Che Hua Hui Lian Luan Man Xin Ying You Zhuo Zi".split()
)
# Words before and after a mention that decide it.
CUES_BEFORE = r"(?:联系人|聯繫人|聯系人|联络人|收件人|法定代表人|代表|申请人|申請人|经办人|經辦人|姓名|负责同志|負責同志|审稿|審稿|校对|校對|据村民|據村民|核实|核實|咨询|諮詢|有事找|附)[:：，\t 　]{0,2}$"
CUES_LATIN = r"(?:Mr|Ms|Mrs|Dr|Contact|contact|Attn|Applicant|Representative|Officer|officer)[.:]? ?$"
NOT_NUMBER = r"(?:编号|編號|代码|代碼|预算总额|預算總額|热线|熱線|信用代码|文号|批次号|账号|帳號|订单号)[为為是:：\s]{0,2}$"

# Signs that are written wide or as other dashes and blanks; wide letters and digits only where there are any.
_SIGNS = (("（", "("), ("）", ")"), ("\u3000", " "), ("＋", "+"), ("－", "-"), ("．", "."), ("—", "-"), ("–", "-"), ("−", "-"), ("\xa0", " "), ("‑", "-"), ("＠", "@"))
_ALNUM_SEEN = re.compile("[０-９Ａ-Ｚａ-ｚ＿]")
_ALNUM = [(chr(c), chr(c - 0xFEE0)) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), 0xFF3F, *range(0xFF41, 0xFF5B))]
_AT = r"(?: ?@ ?| ?[(\[【<{] ?(?:at|a|AT) ?[)\]】>}] ?| (?:at|AT) (?=[a-z0-9-]+ ?(?:\.| dot )))"
_AT_SIGN = re.compile(r"@|[(\[【<{] ?(?:at|a|AT) ?[)\]】>}]| dot ")
_DOT = r"(?:\.| ?[(\[【<{] ?(?:dot|DOT) ?[)\]】>}] ?| dot )"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
PHONE = re.compile(
    r"(?<![0-9A-Za-z+.\-/])(?:(?:\+|00) ?86[- ]?|\( ?\+?86 ?\)[- ]?|86[- ](?=1))?(?:1[3-9]\d(?P<s>[- .]?)\d{4}(?P=s)\d{4}(?![0-9A-Za-z]|-\d)|(?:\(0\d{2,3}\)[- ]?|0\d{2,3}[- ]?)[2-9]\d{2,3}[- ]?\d{4}(?!\d))(?: ?(?:转|轉|分机|ext\.?|x|-) ?\d{1,5}(?![\d-]))?"
    r"|(?<![0-9A-Za-z+.\-/])(?:(?:\+|00) ?86[- ]?|\( ?\+?86 ?\)[- ]?)\(?0?\d{2,3}\)?[- ]?\d{7,8}(?!\d)|(?<![0-9A-Za-z+.\-/(])\(0\d{2,3}\)[- ]?\d{7,8}(?!\d)(?: ?(?:转|轉|分机|ext\.?|x) ?\d{1,5})?"
)
IDNUM = re.compile(r"(?<![0-9A-Za-z\-])\d{6}(?:[- ]?(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[- ]?\d{3}[\dXx]|[- ]?\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[- ]?\d{3})(?![0-9A-Za-z]|-\d)")
_RUN = re.compile(r"[+(]{0,2}\d[\d() +.\-]{6,}")
_P = "[一-鿿]"
_NUM = r"(?:\d+|[一二三四五六七八九十百零〇]+)(?:[-之]\d+)?"
_STREET = rf"(?:大道|大街|[路街巷弄道]|胡同)(?:[东西南北中東]段|[东西南北東])? ?{_NUM} ?[号號]"
_REGION = rf"(?:(?:{_P}{{2}}|黑龙江|黑龍江)省|(?:内蒙古|広西|广西|西藏|宁夏|新疆){_P}{{0,3}}自治[区區])"
_HOUSE = re.compile(rf"[道街路巷弄同东西南北中東段] ?{_NUM} ?[号號]")
_ROOM = rf"(?:附\d+[号號])?(?:{_P}{{2,4}}(?:小[区區]|花园|花園|公寓|大厦|大廈))?(?: ?[A-Za-z0-9一二三四五六七八九十]+ ?(?:[号號][楼樓]|[幢栋棟座层層楼樓]|单元|單元|室|房)){{0,4}}\d{{0,5}}[室房]?"
ADDRESS = re.compile(rf"(?:(?:{_REGION}(?:{_P}{{2}}[市州盟])?(?:{_P}{{2}}[县縣区區市旗])?|{_P}{{2}}市(?:{_P}{{2}}[县縣区區市旗])?|{_P}{{2}}[县縣区區旗]){_P}{{1,7}}?|{_P}{{2}}[东西南北中東]?){_STREET}{_ROOM}")
ADDRESS_LATIN = re.compile(r"(?<![0-9A-Za-z])(?:No\. ?)?\d{1,5} [A-Z][a-z]+(?: [A-Z][a-z]+)? (?:Road|Street|Avenue|Lane|Boulevard|Drive|Rd|St|Ave)\b(?:, ?[A-Z][a-z]+(?: \d{5,6})?)?")
_WAY = re.compile(r" (?:Road|Street|Avenue|Lane|Boulevard|Drive|Rd|St|Ave)\b")
# Words with a capital that aren't names.
NO_NAME = "Mr|Ms|Mrs|Dr|Miss|Prof|Sir|Contact|Attn|Applicant|Representative|Officer|The|This|That|Every|Each|All|If|When|Please|For|To|In|On|At|By|From|Call|Write|Questions|And|Or|Our|Their|Its"
NAME_LATIN = re.compile(rf"(?<![A-Za-z])(?!(?:{NO_NAME})\b)([A-Z][a-z]+) (?!(?:{NO_NAME})\b)([A-Z][a-z]+)(?![A-Za-z])")
_BEFORE, _BEFORE_LATIN, _NOT = re.compile(CUES_BEFORE), re.compile(CUES_LATIN), re.compile(NOT_NUMBER)
_CUE_WORD = re.compile("联系人|收件人|法定代表人|听证代表|聽證代表|姓名|申请人|申請人|聯繫人|聯系人")
_CUED = re.compile(rf"(?:联系人[:：]|收件人|法定代表人|听证代表|聽證代表|姓名[:：]|申请人|申請人|聯繫人[:：]|聯系人[:：])([{FAMILY}])[ 　]?([一-鿿]{{1,2}}?)(?=[ 　，；（,;(\t。]|已提交)")


def fold(text: str) -> str:
    """Full-width signs, odd blanks and dashes as plain ones; every character keeps its position."""
    if text.isascii():
        return text
    for wide, plain in _SIGNS:
        text = text.replace(wide, plain)
    if _ALNUM_SEEN.search(text):
        for wide, plain in _ALNUM:
            text = text.replace(wide, plain)
    return text


@dataclass
class Model:
    """Weights of the field and the characters seen in given names, of all documents."""

    given: str = ""
    node: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES, dtype=np.float64))
    chain: float = 0.3
    skip: float = 1.0

    def known(self) -> frozenset[str]:
        if not hasattr(self, "_known"):
            self._known = frozenset(self.given)
        return self._known

    def names(self) -> re.Pattern | None:
        if not hasattr(self, "_names"):
            g = re.escape(self.given)
            self._names = re.compile(rf"[{FAMILY}] ?[{g}]{{1,2}}(?![{g}])|[{FAMILY}] ?[{g}]{{2}}") if g else None
        return self._names


@dataclass
class Mention:
    start: int
    end: int
    kind: str
    key: str


def cued(text: str) -> Iterator[re.Match]:
    """Names of a folded text that follow a decisive word: groups of family name and given name."""
    return _CUED.finditer(text) if _CUE_WORD.search(text) else iter(())


def counted(texts: list[str]) -> Counter[str]:
    """For each character the number of names after a decisive word that hold it as given name."""
    seen: Counter[str] = Counter()
    for t in texts:
        for m in cued(t):
            seen.update(set(m.group(2)))
    return seen


def given_of(counts: dict[str, int]) -> str:
    return "".join(sorted(c for c, n in counts.items() if n >= 2))


def candidates(text: str, model: Model) -> list[Mention]:
    """Candidate mentions of a folded text, in order; of overlapping ones the more specific kind stays."""
    out: list[Mention] = []
    if _AT_SIGN.search(text):
        out += [Mention(m.start(), m.end(), "email", m.group().lower()) for m in EMAIL.finditer(text)]
    for run in _RUN.finditer(text):
        for m in IDNUM.finditer(text, run.start(), run.end() + 2):
            out.append(Mention(m.start(), m.end(), "idnum", re.sub(r"[- ]", "", m.group()).upper()))
        for m in PHONE.finditer(text, run.start(), run.end() + 12):
            out.append(Mention(m.start(), m.end(), "phone", re.sub(r"\D", "", m.group())[-11:]))
    done = 0
    for anchor in _HOUSE.finditer(text):  # the costly pattern only runs before a house number
        if anchor.end() > done and (m := ADDRESS.search(text, max(done, anchor.start() - 24, 0))) and m.start() < anchor.start():
            out.append(Mention(m.start(), m.end(), "address", m.group()))
            done = m.end()
    for m in ADDRESS_LATIN.finditer(text) if _WAY.search(text) else ():
        out.append(Mention(m.start(), m.end(), "address", m.group()))
    rank = {k: i for i, k in enumerate(("email", "idnum", "address", "phone", "name"))}
    out.sort(key=lambda x: (rank[x.kind], x.start))
    taken: list[Mention] = []
    for x in out:
        if not any(x.start < y.end and y.start < x.end for y in taken):
            taken.append(x)
    named = []
    if (names := model.names()) is not None:
        named += [Mention(m.start(), m.end(), "name", m.group().replace(" ", "")) for m in names.finditer(text)]
    if rare := {m.group(1) + m.group(2) for m in cued(text) if not set(m.group(2)) <= model.known()}:
        again = re.compile("|".join(x[0] + "[ 　]?" + x[1:] for x in sorted(rare, key=len, reverse=True)))
        more = [Mention(m.start(), m.end(), "name", re.sub("[ 　]", "", m.group())) for m in again.finditer(text)]
        named = [y for y in named if not any(x.start < y.end and y.start < x.end for x in more)] + more
    for m in NAME_LATIN.finditer(text):
        if m.group(1) in FAMILY_LATIN or m.group(2) in FAMILY_LATIN:
            named.append(Mention(m.start(), m.end(), "name", " ".join(sorted(m.groups()))))
    spans = sorted((y.start, y.end) for y in taken)
    starts = [a for a, _ in spans]
    for x in named:
        i = bisect_right(starts, x.start)
        if not (i and spans[i - 1][1] > x.start) and not (i < len(spans) and spans[i][0] < x.end):
            taken.append(x)
    return sorted(taken, key=lambda x: x.start)


def shape(c: str) -> str:
    return "9" if c.isdigit() else "a" if c.isascii() and c.isalpha() else "字" if "一" <= c <= "鿿" else c


def _slot(s: str) -> int:
    h = 2166136261
    for c in s:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h % FEATURES


_slots: dict[str, int] = {}


def features(text: str, x: Mention) -> list[int]:
    """Slots of what surrounds a mention and of its own form."""
    before, after = text[max(0, x.start - 4) : x.start], text[x.end : x.end + 3]
    names = [x.kind, f"{x.kind}<{before[-1:]}", f"{x.kind}<<{before[-2:]}", f"{x.kind}<s{''.join(map(shape, before[-2:]))}", f"{x.kind}>{after[:1]}", f"{x.kind}>>{after[:2]}", f"{x.kind}>s{''.join(map(shape, after[:2]))}", f"{x.kind}#{len(x.key)}"]
    if x.kind == "name":
        names.append(f"n^{x.key[:1] if x.key[:1] > 'z' else 'latin'}")
        if _BEFORE.search(text, max(0, x.start - 12), x.start) or _BEFORE_LATIN.search(text, max(0, x.start - 12), x.start):
            names.append("n:cue")
    elif x.kind in ("phone", "idnum") and _NOT.search(text, max(0, x.start - 12), x.start):
        names.append("no:cue")
    out = []
    for n in names:
        s = _slots.get(n)
        if s is None:
            s = _slot(n)
            if len(_slots) < 200_000:
                _slots[n] = s
        out.append(s)
    return out


def decided(text: str, x: Mention) -> int | None:
    """1 or 0 where the surroundings decide a mention, else None."""
    before, after = text[max(0, x.start - 12) : x.start], text[x.end : x.end + 3]
    if x.kind in ("email", "address"):
        return 1
    if x.kind in ("phone", "idnum"):
        return 0 if _NOT.search(before) or after[:1] in ("元", "万", "吨", "%") else 1
    if _BEFORE.search(before) or _BEFORE_LATIN.search(before):
        return 1
    if x.key[:1] <= "z":
        return 0 if re.match(r" ?(?:Road|Street|Avenue|Lane|Plan|Province|City|County)", after + text[x.end + 3 : x.end + 9]) else 1 if re.match(r",? (?:of|can|ID|lives|\d)", text[x.end : x.end + 6]) else None
    inner = shape(before[-1:]) == "字" and shape(after[:1]) == "字"
    return 0 if inner and not re.match(r"同志|主任|反映|科长|处长", text[x.end : x.end + 2]) else None


def edges(found: list[Mention]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain, skip): neighbours not far apart; mentions of one kind with equal keys, each joined to the one before."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1].start - found[i].end <= NEAR]
    last: dict[tuple[str, str], int] = {}
    skip = []
    for i, x in enumerate(found):
        for key in {(x.kind, x.key), (x.kind, x.key[:2]) if x.kind == "name" and x.key[:1] > "z" else (x.kind, x.key)}:
            if key in last:
                skip.append((last[key], i))
            last[key] = i
    return chain, skip


def infer(scores: np.ndarray, chain: list[tuple[int, int]], skip: list[tuple[int, int]], model: Model) -> np.ndarray:
    """Probability of each mention, by loopy message passing over Ising-like edges."""
    n = len(scores)
    links = [(a, b, model.chain) for a, b in chain] + [(a, b, model.skip) for a, b in skip]
    if not links or n == 1:
        return 1 / (1 + np.exp(-scores))
    tanhs = [math.tanh(w / 2) for _, _, w in links]
    to: list[list[int]] = [[] for _ in range(n)]
    ends = []
    for k, (a, b, _) in enumerate(links):
        ends += [(a, b, tanhs[k]), (b, a, tanhs[k])]
        to[b].append(2 * k)
        to[a].append(2 * k + 1)
    msg = [0.0] * len(ends)
    s = scores.tolist()
    for _ in range(ROUNDS):
        total = [s[i] + sum(msg[e] for e in to[i]) for i in range(n)]
        msg = [2 * math.atanh(max(-0.999999, min(0.999999, t * math.tanh((total[a] - msg[e ^ 1]) / 2)))) for e, (a, b, t) in enumerate(ends)]
    total = np.array([s[i] + sum(msg[e] for e in to[i]) for i in range(n)])
    return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def learn(texts: list[str], given: str | None = None) -> Model:
    """A model from texts: weights by pseudo-likelihood (AdaGrad). `given` holds the characters of given names in all
    documents; without it the texts are all there are."""
    texts = [fold(t) for t in texts if t]
    model = Model(given_of(counted(texts)) if given is None else given)
    rows, labels, chained, skipped = [], [], [], []
    for t in texts:
        found = candidates(t, model)
        gold = [decided(t, x) for x in found]
        chain, skip = edges(found)
        near: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for k, pairs in enumerate((chain, skip)):
            for a, b in pairs:
                for u, v in ((a, b), (b, a)):
                    if gold[v] is not None:
                        near[u][k] += 1 if gold[v] else -1
        for i, x in enumerate(found):
            if gold[i] is not None:
                rows.append(features(t, x))
                labels.append(gold[i])
                chained.append(near[i][0])
                skipped.append(near[i][1])
    w = np.zeros(FEATURES)
    grads = np.full(FEATURES, 1e-6)
    chain_w, skip_w, g_chain, g_skip = 0.3, 1.0, 1e-6, 1e-6
    order = np.random.Generator(np.random.PCG64(3)).permutation(len(rows))
    for _ in range(3):
        for i in order.tolist():
            r = rows[i]
            z = w[r].sum() + chain_w * chained[i] / 2 + skip_w * skipped[i] / 2
            d = 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) - labels[i]
            np.add.at(grads, r, d * d)
            w[r] -= 0.2 * d / np.sqrt(grads[r]) + 1e-5 * w[r]
            g_chain += (d * chained[i]) ** 2
            g_skip += (d * skipped[i]) ** 2
            chain_w -= 0.02 * d * chained[i] / math.sqrt(g_chain)
            skip_w -= 0.02 * d * skipped[i] / math.sqrt(g_skip)
    model.node, model.chain, model.skip = w, float(np.clip(chain_w, 0, 1)), float(np.clip(skip_w, 0.2, 3))
    return model


def mentions(text: str | None, model: Model) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal information in a text; none for null and empty texts."""
    if not text:
        return []
    t = fold(text)
    found = candidates(t, model)
    if not found:
        return []
    scores = np.array([model.node[features(t, x)].sum() for x in found])
    return [(x.kind, x.start, x.end) for x, p in zip(found, infer(scores, *edges(found), model)) if p >= 0.5]


def given(df: DataFrame, text: str) -> str:
    """Characters of given names by an aggregate over all documents; a row for each ideograph at most reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for b in batches:
            seen.update(counted([fold(t) for t in b["text"]]))
        yield pd.DataFrame(list(seen.items()), columns=["sign", "n"])

    own = df.select(F.col(f"`{text}`").alias("text")).where(F.col("text").rlike(_CUE_WORD.pattern))
    totals = own.mapInPandas(run, "sign string, n long").groupBy("sign").agg(F.sum("n").alias("n")).where("n >= 2").collect()
    return given_of({r["sign"]: r["n"] for r in totals})


def fit(df: DataFrame, key: str, text: str, sample: int = SAMPLE) -> Model:
    """Characters of given names from all documents; weights from at most `sample`, taken by the hash of their key."""
    rows = df.select(F.xxhash64(F.col(f"`{key}`")).alias("h"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return learn([r["text"] for r in bounded(rows, F.col("h"), sample, ["key"], df.count()) if r["text"]], given(df, text))


def find(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """(key, kind, start_pos, end_pos) of every mention, positions in characters from 0. Row-local but for the fit."""
    shared = df.sparkSession.sparkContext.broadcast(model or fit(df, key, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *m) for k, t in zip(b["key"], b["text"]) for m in mentions(t, shared.value)]
            yield pd.DataFrame(out, columns=["key", "kind", "start_pos", "end_pos"])

    own = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).where(F.length("text") > 0)
    return own.mapInPandas(run, "key long, kind string, start_pos int, end_pos int").withColumnRenamed("key", key)


def masked(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """(key, text): every text with typed placeholders such as [EMAIL]; all other characters unchanged, nulls kept."""
    shared = df.sparkSession.sparkContext.broadcast(model or fit(df, key, text))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            last, parts = 0, []
            for kind, a, b in mentions(t, shared.value):
                parts += [t[last:a], f"[{kind.upper()}]"]
                last = b
            out.append(t if not last else "".join(parts) + t[last:])
        return pd.Series(out, dtype=object)

    return df.select(F.col(f"`{key}`"), run(F.col(f"`{text}`")).alias("text"))
