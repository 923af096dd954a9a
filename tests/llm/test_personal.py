import random

from inkweir.llm import personal as P

FAMILY, GIVEN = "王李张刘陈梅郭田樊", "朔澜秋晏砚翎霁桁岫鹤"
SCHEMA = "doc_id long, text string, kind string, key int"


def person():
    return random.choice(FAMILY) + "".join(random.choice(GIVEN) for _ in range(random.randint(1, 2)))


def documents(n=300):
    random.seed(11)
    out = []
    for i in range(n):
        parts, want = [], set()

        def say(text, kind=None):
            if kind:
                want.add((kind, sum(map(len, parts))))
            parts.append(text)

        say("各有关单位应当统一推进项目计划，费用23042009700元，热线12345受理咨询。")
        p = person()
        say("联系人：")
        say(p, "name")
        say("，电话")
        say(random.choice([f"1{random.randint(3, 9)}{random.randint(100000000, 999999999)}", "（0589）8865962", "+86 160 3818 4673", "１６４００１９３７８２", "0699-5235608转81"]), "phone")
        say("；邮箱：")
        say(random.choice(["a.b_c@mail.site.example", "abc(at)site.example", "abc [at] site [dot] example"]), "email")
        say("。\n听证代表")
        say(p, "name")
        say("，现住")
        say(random.choice(["岚泽省煦台市潋峪县霁塬东路414号", "筠浦市琅坪县砚岭北街331号29号楼947室"]), "address")
        say("，公民身份号码")
        say(random.choice(["990630198306014939", "990506 19680723 307X", "990607030520575"]), "idnum")
        say("。项目代码：2033-990471-04-01-49872533，编号为BH9901652056037000991。\n")
        out.append((i, "".join(parts), want))
    return out


def test_found_and_masked(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + [(900, None, "x", 1), (901, "", "x", 1), (902, "没有。" * 50000, "x", 1)], SCHEMA)
    model = P.fit(df, "doc_id", "text")
    got = {}
    for r in P.find(df, "doc_id", "text", model).collect():
        got.setdefault(r["doc_id"], set()).add((r["kind"], r["start_pos"]))
    want = {i: w for i, _, w in rows}
    hit = sum(len(got.get(i, set()) & w) for i, w in want.items())
    assert hit >= 0.99 * sum(map(len, want.values())) and hit >= 0.99 * sum(map(len, got.values()))
    masked = {r["doc_id"]: r["text"] for r in P.masked(df, "doc_id", "text", model).collect()}
    assert masked[900] is None and masked[901] == "" and masked[902] == "没有。" * 50000
    for i, t, _ in rows:
        spans = sorted((a, b, k) for k, a, b in P.mentions(t, model))
        out, last = "", 0
        for a, b, k in spans:
            assert a >= last
            out, last = out + t[last:a] + f"[{k.upper()}]", b
        assert masked[i] == out + t[last:]


def test_names_are_candidates_whatever_the_sample(spark):
    rows = [(i, t, "x", 1) for i, t, _ in documents(120)]
    rare = ["王犇犇", "李犇", "张犇", "刘犇", "陈犇", "梅犇", "郭犇", "田犇"]  # in documents that the sample doesn't hold
    rows += [(1000 + k, f"各有关单位推进工作。联系人：{p}，电话13800000000。\n听证代表{p}，现住此处。", "x", 1) for k, p in enumerate(rare)]
    once = "各有关单位推进工作。联系人：樊麤，电话13800000000。\n办理人樊麤。"
    rows.append((2000, once, "x", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    model = P.fit(df, "doc_id", "text", sample=1)
    assert "犇" in model.given and set(GIVEN) <= set(model.given) and "麤" not in model.given
    for _, t, *_ in rows[120:]:
        name = next(P.cued(t)).group(1, 2)
        want = [m.start() for m in P.re.finditer("".join(name), t)]
        assert [x.start for x in P.candidates(t, model) if x.kind == "name"] == want and len(want) == 2


def test_message_passing_agrees_on_a_tree():
    import itertools
    import math

    import numpy as np

    m = P.Model(chain=0.8, skip=1.2)
    s, chain, skip = np.array([0.5, -1.0, 2.0]), [(0, 1)], [(1, 2)]
    total, on = 0.0, np.zeros(3)
    for x in itertools.product((0, 1), repeat=3):
        w = math.exp(sum(s[i] * x[i] for i in range(3)) + sum((m.chain if k == 0 else m.skip) / 2 * (1 if x[a] == x[b] else -1) for k, e in enumerate((chain, skip)) for a, b in e))
        total += w
        on += w * np.array(x)
    assert np.allclose(P.infer(s, chain, skip, m), on / total, atol=1e-6)


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "x", "x", 1)], SCHEMA).limit(0)
    assert P.find(df, "doc_id", "text").count() == 0 and P.masked(df, "doc_id", "text").count() == 0
