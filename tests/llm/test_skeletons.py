import itertools
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from inkweir.llm.skeletons import consistent_forms, form_of, same_reading_pairs, skeleton_of, table

FIELDS = {"title": False, "wenhao": True}
SCHEMA = "id long, title string, wenhao string, field string, value string"


def test_look_alikes_read_the_same():
    for a, b in (("２０２５年", "2025年"), ("ΑΙ算力", "AI算力"), ("Résidé", "Résidé"), ("工​作", "工作"), ("⼯作", "工作"), ("エ作", "工作"), ("⻓江", "长江"), ("二○二五", "二〇二五"), ("﹙一﹚", "（一）"), ("a b", "a b"), ("𝟐𝟎", "20"), ("B‑级", "B-级")):
        assert skeleton_of(a) == skeleton_of(b), (a, b)


def test_visible_differences_stay():
    for a, b in (("AI", "Ai"), ("2025", "2026"), ("办法", "办法（试行）"), ("①", "1"), ("x²", "x2"), ("Résidé", "Reside"), ("a b", "ab")):
        assert skeleton_of(a) != skeleton_of(b), (a, b)


def test_numbers_ignore_brackets_and_blanks():
    forms = ["朔发改〔2025〕7号", "朔发改[2025]7号", "朔发改【２０２５】７ 号", "朔发改（2025）7号", "朔发改﹝2025﹞7　号"]
    assert len({skeleton_of(f, True) for f in forms}) == 1


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_skeleton_is_stable(s):
    k = skeleton_of(s)
    assert skeleton_of(k) == k
    assert skeleton_of(form_of(s)) == k
    assert skeleton_of(unicodedata.normalize("NFD", s)) == skeleton_of(unicodedata.normalize("NFC", s))


def test_forms_leave_scripts_alone():
    for x in ("カード", "エネルギー", "Москва", "Λόγος", "工业カード", "人口二八", "Résidé"):
        assert form_of(x) == x
    assert form_of("ＡΙ算力") == "AI算力" and form_of("エ程") == "工程" and form_of("カ一ド") == "カード" and form_of("Mocквa") == "Москва"


def test_loose_skeletons():
    assert skeleton_of("paypaI", loose=True) == skeleton_of("paypal", loose=True) != skeleton_of("paypaI")
    assert skeleton_of("rn0", loose=True) == skeleton_of("mO", loose=True)


def test_table_prototypes_are_final():
    t = table()
    assert all(v.translate(t) == v for v in t.values())


def test_pairs_equal_brute_force(spark):
    titles = ["计划２", "计划2", "计划2", "计划 2", None, "", "​", "エ程", "工程", "工程", "x" * 5000 + "１", "x" * 5000 + "1"]
    numbers = ["甲〔2025〕1号", "甲[2025]1 号", None, "", "甲〔2025〕1号", "乙〔2025〕1号", None, None, None, None, None, None]
    rows = [(i, t, n, "clash", "clash") for i, (t, n) in enumerate(zip(titles, numbers))]
    rows += rows[:2]  # repeated rows
    got = {tuple(r) for r in same_reading_pairs(spark.createDataFrame(rows, SCHEMA), "id", FIELDS).collect()}
    want = set()
    for f, k, flag in (("title", 1, False), ("wenhao", 2, True)):
        for a, b in itertools.combinations(rows, 2):
            if a[k] and b[k] and a[k] != b[k] and a[0] != b[0] and skeleton_of(a[k], flag) == skeleton_of(b[k], flag) != "":
                want.add((f, min(a[0], b[0]), max(a[0], b[0])))
    assert got == want and want


def test_forms_and_empty_table(spark):
    df = spark.createDataFrame([(1, "２", None, "", ""), (2, None, "甲[１]2 号", "", "")], SCHEMA)
    got = {(r["field"], r["id"]): r["form"] for r in consistent_forms(df, "id", FIELDS).collect()}
    assert got == {("title", 1): "2", ("wenhao", 2): "甲〔1〕2号"}
    assert same_reading_pairs(df.limit(0), "id", FIELDS).count() == 0
    assert consistent_forms(df.limit(0), "id", FIELDS).count() == 0
