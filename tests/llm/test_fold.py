"""Forms by looks and by content, and pairs of alike texts against all pairs."""

import random
import unicodedata

import pytest

from foliolith.llm import alike, fold


@pytest.mark.parametrize("a,b", [("Ａ１", "A1"), ("e\u0301", "é"), ("a\u200bb", "ab"), ("a\u00a0b", "a b"), (" a\u3000", "a"), ("Сlаѕѕ", "Class"), ("ﬁn", "fin"), ("\u212a", "K"), ("µ", "μ"), ("Ⅳ", "IV"), ("a‐b", "a-b"), ("\u00adx", "x"), ("…", "..."), ("е\u0301", "é")])
def test_same_looks(a, b):
    assert fold.looks(a) == fold.looks(b)


@pytest.mark.parametrize("a,b", [("10²", "102"), ("a", "A"), ("e", "é"), ("α", "a"), ("H₂O", "H2O"), ("①", "1"), ("O", "0"), ("ß", "ss"), ("–", "-"), ("ø", "o")])
def test_different_looks(a, b):
    assert fold.looks(a) != fold.looks(b)


def test_one_form():
    assert fold.one_form(" Ｓtraße\u00a0\u200b ") == "strasse"
    assert fold.one_form("Сlаss") == "class" and fold.one_form("сталь жёсткая") == "сталь жёсткая"
    assert fold.one_form(None) is None and fold.one_form("") == "" and fold.looks(None) is None
    assert fold.one_form("10²") == "102" and fold.one_form("ﬃ") == "ffi"


def test_one_form_is_stable():
    for c in range(0x20, 0x3000):
        if not 0xD800 <= c < 0xE000:
            once = fold.one_form(f"a{chr(c)}b")
            assert fold.one_form(once) == once and unicodedata.is_normalized("NFKC", once)


def test_looks_is_stable():
    for c in range(0x20, 0x3000):
        once = fold.looks(f"a{chr(c)}b")
        assert fold.looks(once) == once


def test_pairs_equal_all_pairs(spark):
    r = random.Random(2)
    forms = ["A1", "Ａ1", "А1", "A\u200b1", " A1", "A2", "a1", "", " ", "\u200b", None]
    rows = [(i, r.choice(["s", "t", None]), r.choice(["x", "y"]), r.choice(forms), "clash") for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, g string, h string, text string, looks string")
    found = sorted(tuple(x) for x in alike.alike_pairs(df, "f", ["g", "h"], "id", "text").collect())
    want = sorted(("f", a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] and a[1:3] == b[1:3] and a[3] is not None and b[3] is not None and a[3] != b[3] and fold.looks(a[3]) == fold.looks(b[3]))
    assert found == want
    assert alike.alike_pairs(df.limit(0), "f", ["g"], "id", "text").count() == 0
    assert alike.forms(df, "f", "id", "text").count() == 120


def test_long_text():
    assert len(fold.looks("Ａ" * 200_000)) == 200_000


def test_links_and_escapes_read_as_shown():
    shown = "see the table of steel here"
    for text in ("see the [table](https://x.y/z_1) of steel here", 'see the [table](a/b "title") of steel here', "see the [[Hardness of alloys|table]] of steel here", "see the [https://x.y/z table] of steel here", "see the \\href{https://x.y}{table} of steel here", "see the &amp;lt;b&amp;gt;table&amp;lt;/b&amp;gt; of steel here"):
        assert fold.words(fold.reader_text(text))[0] == shown.split(), text
    assert fold.words(fold.reader_text("Gr&amp;amp;ouml;&amp;szlig;e"))[0] == ["grösse"]


@pytest.mark.parametrize("a,b", [("Сталь А36", "Сталь A36"), ("Cталь", "Сталь"), ("СТАЛЬ В", "CTAЛЬ B"), ("a  b", "a b"), ("Ꭺ1", "A1"), ("օ", "o")])
def test_one_form_of_mixed_scripts(a, b):
    assert fold.one_form(a) == fold.one_form(b)


def test_equal_looks_have_one_form():
    r = random.Random(3)
    signs = list("AaВвСсКкМмТтOo12 ²é") + ["e\u0301", "\u200b", "Ａ", "ﬁ", "Ω", "μ", "Ѵ"]
    texts = {"".join(r.choices(signs, k=r.randint(1, 4))) for _ in range(20_000)}
    form = {}
    for t in texts:
        assert form.setdefault(fold.looks(t), fold.one_form(t)) == fold.one_form(t), t


def test_classes_hold_the_links_of_the_pairs(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["s", "t", None]), r.choice(["A1", "Ａ1", "А1", "a1", "", "\u200b", None])) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, g string, text string")
    links = {}
    for p in alike.alike_pairs(df, "f", ["g"], "id", "text").collect():
        for i in (p["id_a"], p["id_b"]):
            links[i] = links.get(i, 0) + 1
    classes = alike.alike_classes(df, "f", ["g"], "id", "text").collect()
    assert len(classes) == sum(g is not None and t is not None for _, g, t in rows)
    assert all(c["links"] == links.get(c["id"], 0) and c["class_id"] <= c["id"] for c in classes)
