"""Scalar functions against literal cases."""

import pytest
from pyspark.sql import functions as F

from foliolith.functions import identifiers as I
from foliolith.functions import numbers as N
from foliolith.functions import text as X


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").coalesce(1).orderBy("i").select(column).collect()]


def test_identifiers(spark):
    """Every shape of a suffix behind numbers of one to four levels, and two suffixes in a row."""
    shapes = [("", []), ("(c)", ["c"]), ("[C]", ["c"]), ("-C", ["c"]), ("—c", ["c"]), (".c", ["c"]), ("C", ["c"]), ("(12)", ["12"]), ("(iv)", ["iv"]), (" ( d )", ["d"]), ("c(2)", ["c", "2"]), ("(a)(b)", ["a", "b"])]
    cases = [(core + shape, "|".join([core, *marks])) for core in ("7", "2.10", "5.4.31", "9.8.7.6") for shape, marks in shapes if core != "7" or shape != ".c"]
    for tail in ("", " Creep of rods", ": notes", " [Table] x"):
        parsed = values(spark, [text + tail for text, _ in cases], I.parse_identifier(X.source_text(X.nfkc(F.col("t")))))
        assert [p["match_key"] for p in parsed] == [key for _, key in cases]
        assert [p["depth"] for p in parsed] == [p["core"].count(".") + 1 for p in parsed]
    spaced = values(spark, ["２ ． ４ Wide", "6 . 2 . 1. Dots", "2.4·1 Middle dots"], I.parse_identifier(X.source_text(X.nfkc(F.col("t")))))
    assert [p["core"] for p in spaced] == ["2.4", "6.2.1", "2.4.1"]
    assert values(spark, ["07", "2.4inch", "2.4, and", "x2.4", "2.4(zz)", "."], I.parse_identifier(F.col("t"))) == [None] * 6


def test_identifier_depth_and_absence(spark):
    parsed = values(spark, ["4.0 General", "0.5 x", None, "", "12", "4V alloy"], I.parse_identifier(F.col("t")))
    assert parsed[0]["depth"] == 1 and parsed[4]["depth"] == 1 and parsed[5]["match_key"] == "4|v"
    assert parsed[1] is None and parsed[2] is None and parsed[3] is None


def test_captions(spark):
    texts = ["TABLE 8.2(C) Moduli", "table No 8.2 Moduli", "Tbl 8.2 — Moduli", "Figure No. 8.2[B] Curves", "fig. 8.2d: Curves", "the Table 8.2 Moduli", None]
    parsed = values(spark, texts, I.parse_caption(F.col("t")))
    assert [p and p["kind"] for p in parsed] == ["table", "table", "table", "figure", "figure", None, None]
    assert parsed[0]["identifier"]["raw"] == "8.2(C)" and {p["title"] for p in parsed[:3]} == {"Moduli"} and {p["title"] for p in parsed[3:5]} == {"Curves"}
    assert values(spark, texts, I.parse_caption(F.col("t"), "figure"))[:3] == [None] * 3


def test_headings(spark):
    wrong = ["6.4 and 6.5 agree", "8b Wrought rods", "6.4, where", "6.4) Rods", "6.4; Rods", "6.4] Rods", "12 Rods", "7.5 mm deep", "9 90", "Rods 6.4"]
    assert values(spark, wrong, I.is_heading(F.col("t"))) == [False] * len(wrong)
    assert values(spark, ["6.4 Rods", "6.4.2(b) Rods", "9 Rods"], I.is_heading(F.col("t"))) == [True, True, True]


def test_caption_line(spark):
    texts = ["shown in Table 5.1\nTable 5.2 Rods\nTable 5.3 Bars", "no caption", None]
    found = values(spark, texts, I.caption_line(F.col("t")))
    assert found[0]["identifier"]["core"] == "5.2" and found[1] is None and found[2] is None


PLAIN = [(f"{sign}{digits}", float(f"{sign.replace('−', '-')}{digits}")) for sign in ("", "-", "+", "−") for digits in ("7", "3.25", ".75", "6e2", "4E-3")]
GROUPED = [("3,000", 3000), ("12,345,678.5", 12345678.5), ("3,00", None), ("3000,000", None), (",300", None)]
POWERS = [("10³", 1000), ("10^-2", 0.01), ("4×10⁶", 4e6), ("4 x 10^2", 400), ("-2*10^1", -20), ("10^", None), ("10^400", None)]
OTHERS = [("55 %", 55), ("5%%", None), ("inf", None), ("nan", None), ("7e999", None), ("4.4.4", None), ("seven", None), ("%", None), (" ", None), (None, None)]


@pytest.mark.parametrize("label,value", PLAIN + GROUPED + POWERS + OTHERS)
def test_numeric_value(spark, label, value):
    found = values(spark, [label], N.numeric_value(X.label_text(F.col("t"))))[0]
    assert found == value if value is None else found == pytest.approx(value)


def test_sheet_values(spark):
    texts = ["0", "5", "-7", "05", "1.5", "1.5e3", "01.5", "1e3", "=A1", "9" * 30, None]
    kinds = [v["type"] for v in values(spark, texts, N.sheet_value(F.col("t")))]
    assert kinds == ["int", "int", "int", "text", "float", "float", "text", "text", "text", "text", "text"]


def test_ranges(spark):
    numbers = [1, 26, 27, 52, 53, 702, 703, 704, 16384, 18278]
    letters = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n int").orderBy("n").select(N.column_letters(F.col("n"))).collect()]
    assert letters == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "AAB", "XFD", "ZZZ"]
    assert values(spark, letters, N.column_number(F.col("t"))) == numbers
    assert values(spark, ["B2:A1", "A0:B1", "x", None], N.parsed_range(F.col("t"))) == [None] * 4
    assert values(spark, ["R000C001", "R012C003", None], N.cell_position(F.col("t")))[1].asDict() == {"row": 12, "column": 3}


def test_joined_lines(spark):
    texts = ["inter-\ngranular", "A-\nBeta", "7-\nfold", "self-test-\nbed", "one\n\n two ", "", None]
    assert values(spark, texts, X.paragraph(F.col("t"))) == ["intergranular", "A-Beta", "7-fold", "self-test-bed", "one two", "", None]


def test_segments(spark):
    found = values(spark, ["a/b:c", " . ", "x" * 200, "ok"], X.safe_segment(F.col("t")))
    assert found[:2] == ["a - b - c", "untitled"] and len(found[2]) == 100 and found[2][90:92] == "__" and found[3] == "ok"


def test_other_texts(spark):
    assert values(spark, ["Größe & Weite — 2"], X.outline_key(F.col("t"))) == ["größeandweite2".replace("ß", "ss")]
    assert values(spark, ["x\n Page 012 \ny", "Page A-3", "page 4"], X.printed_page(F.col("t"))) == ["12", "A-3", None]
    assert values(spark, ['a"b\\c'], X.yaml_quoted(F.col("t"))) == ['"a\\"b\\\\c"']
    assert values(spark, ["/a/b/c.md"], X.relative_path(F.col("t"), F.lit("/a/"))) == ["b/c.md"]
    assert values(spark, ['{"text": " a "}', '["a", "b"]', " x ", None], X.textish(F.col("t"))) == ["a", "a b", "x", ""]
