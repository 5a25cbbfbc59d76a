"""Parsing of pages on small cases."""

from pyspark.sql import functions as F

from foliolith.operators import parsing as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sections_follow_the_numbers(spark):
    lines = ["preface 3.1 x", "1 General", "Body of inter-", "granular text", "1.1 Scope", "2 Next", "7 Too Far", "3.5% salt", "and more", "3 Last"]
    df = spark.createDataFrame([("m", i, t, 12.0, True, i // 4) for i, t in enumerate(lines)], "m string, i int, text string, size double, bold boolean, page int")
    found = {r["core"]: (r["title"], r["body"]) for r in R.sections(df, "m", ["i"]).collect()}
    assert found == {"1": ("General", "Body of intergranular text"), "1.1": ("Scope", ""), "2": ("Next", "7 Too Far 3.5% salt and more"), "3": ("Last", "")}
    assert R.sections(df.limit(0), "m", ["i"]).count() == 0


def test_first_section_must_stand_out(spark):
    df = spark.createDataFrame([("m", 0, "1 General", 10.0, True, 1), ("m", 1, "2 Next", 12.0, True, 1)], "m string, i int, text string, size double, bold boolean, page int")
    assert R.sections(df, "m", ["i"]).count() == 0


def test_tokens_mark_raised_runs(spark):
    chars = [(i, c, r) for i, (c, r) in enumerate([("1", False), ("0", False), ("-", True), ("3", True), (" ", False), ("2", True), ("x", False)])]
    df = spark.createDataFrame([("p", i, c, r, float(i), float(i + 1), 0.0, 1.0) for i, c, r in chars], "p string, i int, char string, raised boolean, x0 double, x1 double, y0 double, y1 double")
    assert [(r["token_no"], r["text"]) for r in R.char_tokens(df, ["p"], "i").orderBy("token_no").collect()] == [(1, "10^-3"), (2, "2x")]


def test_continued_captions(spark):
    line = lambda t, y, x=0.0: ("p", t, x, y, x + 50.0, y + 10.0)
    lines = [line("Figure 1.1 One", 0.0), line("goes on", 11.0), line("elsewhere", 12.0, 200.0), line("Table 2.1 Two", 30.0), line("far below", 90.0)]
    df = spark.createDataFrame(lines, "p string, text string, x0 double, y0 double, x1 double, y1 double")
    assert rows(R.continued_captions(df, "p")) == [("p", 1, "Figure 1.1 One goes on", 2), ("p", 2, "Table 2.1 Two", 1)]


def test_offsets_and_names(spark):
    parts = spark.createDataFrame([("t", 1, 3, 1), ("t", 2, 4, 2), ("t", 3, 1, 1)], "t string, order int, n_rows int, n_components int")
    assert rows(R.combined(parts, "t").select("order", "row_offset", "component_offset")) == [(1, 0, 0), (2, 3, 1), (3, 7, 3)]
    assert spark.range(1).select(R.related_name(F.lit(7), F.lit("related figure"), F.lit("3.1/a"))).first()[0] == "p0007_related_figure_3.1_a.pdf"


def test_reparse(spark):
    schema = "key string, synthetic_id string, candidate_id string, pages array<int>"
    old = spark.createDataFrame([("a", "", "x", [1, 2]), ("", "s", "y", [3]), (None, None, None, [1]), ("g", "", "", None)], schema)
    new = spark.createDataFrame([("a", "", "z", [2]), ("", "s", "y", [3, 4]), ("n", "", "", [1])], schema)
    assert rows(R.reparse(old, new)) == [("a", "updated"), ("g", "gone"), ("n", "new"), ("s", "grown")]


def test_related_name_keeps_whole_pages(spark):
    names = spark.range(1).select(R.related_name(F.lit(12345), F.lit("k"), F.lit("1")), R.related_name(F.lit(None).cast("int"), F.lit("k"), F.lit("1"))).first()
    assert tuple(names) == ("p12345_k_1.pdf", None)
