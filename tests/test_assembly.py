"""Assembly operators on small cases."""

from pyspark.sql import functions as F

from foliolith.operators import assembly as A


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_new_nodes_are_numbered_after_the_last(spark):
    nodes = spark.createDataFrame([("d", "a", 1), ("d", "b", 5), ("d", "b", 6)], "doc string, key string, sequence bigint")
    incoming = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "y"), ("d", "x"), ("d", "x"), ("e", "a")], "doc string, key string")
    assert rows(A.add_nodes(nodes, incoming, "doc", "key")) == [("d", "a", 1, "matched"), ("d", "b", None, "ambiguous"), ("d", "x", 7, "new"), ("d", "y", 8, "new"), ("e", "a", 1, "new")]


def test_slices(spark):
    tables = spark.createDataFrame([("t", 5, [2, 0, 3]), ("u", 4, [1, 1]), ("v", 0, [])], "k string, n_rows int, counts array<int>")
    assert rows(A.slices(tables, "k")) == [("t", 1, 1, 2, "cut"), ("t", 2, 3, 2, "cut"), ("t", 3, 3, 5, "cut"), ("u", None, None, None, "mismatch")]


def test_groups_break_at_gaps_and_titles(spark):
    tables = spark.createDataFrame([("k", 1, 1, 3, "A"), ("k", 2, 2, 2, None), ("k", 3, 3, 4, "a "), ("k", 4, 3, 5, "B"), ("k", 5, 9, 9, "B")], "k string, record_id int, first_page int, last_page int, title string")
    assert [r["part_of"] for r in A.combined_groups(tables, ["k"], F.col("title")).orderBy("record_id").collect()] == [0, 0, 0, 1, 2]


def test_nearest_tick(spark):
    hints = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 100.0), ("b", 3, 10.0)], "axis string, hint_id int, at double")
    ticks = spark.createDataFrame([("a", 7, 8.0), ("a", 6, 12.0), ("a", 5, 90.0), ("b", 4, 23.0)], "axis string, tick_id int, px double")
    assert rows(A.nearest_tick(hints, ticks, ["axis"], 12.0)) == [("a", 1, 6), ("a", 2, 5), ("b", 3, None)]


def test_names(spark):
    df = spark.createDataFrame([("table", "3.1", " Name "), ("section", "", None), (None, "2", "x")], "kind string, id string, title string")
    assert sorted(r[0] for r in df.select(A.display_name(F.col("kind"), F.col("id"), F.col("title"))).collect()) == ["", "2 x", "Table 3.1 Name"]
