"""Review states, ledger, ready tables and ancestors on small cases."""

import pytest

from foliolith.operators import reviews as V


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_states_and_ledger(spark):
    tables = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), (None, 1)], "k string, revision int")
    reviews = spark.createDataFrame([("a", 1, "verified"), ("b", 1, "draft")], "k string, base_revision int, status string")
    assert rows(V.review_states(tables, reviews, "k")) == rows(spark.createDataFrame([("a", "verified"), ("b", "stale"), ("c", "unreviewed"), (None, "unreviewed")], "k string, s string"))
    planned = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 2)], "k string, revision int")
    reports = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("e", 1, "x")], "k string, base_revision int, digest string")
    applied = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, digest string")
    assert dict(rows(V.batch_ledger(planned, reports, applied, "k"))) == {"a": "unchanged", "b": "changed", "c": "ready", "d": "pending", "e": "stale"}
    assert V.batch_ledger(planned.limit(0), reports, applied, "k").count() == 0


def test_ready_tables(spark):
    tables = spark.createDataFrame([(1, "m", "1.1", False), (2, "m", "1.1", True), (3, "m", None, False), (4, "n", "1.1", False), (5, "m", None, True)], "id int, m string, key string, needs_review boolean")
    assert [r["id"] for r in V.ready_tables(tables, "m", "key").orderBy("id").collect()] == [3, 4]


def test_set_issues(spark):
    part = "struct<source_physical_pages:array<int>,grid:struct<rows:array<array<string>>>>"
    schema = f"record_id int, candidate_id string, manual string, node_id_raw string, components array<{part}>"
    data = [
        (1, "a", "m", " 1.1A", [([1, 2], ([["x"], None],)), ([3], ([["x", "y"]],)), None]),
        (2, "b", "m", "1.1a", [([1, None], None), ([1, 1], ([],))]),
        (3, "c", "n", "1.1a", None),
        (4, "a", "m", None, []),
    ]
    assert rows(V.set_issues(spark.createDataFrame(data, schema))) == [(1, "cross_fragment_column_mismatch"), (1, "duplicate_identifier_candidates"), (2, "duplicate_identifier_candidates"), (2, "same_page_multiple_components")]


def test_ancestors(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(30)], "n int, p int")
    found = V.ancestors(chain, "n", "p")
    assert found.count() == 29 * 30 // 2 and found.where("distance = 29").count() == 1
    with pytest.raises(ValueError):
        V.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "n int, p int"), "n", "p").count()


def test_minted_ids(spark):
    blocks = spark.createDataFrame([(1, "s", 7), (2, "s", 7), (3, "s", None), (4, "t", 12345)], "b int, s string, page int")
    assert rows(V.minted_ids(blocks, "s", "page", "b").select("b", "synthetic_id")) == [(1, "unnumbered-p0007-01"), (2, "unnumbered-p0007-02"), (3, None), (4, "unnumbered-p12345-01")]
