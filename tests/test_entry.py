"""The driver's contract."""

import __spark_entry__ as entry


def test_names_and_oracles():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert {"p3_found", "p4_found"} <= set(queries)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["record_id", "entity", "parent_pos", "pos"] and df.count() > 0
