"""Shredding against a plain recursive reading, on hand-made and on given records."""

import json
import random

import pyarrow as pa
import pytest

from foliolith.operators import shred as S
from foliolith.plans.nested import p3_found

CELL = "struct<cell_id:string>"
SCHEMA = f"record_id bigint, entity string, components array<struct<component_id:string,grid:struct<cells:array<{CELL}>>>>, grid struct<cells:array<{CELL}>,embedded_media:array<{CELL}>>, issues array<struct<extra:string>>"


def plain(rows):
    out = []
    for rid, _, components, grid, issues in rows:
        for i, c in enumerate(components or [], 1):
            if c is None:
                continue
            out.append((rid, "component", 0, i))
            for j, x in enumerate(((c[1] or (None,))[0]) or [], 1):
                if x is not None:
                    out.append((rid, "component_cell", i, j))
        cells, media = grid or (None, None)
        for i, c in enumerate(cells or [], 1):
            if c is not None:
                out.append((rid, "grid_cell", 0, i))
        for i, m in enumerate(media or [], 1):
            if m is not None:
                at = next((k for k, c in enumerate(cells or [], 1) if c is not None and c[0] is not None and c[0] == m[0]), 0)
                out.append((rid, "media", at, i))
        for i, s in enumerate(issues or [], 1):
            if s is not None:
                out.append((rid, "issue", 0, i))
                out += [(rid, "issue_cell", i, k) for k, v in enumerate(S.values_at_key(s[0], "cells"), 1) if v is not None]
    return sorted(out)


def random_rows(n, seed):
    r = random.Random(seed)
    cell = lambda: r.choice([None, (None,), ("a",), ("b",), ("a",)])
    many = lambda f: r.choice([None, [], [f() for _ in range(r.randint(1, 4))]])
    extra = lambda: r.choice([None, "", "{", '{"cells": null}', '{"cells": ["x", null, "y"]}', '{"d": [{"cells": "z"}, {"cells": []}]}', '{"cells": NaN}'])
    grid = lambda: r.choice([None, (many(cell),)])
    return [(i % 7, "clash", many(lambda: r.choice([None, ("c", grid())])), r.choice([None, (many(cell), many(cell))]), many(lambda: r.choice([None, (extra(),)]))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_links_equal_plain_reading(spark, seed):
    rows = random_rows(120, seed)
    found = S.candidate_links(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_empty_table(spark):
    assert S.candidate_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_levels_follow_the_standard():
    column = pa.array([[{"x": [1, 2]}, None, {"x": []}], [], None, [{"x": None}, {"x": [None]}]], pa.list_(pa.struct([("x", pa.list_(pa.int32()))])))
    levels = S.shred(column, (S.EACH, "x", S.EACH))
    assert levels.repetition.tolist() == [0, 2, 1, 1, 0, 0, 0, 1]
    assert levels.definition.tolist() == [6, 6, 2, 4, 1, 0, 3, 5]


def test_rebuilt_lists_round_trip(spark):
    df = spark.createDataFrame([(1, [("a", 1), ("b", 2)]), (2, []), (3, None), (4, [("c", None)])], "record_id int, items array<struct<x:string,y:int>>")
    flat = S.flat_table(df, "record_id", "items", (S.EACH,), {"x": "string", "y": "int"})
    back = {r[0]: [tuple(v) for v in r[1]] for r in S.rebuild_lists(flat, "record_id", ["x", "y"]).collect()}
    assert back == {1: [("a", 1), ("b", 2)], 4: [("c", None)]}


def test_json_values():
    assert S.values_at_key(json.dumps({"cells": ["a", {"cells": "b"}]}), "cells") == ["a", {"cells": "b"}, "b"]
    assert S.values_at_key("[" * 100_000, "cells") == [] and S.values_at_key('{"cells": 1', "cells") == []


def test_registered_query_reads_only_leaves(spark):
    plan = p3_found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "source_table_count" not in plan.split("ReadSchema")[-1]
