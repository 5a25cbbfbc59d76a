"""Joins, sequences, trees, tables, edits, charts and sources on small cases."""

import json
import random
import struct
import zipfile
import zlib
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolith.operators import charts as C
from foliolith.operators import joins as J
from foliolith.operators import patches as P
from foliolith.operators import sequences as S
from foliolith.operators import tables as G
from foliolith.operators import tree as T
from foliolith.sources import archives as A
from foliolith.sources import documents as D
from foliolith.streaming import incremental as I


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = J.connected(spark.createDataFrame(edges, "a int, b int"), "a", "b")
    assert {r[0]: r[1] for r in found.collect()} == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert J.connected(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_roots_of_long_chains_and_circles(spark):
    pointers = [(i, i - 1 if i else None) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (2000, 9999), (3000, 3000)]
    found = {r[0]: (r[1], r[2]) for r in J.roots(spark.createDataFrame(pointers, "n int, p int"), "n", "p").collect()}
    assert found[299] == (0, 299) and found[0] == (0, 0) and found[1003] == (None, None) and found[2000] == (2000, 0) and found[3000] == (3000, 0)


def test_band_join(spark):
    points = spark.createDataFrame([(1, 5.0), (1, 100.0), (2, 5.0), (1, None)], "g int, v double")
    bands = spark.createDataFrame([(1, 0.0, 5.0), (1, 5.0, 4.0), (1, -500.0, 500.0), (2, None, 9.0)], "g int, lo double, hi double")
    assert rows(J.band_join(points, bands, ["g"], "v", "lo", "hi", 10.0)) == [(1, 100.0, -500.0, 500.0), (1, 5.0, -500.0, 500.0), (1, 5.0, 0.0, 5.0)]


def test_runs_and_next_fit(spark):
    pages = spark.createDataFrame([("a", p) for p in (3, 1, 2, 2, 7, 8, None, 10)], "m string, p int")
    assert rows(S.runs(pages, ["m"], "p")) == [("a", 1, 3, 3), ("a", 10, 10, 1), ("a", 7, 8, 2)]
    queue = spark.createDataFrame([("a", i, w) for i, w in enumerate([5, 4, 1, 20, 1, None])], "g string, o int, w int")
    assert [r["batch"] for r in S.next_fit(queue, "g", ["o"], {"w": 9}, 3).orderBy("o").collect()] == [1, 1, 2, 3, 4, 4]


def test_stack_keeps_its_quirk(spark):
    nodes = spark.createDataFrame([("m", i, d) for i, d in enumerate([1, 3, 3, 2, 2], 1)], "m string, s int, d int")
    assert [r[2] for r in sorted(T.hierarchy_by_stack(nodes, "m", "s", "d").collect())] == [None, 1, 2, 1, 1]
    assert [r["parent"] for r in T.hierarchy(nodes, "m", "s", "d").orderBy("s").collect()] == [None, 1, 1, 1, 1]


def test_grids():
    html = "<table><tr><th>a</th><th rowspan='2'>b</th></tr><tr><td>1<img src='x.png'></td></tr></table><table><tr><th>a</th><th>b</th></tr><tr><td colspan=2>2</table>"
    cells = [c[:6] for c in G.html_grid(html)]
    assert cells == [(1, 1, 1, 1, "a", 1), (1, 2, 2, 1, "b", 1), (2, 1, 1, 1, "1", 1), (3, 1, 1, 2, "2", 2)]
    assert G.html_grid("<td>loose") == [(1, 1, 1, 1, "loose", 1, [])] and G.html_grid("") == []


def test_association(spark):
    schema = "segment_id string, block_index int, type string, page int, last_page int, caption string, title string, top double, bottom double, width int, header string"
    table = lambda i, p, cap=None, top=100.0, bottom=400.0: ("s", i, "table", p, p, cap, None, top, bottom, 3, "a b c")
    text = lambda i, p, cap=None, title=None: ("s", i, "text", p, p, cap, title, 10.0, 90.0, None, None)
    blocks = [text(1, 1, "3.1"), table(2, 1), table(3, 1), table(4, 2, top=100.0, bottom=750.0), table(5, 3, top=80.0), text(6, 4, None, "AMS 1234"), table(7, 4), table(8, 9, "3.2")]
    found = G.associate(spark.createDataFrame(blocks, schema)).orderBy("block_index")
    assert [r["reason"] for r in found.collect()] == [G.OWN_CAPTION, G.SAME_PAGE, G.ORPHAN, G.NEXT_PAGE, G.OWN_TITLE, G.OWN_CAPTION]
    assert [r["table_key"] for r in found.collect()] == ["3.1", "3.1", "orphan 4", "orphan 4", "title AMS 1234 7", "3.2"]


def test_titles(spark):
    texts = ["AMS 1234", "ALLOY TI-6AL-4V 200", "See AMS 1", "Plain words", "", None, "A" * 130 + "1", "MIL-HDBK 5"]
    assert [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(G.standalone_title(F.col("t"))).collect()] == [True, False, False, False, False, False, False, True]


def test_operations():
    state = {"rows": [["a", "b"], ["c", "d"]], "merges": [], "metadata": {"caption": None}, "notes": []}
    for op in (
        {"op": "set_cell", "target": {"row": 1, "column": 2}, "before": "b", "after": "B"},
        {"op": "insert_row", "target": {"row": 3}, "before": None, "after": ["e", "f"]},
        {"op": "delete_row", "target": {"row": 2}, "before": ["c", "d"]},
        {"op": "insert_column", "target": {"column": 1}, "before": None, "after": ["x", "y"]},
        {"op": "delete_column", "target": {"column": 2}, "before": ["a", "e"]},
        {"op": "merge_cells", "target": {"range": "A1:B1"}, "before": False},
        {"op": "set_metadata", "target": {"field": "caption"}, "before": None, "after": "C"},
        {"op": "add_note", "after": "n"},
    ):
        P.apply_operation(state, op)
    assert state == {"rows": [["x", "B"], ["y", "f"]], "merges": ["A1:B1"], "metadata": {"caption": "C"}, "notes": ["n"]}
    for wrong in ({"op": "set_cell", "target": {"row": 9, "column": 1}}, {"op": "merge_cells", "target": {"range": "A1:B1"}, "before": False}, {"op": "unmerge_cells", "target": {"range": "A2:B2"}, "before": True}, {"op": "huh"}, {"op": "set_metadata", "target": {"field": "id"}}):
        with pytest.raises(P.EditError):
            P.apply_operation(state, wrong)


def test_merges_that_are_there_stay():
    """A stated merge that is there already is no change; cells outside their row are refused; a new grid has its own merges."""
    state = {"rows": [["a", "b"], ["c"]], "merges": ["A1:B1"], "metadata": {}, "notes": []}
    P.apply_operation(state, {"op": "merge_cells", "target": {"range": "A1:B1"}, "before": True})
    P.apply_operation(state, {"op": "unmerge_cells", "target": {"range": "A2:B2"}, "before": False})
    assert state["merges"] == ["A1:B1"] and state["rows"] == [["a", "b"], ["c"]]
    with pytest.raises(P.EditError):
        P.apply_operation(state, {"op": "set_cell", "target": {"row": 2, "column": 2}, "before": "", "after": "x"})
    P.apply_operation(state, {"op": "replace_grid", "before": {"rows": 2, "columns": 2}, "after": {"rows": [["z"]], "merges": ["A1:A1"]}})
    assert state["rows"] == [["z"]] and state["merges"] == ["A1:A1"]


def test_huge_spans_cost_nothing():
    from foliolith.operators.tables import html_grid

    cells = html_grid("<table><tr><td rowspan=999999 colspan=999999>a<td>b</tr><tr><td>c</table>")
    assert [c[:5] for c in cells] == [(1, 1, 999999, 999999, "a"), (1, 1000000, 1, 1, "b"), (2, 1000000, 1, 1, "c")]


def test_failed_patch_undoes_all(spark):
    state = json.dumps({"rows": [["a"]]})
    ops = [json.dumps({"op": "set_cell", "target": {"row": 1, "column": 1}, "before": b, "after": "z"}) for b in ("a", "a")]
    found = P.apply_patches(spark.createDataFrame([("c", state), ("d", state)], "candidate_id string, state string"), spark.createDataFrame([("c", 1, ops[0]), ("c", 2, ops[1]), ("d", 1, ops[0])], "candidate_id string, op_no int, op string"))
    got = {r["candidate_id"]: r for r in found.collect()}
    assert got["c"]["state"] == state and got["c"]["applied"] == 0 and got["c"]["error"] and json.loads(got["d"]["state"])["rows"] == [["z"]]


def test_covered_equals_brute_force(spark):
    cells = [(1, 1, 1, 2, 3), (1, 5, 1, 1, 1), (2, 2, 2, 3, 1)]
    want = sorted({(k, r + i, c + j) for k, r, c, a, b in cells for i in range(a) for j in range(b) if i or j})
    assert rows(P.covered(spark.createDataFrame(cells, "k int, row int, column int, rowspan int, colspan int"), "k")) == want


def test_reconciliation_covers_all(spark):
    box = lambda x: (float(x), 0.0, x + 10.0, 10.0)
    data = [(1, C.PDF, "a", box(0)), (2, "ocr", "a", box(1)), (3, C.PDF, "b", box(50)), (4, "ocr", "c", box(51)), (5, C.PDF, "d", box(100)), (6, "ocr", "d", box(300)), (7, C.PDF, "e", box(400)), (8, "ocr", "f", None), (9, C.PDF, None, box(500)), (10, "ocr", None, box(700)), (11, C.PDF, "g", box(800)), (12, "ocr", "g", box(801)), (13, "ocr", "g", box(802))]
    df = spark.createDataFrame([("s", *d) for d in data], "g string, id int, source string, t string, b struct<x0:double,y0:double,x1:double,y1:double>")
    found = {r["id"]: r["status"] for r in C.reconcile(df, "g", "id", "source", "t", "b").collect()}
    assert found == {1: "agreed", 2: "agreed", 3: "text_conflict", 4: "text_conflict", 5: "position_conflict", 6: "position_conflict", 7: "pdf_only", 8: "ocr_only", 9: "position_conflict", 10: "position_conflict", 11: "multiple_candidates", 12: "multiple_candidates", 13: "multiple_candidates"}


def test_two_point_fit_finds_the_widest_pair(spark):
    r = random.Random(1)
    data = [(g, r.randint(0, 3), float(r.randint(0, 9)), i) for g in range(30) for i in range(4)]
    found = {x["g"]: x for x in C.two_point_fit(spark.createDataFrame(data, "g int, v int, p double, o int"), "g", F.col("v"), F.col("p"), F.col("o"), 1.0).collect()}
    for g in range(30):
        mine = [(v, p) for k, v, p, _ in data if k == g]
        spans = [abs(a[1] - b[1]) for a in mine for b in mine if a[0] != b[0]]
        if not spans or max(spans) == 0:
            assert g not in found
        else:
            slopes = {(b[1] - a[1]) / (b[0] - a[0]) for a in mine for b in mine if a[0] != b[0] and abs(a[1] - b[1]) == max(spans)}
            assert found[g]["slope"] in slopes


def test_collinear_pieces(spark):
    pieces = [("f", 0.0, 10.0, 5.0, 1.0, 10.0), ("f", 12.0, 20.0, 6.0, 1.0, 30.0), ("f", 60.0, 70.0, 6.0, 1.0, 5.0)]
    found = C.merge_collinear(spark.createDataFrame(pieces, "f string, x0 double, x1 double, coordinate double, width double, strength double"), "f", 6.0)
    assert rows(found) == [("f", 0.0, 20.0, 5.75, 1.0, 40.0, 2), ("f", 60.0, 70.0, 6.0, 1.0, 5.0, 1)]


def test_archives(spark, tmp_path):
    A.register(spark)
    good = A.write_archive("fig", '{"a": 1}', b"png")
    assert A.read_archive(good)["image"] == b"png" and A.readable(good) and not A.readable(b"no")
    (tmp_path / "good.tar").write_bytes(good)
    (tmp_path / "bad.tar").write_bytes(good.replace(b"fig/wpd.json", b"../x/wpd.jso"))
    (tmp_path / "none.tar").write_bytes(b"")
    found = {r["name"]: r for r in spark.read.format("plot_archives").load(str(tmp_path)).collect()}
    assert found["good"]["project"] == '{"a": 1}' and found["bad"]["error"] and found["none"]["error"]
    out = tmp_path / "out"
    spark.createDataFrame([("x", "{}", bytearray(b"1"))], "name string, project string, image binary").write.format("plot_archives").mode("append").option("path", str(out)).save()
    assert [p.name for p in out.iterdir()] == ["x.tar"]


def test_workbook(spark):
    cells = spark.createDataFrame([(1, "T", 1, 1, 1, 2, "5"), (1, "T", 2, 1, 4, 1, "=x"), (1, "T", 3, 2, 1, 1, "007")], "k int, sheet string, row int, column int, rowspan int, colspan int, text string")
    data = bytes(D.workbooks(cells, "k").collect()[0]["xlsx"])
    sheet = zipfile.ZipFile(BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
    assert "<v>5</v>" in sheet and 'mergeCell ref="A1:B1"' in sheet and sheet.count("<mergeCell ") == 1 and "=x</t>" in sheet and "007</t>" in sheet


def test_walk():
    value = {"a": [{"type": "x", "in": {"type": "y"}}, [[{"type": "z"}]]], "b": 1}
    assert [b["type"] for b in D.walk_blocks(value)] == ["x", "z"]


def test_spines_of_a_picture(spark, tmp_path):
    image = np.full((120, 160), 255, np.uint8)
    image[100:102, 10:150] = 0
    image[20:102, 10:12] = 0
    for x in (50, 100):
        image[102:112, x] = 0
    raw = b"".join(b"\0" + image[i].tobytes() for i in range(120))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 160, 120, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    found = {r["orientation"]: r for r in D.image_spines(spark, str(tmp_path)).collect()}
    assert set(found) == {"horizontal", "vertical"} and abs(found["horizontal"]["coordinate"] - 100.5) < 1e-9 and found["horizontal"]["n_ticks"] >= 2


def test_page_files(spark, tmp_path):
    for name in ("page_0001.pdf", "PAGE_0003.PDF", "sub/page_0003.pdf", "page_0009.pdf", "page_12.pdf"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
    found = {r["page"]: r["status"] for r in D.page_files(spark, str(tmp_path), 3).collect()}
    assert found == {1: "ok", 2: "missing", 3: "duplicate", 9: "extra"}


def test_delivered_once(spark):
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert rows(I.deliver_once(batch, spark.createDataFrame([(2,)], "k int"), "k")) == [(1, "a")]


def test_windowed_counts_on_a_batch(spark):
    events = spark.sql("select timestamp'2026-01-01 00:10:00' as ts, 'a' as kind union all select timestamp'2026-01-01 00:50:00', 'a' union all select timestamp'2026-01-01 01:10:00', 'b'")
    assert sorted(r["n"] for r in I.windowed_counts(events, "ts", "kind").collect()) == [1, 2]


def test_tree_paths_keep_whole_numbers_and_levels(spark):
    wide = spark.createDataFrame([(0, None, "r")] + [(i, 0, "x") for i in range(1, 1235)], "n bigint, p bigint, s string")
    found = {r["n"]: r["path"] for r in T.paths(wide, "n", "p", "s").collect()}
    assert len(set(found.values())) == 1235 and [found[i] for i in (1, 2, 99, 100, 1234)] == ["r/x", "r/x__02", "r/x__99", "r/x__100", "r/x__1234"]
    deep = spark.createDataFrame([(i, i - 1 if i else None, "a", 1, i + 1) for i in range(27)], "n bigint, p bigint, s string, m int, d int")
    assert T.paths(deep, "n", "p", "s").agg({"depth": "max"}).first()[0] == 27
    assert T.budgets(deep.selectExpr("n", "p", "1 as w"), "n", "p", "w").where("n = 0").first()["budget"] == 52
    assert [r["parent"] for r in T.hierarchy(deep, "m", "n", "d").orderBy("n").collect()] == [None, *range(26)]


def test_archive_roundtrip_takes_every_project(spark):
    from foliolith.plans.io import archive_roundtrip

    found = archive_roundtrip(spark, "/root/testdata/sf0.001").collect()
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    assert sorted(r["name"] for r in found) == sorted(f"fig_{r[0]}" for r in parts.select("p_partkey").collect()) and all(r["equal"] for r in found)
