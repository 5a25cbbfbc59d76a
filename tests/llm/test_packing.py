"""Packing: capacity, wholeness, bounds, ties and empty input."""

import itertools
import random

import numpy as np
import pytest

from foliolith.llm import packing as P


def optimum(sizes, caps):
    """Least number of containers, by trying all assignments of a few items."""
    for k in range(1, len(sizes) + 1):
        for assign in itertools.product(range(k), repeat=len(sizes)):
            load = np.zeros((k, len(caps)), int)
            for s, a in zip(sizes, assign, strict=True):
                load[a] += s
            if (load <= caps).all():
                return k
    return 0


@pytest.mark.parametrize("seed", range(12))
def test_bound_and_packing(seed):
    r = random.Random(seed)
    sizes = np.array([[r.randint(0, 9), r.randint(0, 20), 1] for _ in range(r.randint(1, 7))])
    caps = (9, 20, 4)
    of, load, bound = P.pack(sizes, caps)
    best = optimum(sizes, np.array(caps))
    assert bound <= best <= len(load) and (load <= caps).all()
    assert (np.array([sizes[of == i].sum(axis=0) for i in range(len(load))]) == load).all()


QUEUE = "queue_id bigint, run_id string, candidate_id string, base_revision int, source_physical_pages array<int>, cell_count int, weight int, queued_at timestamp, item string, part int"


def queue(spark, rows):
    return spark.createDataFrame([(i, *row, None, "clash", 7) for i, row in enumerate(rows)], QUEUE)


def test_cases(spark):
    rows = [("r", "a", 1, [1], 10, 30), ("r", "a", 2, None, 10, 3), ("r", "b", None, [], 1200, 1), (None, "c", 1, list(range(45)), None, None), ("r", None, 1, None, 1, 1), ("r", None, 1, None, 1, 1), ("r", "a", 2, None, 10, 3), ("s", "d", 1, [1], -5, 10)]
    found = P.review_batches(queue(spark, rows)).collect()
    load = {}
    for x in found:
        w, c, p, n = load.get(x["batch"], (0, 0, 0, 0))
        load[x["batch"]] = (w + x["weight"], c + x["cell_count"], p + x["pages"], n + 1)
    assert all(w <= 9 and c <= 500 and p <= 20 and n <= 10 for w, c, p, n in load.values())
    assert {x["candidate_id"] for x in found} == {"a", "b", "c", "d", None} and sum(x["candidate_id"] is None for x in found) == 2
    assert sorted(x["pieces"] for x in found if x["candidate_id"] == "b") == [3, 3, 3] and sum(x["cell_count"] for x in found if x["candidate_id"] == "b") == 1200
    assert [x["weight"] for x in found if x["candidate_id"] == "a"] == [3]
    assert sorted(r[0] for r in P.oversize(P.review_batches(queue(spark, rows))).collect()) == ["b", "c", "d"]


def test_empty(spark):
    assert P.review_batches(queue(spark, [])).count() == 0
    assert P.certificates(P.review_batches(queue(spark, []))).count() == 0


def test_large_run_is_split_and_repacked(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_ITEMS", 40)
    r = random.Random(5)
    rows = [("hot" if i % 3 else f"r{i % 5}", f"c{i}", 1, [1], r.randint(1, 200), r.randint(1, 6)) for i in range(400)]
    batches = P.review_batches(queue(spark, rows)).cache()
    assert batches.count() == 400 and batches.select("candidate_id").distinct().count() == 400
    for c in P.certificates(batches).collect():
        assert c["lower_bound"] <= c["batches"] <= c["lower_bound"] * 1.08 + 1
    assert batches.groupBy("batch").agg({"run_id": "min"}).count() == batches.select("batch", "run_id").distinct().count()


def test_rounds_end_and_hold_every_item(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_ITEMS", 7)
    items = spark.createDataFrame([(f"g{i % 2}", str(i), 1 + i * 7 % 9) for i in range(150)], "g string, item string, w int")
    rows = P.packed(items, "g", ["w"], [10], 10).collect()
    loads = {}
    for r in rows:
        loads[r["g"], r["batch"]] = loads.get((r["g"], r["batch"]), 0) + r["w"]
    assert len(rows) == 150 == len({r["item"] for r in rows}) and max(loads.values()) <= 10
    assert len(loads) <= sum(1 + i * 7 % 9 for i in range(150)) / 10 * 1.25
