"""Comparison of copies and its bitmaps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolith.operators import compare as C

SCHEMA = "k string, v string, p array<int>, revision int, id int, side string"


@pytest.mark.parametrize("n", [0, 1, 50, 5000, 60000])
def test_bitmaps(n):
    r = np.random.default_rng(n)
    a, b = (np.unique(r.integers(0, 200_000, n)) for _ in range(2))
    x, y = C.PresenceBitmap(a), C.PresenceBitmap(b)
    assert (x & y).ordinals().tolist() == np.intersect1d(a, b).tolist()
    assert (x - y).ordinals().tolist() == np.setdiff1d(a, b).tolist()


def run(spark, left, right):
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    fields = {"v": C.same_text(F.col("v")), "p": C.same_pages(F.col("p"))}
    found = C.differences(a, b, F.lower(C.trimmed(F.col("k"))), {"left": ["revision", "id"], "right": ["revision", "id"]}, fields, ("no_right", "no_left"), "k")
    return sorted(map(tuple, found.collect()))


def test_cases(spark):
    left = [(" A\t", "x ", [2, 1, 1], 1, 1, "s"), ("b", None, None, 1, 2, None), ("c", "old", [], 1, 3, ""), ("c", "new", [], 2, 4, ""), (None, "x", [], 1, 5, ""), ("d", "1", None, None, 6, ""), ("e", "", [], 1, 7, "")]
    right = [("a", "　x", [1, 2], 9, 1, "s"), ("b", "", [None], 1, 2, None), ("c", "new", None, 2, 3, ""), ("f", "x", [], 1, 4, ""), ("e", None, [], 1, 5, ""), ("e", "", [], 1, 6, "")]
    assert run(spark, left, right) == [("b", "v"), ("d", "no_right"), ("f", "no_left")]


def test_empty_sides(spark):
    row = [("a", "x", [], 1, 1, "")]
    assert run(spark, [], []) == []
    assert run(spark, row, []) == [("a", "no_right")]
    assert run(spark, [], row * 3) == [("a", "no_left")]


def test_against_dictionaries(spark):
    r = random.Random(4)
    make = lambda: [(r.choice(["k%d" % i for i in range(40)]), r.choice("xyz"), [r.randint(1, 3)], r.randint(1, 3), i, "") for i in range(80)]
    left, right = make(), make()
    best = lambda rows: {k: row for k, row in ((x[0], x) for x in sorted(rows, key=lambda x: (x[3], x[4])))}
    a, b = best(left), best(right)
    want = [(k, "no_right") for k in a.keys() - b.keys()] + [(k, "no_left") for k in b.keys() - a.keys()]
    want += [(k, f) for k in a.keys() & b.keys() for f, i in (("v", 1), ("p", 2)) if a[k][i] != b[k][i]]
    assert run(spark, left, right) == sorted(want)
