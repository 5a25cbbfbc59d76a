"""Keyed, prefix, as-of, spatial and recursive joins that never guess and never fall back to all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolith.runtime import cut


def unambiguous_match(left: DataFrame, right: DataFrame, key: str, raw_left: str, raw_right: str, left_id: str, right_id: str) -> DataFrame:
    """Rows (left_id, right_id, status) for every left row: partners share `key`; of several the only one whose raw form is
    equal but for case; else the sole partner; else none.

    status: exact, sole, ambiguous or missing. Null keys are missing. Both sides meet once on the key; the choice is two
    aggregates, so a key with many partners costs its rows, not their product with a sort.
    """
    r = right.where(F.col(key).isNotNull()).select(F.col(key), F.col(right_id), F.lower(raw_right).alias("_raw"))
    per_key = r.groupBy(key).agg(F.count("*").alias("_n"), F.min(right_id).alias("_any"))
    per_raw = r.groupBy(key, "_raw").agg(F.count("*").alias("_m"), F.min(right_id).alias("_one"))
    rows = left.select(left_id, key, F.lower(raw_left).alias("_raw"))
    joined = rows.join(per_key, key, "left").join(per_raw, [key, "_raw"], "left")
    exact = F.coalesce(F.col("_m") == 1, F.lit(False))
    sole = F.coalesce(F.col("_n") == 1, F.lit(False))
    return joined.select(
        left_id,
        F.when(exact, F.col("_one")).when(sole, F.col("_any")).alias(right_id),
        F.when(exact, "exact").when(sole, "sole").when(F.col("_n") > 1, "ambiguous").otherwise("missing").alias("status"),
    )


def prefixes(core: Column) -> Column:
    """Proper dotted prefixes of an identifier, longest first."""
    parts = F.split(core, "\\.")
    return F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def longest_prefix_parent(children: DataFrame, sections: DataFrame, child_id: str, core: str, section_core: str, section_id: str, sequence: str) -> DataFrame:
    """Rows (child_id, section_id): the section whose core is the longest proper prefix of the child's; of equal ones the
    last by sequence; null if there is none. Prefixes are exploded, so the join is on equality.
    """
    exploded = children.where(F.contains(core, F.lit("."))).select(child_id, F.explode(prefixes(F.col(core))).alias("_prefix"))
    best = sections.groupBy(F.col(section_core).alias("_prefix")).agg(F.max_by(section_id, F.struct(sequence, section_id)).alias(section_id))
    found = exploded.join(best, "_prefix").groupBy(child_id).agg(F.max_by(section_id, F.length("_prefix")).alias(section_id))
    return children.select(child_id).join(found, child_id, "left")


def last_before(rows: DataFrame, by: Sequence[str], order: Sequence[str], marks: Column, value: Column, name: str) -> DataFrame:
    """Backward as-of: for every row the value of the last earlier row with the mark, by one window."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(marks, value), True).over(w))


def complete(required: DataFrame, present: DataFrame, group: str, item: str) -> DataFrame:
    """Relational division, rows (group, n_required, n_present, complete): groups for which every required item is there."""
    need, have = required.select(group, item).distinct(), present.select(group, item).distinct().withColumn("_there", F.lit(1))
    return need.join(have, [group, item], "left").groupBy(group).agg(F.count("*").alias("n_required"), F.count("_there").alias("n_present"), (F.count("*") == F.count("_there")).alias("complete"))


def upsert(base: DataFrame, delta: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """`base` with the rows of `delta` in place of equal keys and after them; nulls in delta keep the base's value."""
    b = base.select(key, *(F.col(c).alias(f"_b_{c}") for c in columns))
    d = delta.select(key, *(F.col(c).alias(f"_d_{c}") for c in columns), F.lit(1).alias("_d"))
    return b.join(d, key, "full").select(key, *(F.coalesce(f"_d_{c}", f"_b_{c}").alias(c) for c in columns), F.coalesce(F.col("_d") == 1, F.lit(False)).alias("changed"))


def roots(pointers: DataFrame, node: str, parent: str) -> DataFrame:
    """Rows (node, root, hops): the end of each chain of pointers; null root where it runs in a circle.

    Pointer doubling: each round joins the moving nodes with the table before, so their reach doubles and chains of any
    length end in a logarithmic number of rounds. Nodes that have arrived are set aside and not written again; lineage is
    cut by reliable checkpoints. A node without a pointer, or one that points to itself or to nothing known, is a root.
    If in a round no node arrives, none can: of a chain that ends, the node just beyond the reach would have. What still
    moves then is in a circle, or leads to one.
    """
    rows = pointers.groupBy(F.col(node).alias("node")).agg(F.max(parent).alias("up"))
    known = rows.select(F.col("node").alias("k"))
    rows = rows.join(known, F.col("up") == F.col("k"), "left").select("node", F.when(F.col("k") == F.col("node"), None).otherwise(F.col("k")).alias("up"))
    state = cut(rows.select("node", F.coalesce("up", "node").alias("at"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("hops"), F.col("up").isNull().alias("done")))
    arrived = state.where("done")
    moving, target = state.where("not done"), state
    before, left = None, moving.count()
    while left and left != before:
        there = target.select(F.col("node").alias("n2"), F.col("at").alias("at2"), F.col("hops").alias("h2"), F.col("done").alias("d2"))
        stepped = cut(moving.join(there, F.col("at") == F.col("n2")).select("node", F.col("at2").alias("at"), (F.col("hops") + F.col("h2")).alias("hops"), F.col("d2").alias("done")))
        arrived = arrived.unionByName(stepped.where("done"))
        moving = stepped.where("not done")
        # Moving nodes point to moving ones of the same reach, or to arrived ones.
        target = moving.unionByName(arrived)
        before, left = left, moving.count()
    circles = moving.select("node", F.lit(None).cast(rows.schema["node"].dataType).alias("at"), F.lit(None).cast("bigint").alias("hops"))
    return arrived.select("node", "at", "hops").unionByName(circles).select(F.col("node").alias(node), F.col("at").alias("root"), "hops")


def bucket_range(low: Column, high: Column, size: float) -> Column:
    """Numbers of the buckets of width `size` that a closed interval touches."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def band_join(points: DataFrame, bands: DataFrame, on: Sequence[str], value: str, low: str, high: str, size: float) -> DataFrame:
    """Inner join of points with the closed bands that hold them, by buckets: an equality join with a residual test.

    A band is listed in each bucket it touches, a point in one, so no pair repeats. Empty or null bands match nothing.
    """
    p = points.withColumn("_bucket", F.floor(F.col(value) / size))
    b = bands.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(bucket_range(F.col(low), F.col(high), size)))
    return p.join(b, [*on, "_bucket"]).where(F.col(value).between(F.col(low), F.col(high))).drop("_bucket")


def boxes_meet(a: str, b: str) -> Column:
    """Whether two boxes (structs x0, y0, x1, y1), borders included, meet."""
    return (F.col(f"{a}.x0") <= F.col(f"{b}.x1")) & (F.col(f"{b}.x0") <= F.col(f"{a}.x1")) & (F.col(f"{a}.y0") <= F.col(f"{b}.y1")) & (F.col(f"{b}.y0") <= F.col(f"{a}.y1"))


def center(box: str) -> tuple[Column, Column]:
    """Center of a box."""
    return (F.col(f"{box}.x0") + F.col(f"{box}.x1")) / 2, (F.col(f"{box}.y0") + F.col(f"{box}.y1")) / 2


def inside(x: Column, y: Column, box: str) -> Column:
    """Whether a point lies in a box, borders included."""
    return x.between(F.col(f"{box}.x0"), F.col(f"{box}.x1")) & y.between(F.col(f"{box}.y0"), F.col(f"{box}.y1"))


def mutual_centers(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str, left_box: str, right_box: str, tile: float = 64.0) -> DataFrame:
    """Pairs (group, left_id, right_id) of boxes that hold each other's center.

    The left box's center lies in one tile, the right box is listed in those it touches: the join is on (group, tile), so
    no pair repeats and dense groups split over their tiles. Null and reversed boxes match nothing.
    """
    x, y = center("_a")
    points = left.select(group, left_id, F.col(left_box).alias("_a")).withColumn("_tx", F.floor(x / tile)).withColumn("_ty", F.floor(y / tile))
    boxes = right.select(group, right_id, F.col(right_box).alias("_b")).where("_b.x0 <= _b.x1 and _b.y0 <= _b.y1")
    for t, lo, hi in (("_tx", "x0", "x1"), ("_ty", "y0", "y1")):
        boxes = boxes.withColumn(t, F.explode(bucket_range(F.col(f"_b.{lo}"), F.col(f"_b.{hi}"), tile)))
    pairs = points.join(boxes, [group, "_tx", "_ty"]).where(inside(*center("_a"), "_b") & inside(*center("_b"), "_a"))
    return pairs.select(group, left_id, right_id)


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component): the least node that each node is linked with, over any number of links.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until nothing changes: a logarithmic number of
    shuffles with reliable checkpoints; neither neighbours nor components are ever gathered in one place.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    links = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        links = cut(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return nodes.join(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
