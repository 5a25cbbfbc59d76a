"""Putting records together: target cascades, new sequence numbers, combined tables, addresses, slices, nearest ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolith.operators.joins import bucket_range


def leaf_targets(leaves: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (leaf_id, page, how): the page a catalog leaf points to: of a link on its own line, else of a link whose text
    has its id, else the first page that names it. `links` has leaf_id or text_id (either may be null) and page; `pages`
    has named_id and page, one row for each id that a page names, catalog pages left out.
    """
    own = links.where("leaf_id is not null").groupBy("leaf_id").agg(F.min("page").alias("_own"))
    by_text = links.where("text_id is not null").groupBy("text_id").agg(F.min("page").alias("_text"))
    named = pages.where("named_id is not null").groupBy("named_id").agg(F.min("page").alias("_named"))
    joined = leaves.select("leaf_id", "id").join(own, "leaf_id", "left").join(by_text, F.col("id") == F.col("text_id"), "left").join(named, F.col("id") == F.col("named_id"), "left")
    how = F.when(F.col("_own").isNotNull(), "link").when(F.col("_text").isNotNull(), "link_text").when(F.col("_named").isNotNull(), "page_text").otherwise("missing")
    return joined.select("leaf_id", F.coalesce("_own", "_text", "_named").alias("page"), how.alias("how"))


def add_nodes(nodes: DataFrame, incoming: DataFrame, by: str, key: str) -> DataFrame:
    """Rows (by, key, sequence, status): incoming keys matched with a node's sequence; unknown ones get the numbers after
    the highest of their document, in order of the key; keys of several nodes are ambiguous and get none.

    New keys are numbered by a window per document over the few that are new, not over its nodes.
    """
    known = nodes.groupBy(by, key).agg(F.min("sequence").alias("_seq"), F.count("*").alias("_n"))
    top = nodes.groupBy(by).agg(F.max("sequence").alias("_top"))
    joined = incoming.select(by, key).distinct().join(known, [by, key], "left")
    fresh = joined.where("_n is null").select(by, key, F.row_number().over(Window.partitionBy(by).orderBy(key)).alias("_k")).join(top, by, "left")
    new = fresh.select(by, key, (F.coalesce("_top", F.lit(0)) + F.col("_k")).cast("bigint").alias("sequence"), F.lit("new").alias("status"))
    old = joined.where("_n is not null").select(by, key, F.when(F.col("_n") == 1, F.col("_seq")).cast("bigint").alias("sequence"), F.when(F.col("_n") == 1, "matched").otherwise("ambiguous").alias("status"))
    return old.unionByName(new)


def combined_groups(tables: DataFrame, by: Sequence[str], title: Column) -> DataFrame:
    """Adds `part_of`: tables of one key whose page ranges overlap and whose titles don't contradict (equal, or one is
    empty) belong together, in order of their first page. A new group begins where the first page lies behind every page
    before, or where the title differs from the last one given.
    """
    order = Window.partitionBy(*by).orderBy("first_page", "record_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    named = tables.withColumn("_title", F.nullif(F.lower(F.btrim(title)), F.lit("")))
    apart = (F.col("first_page") > F.max("last_page").over(before)) | (F.col("_title") != F.last("_title", True).over(before))
    marked = named.withColumn("_new", F.when(F.coalesce(apart, F.lit(False)), 1).otherwise(0))
    return marked.withColumn("part_of", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_title", "_new")


def direction_addresses(groups: DataFrame, key: str) -> DataFrame:
    """Rows (key, address, scale) of each direction of axis groups: groups[i].x and groups[i].ys[j]."""
    x = groups.select(key, F.format_string("groups[%d].x", F.col("group_index").cast("int")).alias("address"), F.col("x.scale").alias("scale"))
    ys = groups.select(key, "group_index", F.posexplode("ys").alias("j", "y")).select(key, F.format_string("groups[%d].ys[%d]", F.col("group_index").cast("int"), F.col("j")).alias("address"), F.col("y.scale").alias("scale"))
    return x.unionByName(ys)


def slices(tables: DataFrame, key: str) -> DataFrame:
    """Rows (key, component, first_row, last_row, status): components cut from a table's rows by their counts; if the counts
    don't sum to the rows the table is a mismatch and is not cut. `tables` has n_rows and counts array<int>.
    """
    total = F.aggregate("counts", F.lit(0), lambda a, c: a + F.coalesce(c, F.lit(0)))
    fits = total == F.col("n_rows")
    flat = tables.where(fits).select(key, "counts", F.posexplode("counts").alias("i", "n"))
    first = F.aggregate(F.slice("counts", F.lit(1), F.col("i")), F.lit(0), lambda a, c: a + F.coalesce(c, F.lit(0)))
    cut = flat.select(key, (F.col("i") + 1).alias("component"), (first + 1).alias("first_row"), (first + F.coalesce("n", F.lit(0))).alias("last_row"), F.lit("cut").alias("status"))
    none = F.lit(None).cast("int")
    return cut.unionByName(tables.where(~F.coalesce(fits, F.lit(False))).select(key, none.alias("component"), none.alias("first_row"), none.alias("last_row"), F.lit("mismatch").alias("status")))


def nearest_tick(hints: DataFrame, ticks: DataFrame, by: Sequence[str], radius: float) -> DataFrame:
    """Rows (by, hint_id, tick_id): of the ticks within `radius` of a hint the nearest, then the least id; null without one.
    `hints` has hint_id, at; `ticks` tick_id, px. Buckets of the radius make it an equality join.
    """
    listed = ticks.select(*by, "tick_id", "px", F.explode(bucket_range(F.col("px") - radius, F.col("px") + radius, radius)).alias("_k"))
    pairs = hints.withColumn("_k", F.floor(F.col("at") / radius)).join(listed, [*by, "_k"]).where(F.abs(F.col("at") - F.col("px")) <= radius)
    best = pairs.groupBy(*by, "hint_id").agg(F.min_by("tick_id", F.struct(F.abs(F.col("at") - F.col("px")), F.col("tick_id"))).alias("tick_id"))
    return hints.select(*by, "hint_id").join(best, [*by, "hint_id"], "left")


def display_name(kind: Column, identifier: Column, title: Column) -> Column:
    """Shown name of a node: kind for tables and figures, identifier, title; parts that are empty are passed over."""
    prefix = F.when(kind.isin("table", "figure"), F.initcap(kind))
    return F.concat_ws(" ", prefix, F.nullif(identifier, F.lit("")), F.nullif(F.btrim(title), F.lit("")))
