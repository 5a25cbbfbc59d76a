"""Queries of target cascades, sequence numbers, combined tables, addresses, slices and nearest ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.operators import assembly as A
from foliolith.plans.catalog import query
from foliolith.runtime import table


@query(
    "leaf_targets",
    """
WITH l AS (SELECT c_custkey AS leaf_id, 'id' || c_custkey % 900 AS id FROM customer), k AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS leaf_id, CASE WHEN o_orderkey % 4 = 1 THEN 'id' || o_custkey % 400 END AS text_id, o_orderkey % 500 AS page FROM orders),
p AS (SELECT 'id' || p_partkey % 800 AS named_id, p_size AS page FROM part),
o AS (SELECT leaf_id, min(page) AS a FROM k WHERE leaf_id IS NOT NULL GROUP BY 1), t AS (SELECT text_id, min(page) AS b FROM k WHERE text_id IS NOT NULL GROUP BY 1), n AS (SELECT named_id, min(page) AS c FROM p GROUP BY 1)
SELECT l.leaf_id, coalesce(a, b, c) AS page, CASE WHEN a IS NOT NULL THEN 'link' WHEN b IS NOT NULL THEN 'link_text' WHEN c IS NOT NULL THEN 'page_text' ELSE 'missing' END AS how FROM l LEFT JOIN o ON o.leaf_id = l.leaf_id LEFT JOIN t ON text_id = id LEFT JOIN n ON named_id = id
""",
)
def leaf_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda c: F.concat(F.lit("id"), c)
    o = F.col("o_orderkey")
    leaves = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("leaf_id"), named(F.col("c_custkey") % 900).alias("id"))
    links = table(spark, sf_dir, "orders").select(F.when(o % 4 == 0, F.col("o_custkey")).alias("leaf_id"), F.when(o % 4 == 1, named(F.col("o_custkey") % 400)).alias("text_id"), (o % 500).alias("page"))
    pages = table(spark, sf_dir, "part").select(named(F.col("p_partkey") % 800).alias("named_id"), F.col("p_size").cast("bigint").alias("page"))
    return A.leaf_targets(leaves, links, pages)


@query(
    "added_nodes",
    """
WITH n AS (SELECT c_nationkey AS doc, 'k' || c_custkey % 50 AS key, c_custkey AS sequence FROM customer), i AS (SELECT DISTINCT s_nationkey AS doc, 'k' || s_suppkey % 90 AS key FROM supplier),
k AS (SELECT doc, key, min(sequence) AS seq, count(*) AS n FROM n GROUP BY 1, 2), t AS (SELECT doc, max(sequence) AS top FROM n GROUP BY 1), j AS (SELECT i.doc, i.key, k.seq, k.n FROM i LEFT JOIN k ON k.doc = i.doc AND k.key = i.key)
SELECT doc, key, CASE WHEN n = 1 THEN seq END AS sequence, CASE WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM j WHERE n IS NOT NULL
UNION ALL SELECT j.doc, j.key, coalesce(top, 0) + row_number() OVER (PARTITION BY j.doc ORDER BY j.key), 'new' FROM j LEFT JOIN t ON t.doc = j.doc WHERE n IS NULL
""",
)
def added_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), F.concat(F.lit("k"), F.col("c_custkey") % 50).alias("key"), F.col("c_custkey").alias("sequence"))
    incoming = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc"), F.concat(F.lit("k"), F.col("s_suppkey") % 90).alias("key"))
    return A.add_nodes(nodes, incoming, "doc", "key")


@query(
    "combined_groups",
    """
WITH c AS (SELECT record_id, manual, split_part(node_id_raw, '.', 1) AS k, list_min(source_physical_pages) AS first_page, list_max(source_physical_pages) AS last_page, nullif(lower(trim(caption, ' ')), '') AS t FROM candidates WHERE node_id_raw IS NOT NULL AND list_max(source_physical_pages) IS NOT NULL),
m AS (SELECT *, max(last_page) OVER w AS reach, last_value(t IGNORE NULLS) OVER w AS prev FROM c WINDOW w AS (PARTITION BY manual, k ORDER BY first_page, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT record_id, CAST(sum(CASE WHEN coalesce(first_page > reach, false) OR coalesce(t <> prev, false) THEN 1 ELSE 0 END) OVER (PARTITION BY manual, k ORDER BY first_page, record_id ROWS UNBOUNDED PRECEDING) AS INT) AS part_of FROM m
""",
)
def combined_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "candidates").where("node_id_raw is not null").select("record_id", "manual", F.split_part("node_id_raw", F.lit("."), F.lit(1)).alias("k"), F.array_min("source_physical_pages").alias("first_page"), F.array_max("source_physical_pages").alias("last_page"), "caption")
    return A.combined_groups(rows.where("last_page is not null"), ["manual", "k"], F.col("caption")).select("record_id", "part_of")


@query(
    "direction_addresses",
    """
SELECT r_regionkey AS region, printf('groups[%d].x', r_regionkey) AS address, 'linear' AS scale FROM region
UNION ALL SELECT n_regionkey, printf('groups[%d].ys[%d]', n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT)), CASE WHEN n_nationkey % 2 = 0 THEN 'log' ELSE 'linear' END FROM nation
""",
)
def direction_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.struct("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "log").otherwise("linear").alias("scale"))
    groups = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(y)).alias("ys"))
    return A.direction_addresses(groups.withColumn("group_index", F.col("region")).withColumn("x", F.struct(F.lit("linear").alias("scale"))), "region")


@query(
    "component_slices",
    """
WITH c AS (SELECT record_id, coalesce(len(grid.rows), 0) AS n_rows, list_transform(coalesce(components, []), lambda c: coalesce(len(c.grid.rows), 0)) AS counts FROM candidates), f AS (SELECT *, coalesce(list_sum(counts), 0) = n_rows AS fits FROM c),
u AS (SELECT record_id, unnest(counts) AS n, generate_subscripts(counts, 1) AS i, counts FROM f WHERE fits)
SELECT record_id, CAST(i AS INT) AS component, CAST(coalesce(list_sum(counts[1:i - 1]), 0) + 1 AS INT) AS first_row, CAST(coalesce(list_sum(counts[1:i - 1]), 0) + n AS INT) AS last_row, 'cut' AS status FROM u UNION ALL SELECT record_id, NULL, NULL, NULL, 'mismatch' FROM f WHERE NOT fits
""",
)
def component_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "record_id bigint, components array<struct<grid:struct<rows:array<array<string>>>>>, grid struct<rows:array<array<string>>>"
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    counts = F.coalesce(F.transform("components", lambda c: n(c["grid"]["rows"])), F.array().cast("array<int>"))
    return A.slices(table(spark, sf_dir, "candidates", schema).select("record_id", n("grid.rows").alias("n_rows"), counts.alias("counts")), "record_id")


@query(
    "nearest_ticks",
    """
WITH h AS (SELECT p_brand AS axis, p_partkey AS hint_id, CAST(p_partkey % 997 AS DOUBLE) AS px FROM part WHERE p_partkey % 2 = 0), t AS (SELECT p_brand AS axis, p_partkey AS tick_id, (p_partkey * 7) % 1009 * 1.0 AS px FROM part WHERE p_partkey % 2 = 1),
m AS (SELECT h.axis, hint_id, tick_id, row_number() OVER (PARTITION BY h.axis, hint_id ORDER BY abs(h.px - t.px), tick_id) AS rn FROM h JOIN t ON h.axis = t.axis AND abs(h.px - t.px) <= 12)
SELECT h.axis, h.hint_id, m.tick_id FROM h LEFT JOIN m ON m.axis = h.axis AND m.hint_id = h.hint_id AND rn = 1
""",
)
def nearest_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    hints = part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("axis"), k.alias("hint_id"), (k % 997).cast("double").alias("at"))
    ticks = part.where("p_partkey % 2 = 1").select(F.col("p_brand").alias("axis"), k.alias("tick_id"), ((k * 7) % 1009).cast("double").alias("px"))
    return A.nearest_tick(hints, ticks, ["axis"], 12.0)
