"""Queries of review rules, review states, the ledger of batches, ready tables, minted ids and ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.operators import reviews as V
from foliolith.operators.patches import broken_rules
from foliolith.plans.catalog import query
from foliolith.plans.outline import _NODES, _nodes
from foliolith.runtime import table


@query(
    "set_quality_rules",
    """
WITH c AS (SELECT record_id, candidate_id, manual, nullif(lower(trim(node_id_raw, ' ')), '') AS k, list_filter(coalesce(components, []), lambda x: x IS NOT NULL) AS parts FROM candidates),
u AS (SELECT record_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM c),
w AS (SELECT record_id FROM (SELECT record_id, list_max(list_transform(list_filter(coalesce(part.grid.rows, []), lambda r: r IS NOT NULL), lambda r: len(r))) AS width FROM u) WHERE width > 0 GROUP BY 1 HAVING count(DISTINCT width) > 1),
p AS (SELECT DISTINCT record_id FROM (SELECT record_id, page FROM (SELECT DISTINCT record_id, i, unnest(part.source_physical_pages) AS page FROM u) WHERE page IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)),
d AS (SELECT manual, k FROM c WHERE k IS NOT NULL AND candidate_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT candidate_id) > 1)
SELECT record_id, 'cross_fragment_column_mismatch' AS code FROM w UNION ALL SELECT record_id, 'same_page_multiple_components' FROM p
UNION ALL SELECT record_id, 'duplicate_identifier_candidates' FROM c JOIN d ON c.manual = d.manual AND c.k = d.k WHERE candidate_id IS NOT NULL
""",
)
def set_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.set_issues(table(spark, sf_dir, "candidates").select("record_id", "candidate_id", "manual", "node_id_raw", "components"))


@query(
    "human_review_rules",
    """
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 4 AS s, o_custkey % 3 AS b, o_orderkey % 5 AS seen, 1 + o_custkey % 4 AS pages, o_orderkey % 7 AS r, 1 + o_custkey % 2 AS c, o_orderkey % 11 = 0 AS cov, 1 + CAST(o_orderkey % 13 = 0 AS INT) AS n, o_custkey % 6 AS t FROM orders)
SELECT k, 'status' AS rule FROM r WHERE s = 3 UNION ALL SELECT k, 'base_revision' FROM r WHERE b <> 1
UNION ALL SELECT k, 'pages' FROM r WHERE seen > pages OR (s = 2 AND seen <> pages) UNION ALL SELECT k, 'address' FROM r WHERE r = 0 OR r > 5
UNION ALL SELECT k, 'covered_cell' FROM r WHERE cov UNION ALL SELECT k, 'repeated_change' FROM r WHERE n = 2
UNION ALL SELECT k, 'before' FROM r WHERE t = 0 UNION ALL SELECT k, 'no_change' FROM r WHERE t = 5
""",
)
def human_review_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pages = lambda n: F.slice(F.array(*map(F.lit, range(1, 6))), F.lit(1), n.cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("draft", "partial", "verified", "other"))), (o % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        o.alias("k"), status.alias("status"), (c % 3).alias("base_revision"), F.lit(1).alias("revision"), pages(o % 5).alias("reviewed_pages"), pages(1 + c % 4).alias("pages"),
        (o % 7).alias("row"), (1 + c % 2).alias("column"), F.lit(5).alias("n_rows"), F.lit(2).alias("n_columns"), (o % 11 == 0).alias("is_covered"), (1 + (o % 13 == 0).cast("int")).alias("n_same"),
        F.when(c % 6 == 0, "other").otherwise("text").alias("before"), F.when(c % 6 == 5, "text").otherwise("new").alias("after"), F.lit("text").alias("text"),
    )
    return broken_rules(rows, ["k"], V.review_rules())


@query(
    "review_states",
    """
WITH t AS (SELECT candidate_id, max(revision) AS revision FROM candidates WHERE candidate_id IS NOT NULL GROUP BY 1), r AS (SELECT candidate_id, max(base_revision) AS base, CASE WHEN min(weight) % 2 = 0 THEN 'verified' ELSE 'draft' END AS status FROM plan_luna_batches WHERE candidate_id IS NOT NULL GROUP BY 1)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN r.status IS NULL THEN 'unreviewed' WHEN base IS NOT DISTINCT FROM revision THEN r.status ELSE 'stale' END AS state FROM t LEFT JOIN r ON r.candidate_id = t.candidate_id) GROUP BY 1
""",
)
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = table(spark, sf_dir, "candidates").where("candidate_id is not null").groupBy("candidate_id").agg(F.max("revision").alias("revision"))
    status = F.when(F.min("weight") % 2 == 0, "verified").otherwise("draft")
    reviews = table(spark, sf_dir, "plan_luna_batches").where("candidate_id is not null").groupBy("candidate_id").agg(F.max("base_revision").alias("base_revision"), status.alias("status"))
    return V.review_states(tables, reviews, "candidate_id").groupBy("state").agg(F.count("*").alias("n"))


@query(
    "batch_ledger",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'pending' WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'unchanged' WHEN o_orderkey % 3 = 0 THEN 'changed' WHEN o_custkey % 4 = 1 THEN 'ready' ELSE 'stale' END AS outcome FROM orders
""",
)
def batch_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    reports = orders.where(o % 5 != 0).select(o, (c % 4).alias("base_revision"), F.concat(F.lit("d"), c % 2).alias("digest"))
    applied = orders.where(o % 3 == 0).select(o, F.lit("d0").alias("digest"))
    return V.batch_ledger(orders.select(o, F.lit(1).alias("revision")), reports, applied, "o_orderkey")


@query(
    "ready_tables",
    """
WITH t AS (SELECT record_id, manual, node_id_raw, coalesce(data_status, 'review_required') = 'review_required' AS needs FROM candidates)
SELECT record_id FROM t WHERE NOT needs AND NOT EXISTS (SELECT 1 FROM t u WHERE u.needs AND u.manual = t.manual AND u.node_id_raw = t.node_id_raw)
""",
)
def ready_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = F.coalesce("data_status", F.lit("review_required")) == "review_required"
    return V.ready_tables(table(spark, sf_dir, "candidates").select("record_id", "manual", "node_id_raw", needs.alias("needs_review")), "manual", "node_id_raw").select("record_id")


@query(
    "minted_ids",
    """
SELECT block_id, CASE WHEN page_idx IS NOT NULL THEN printf('unnumbered-p%04d-%02d', page_idx + 1, row_number() OVER (PARTITION BY segment_id, page_idx ORDER BY block_id)) END AS synthetic_id FROM ocr_blocks WHERE type = 'table'
""",
)
def minted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "ocr_blocks").where("type = 'table'").select("block_id", "segment_id", (F.col("page_idx") + 1).alias("page"))
    return V.minted_ids(blocks, "segment_id", "page", "block_id").select("block_id", "synthetic_id")


@query(
    "node_ancestors",
    f"""
WITH RECURSIVE n AS ({_NODES}), a AS (SELECT node, parent AS ancestor, 1 AS distance FROM n WHERE parent IS NOT NULL UNION ALL SELECT a.node, n.parent, a.distance + 1 FROM a JOIN n ON n.node = a.ancestor WHERE n.parent IS NOT NULL)
SELECT CAST(node AS BIGINT) AS node, CAST(ancestor AS BIGINT) AS ancestor, CAST(distance AS INT) AS distance FROM a
""",
)
def node_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ancestors(_nodes(spark, sf_dir), "node", "parent")


