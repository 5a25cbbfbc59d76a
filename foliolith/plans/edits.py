"""Queries of grid edits and review rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolith.operators import patches as P
from foliolith.plans.catalog import query
from foliolith.runtime import table

_CELLS = """SELECT l_orderkey AS grid_id, row, c AS "column", CASE WHEN c = 1 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS text
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS row FROM lineitem), (VALUES (1), (2)) v(c)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grid_id"), F.row_number().over(w).alias("row"), F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")).alias("t"))
    return rows.select("grid_id", "row", F.posexplode("t").alias("c", "text")).select("grid_id", "row", (F.col("c") + 1).alias("column"), "text")


@query(
    "patch_set_cell",
    f"""
WITH c AS ({_CELLS}) SELECT grid_id, row, "column", CASE WHEN "column" = 1 AND row = 1 AND grid_id % 3 = 0 THEN text || '!' ELSE text END AS text,
CASE WHEN "column" = 1 AND row = 1 AND grid_id % 3 = 0 THEN 'applied' WHEN "column" = 1 AND row = 1 AND grid_id % 3 = 1 THEN 'stale' ELSE 'none' END AS status FROM c
""",
)
def patch_set_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    first = cells.where("row = 1 and column = 1 and grid_id % 3 < 2")
    patches = first.select("grid_id", "row", "column", F.when(F.col("grid_id") % 3 == 0, F.col("text")).otherwise("other").alias("before"), F.concat("text", F.lit("!")).alias("after"))
    return P.set_cells(cells, patches)


@query(
    "patch_insert_row",
    f"""
WITH c AS ({_CELLS}), e AS (SELECT DISTINCT l_orderkey AS g FROM lineitem WHERE l_orderkey % 4 = 0)
SELECT grid_id, CASE WHEN g IS NOT NULL AND row >= 2 THEN row + 1 ELSE row END AS row, "column", text FROM c LEFT JOIN e ON g = grid_id UNION ALL SELECT g, 2, v, '' FROM e, (VALUES (1), (2)) x(v)
""",
)
def patch_insert_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 0").select(F.col("l_orderkey").alias("grid_id"), F.lit(2).alias("at")).distinct()
    return P.insert_line(_cells(spark, sf_dir), edits, "row")


@query(
    "patch_delete_column",
    f'WITH c AS ({_CELLS}) SELECT grid_id, row, CASE WHEN grid_id % 4 = 1 THEN "column" - 1 ELSE "column" END AS "column", text FROM c WHERE NOT (grid_id % 4 = 1 AND "column" = 1)',
)
def patch_delete_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 1").select(F.col("l_orderkey").alias("grid_id"), F.lit(1).alias("at")).distinct()
    return P.delete_line(_cells(spark, sf_dir), edits, "column")


@query(
    "covered_cells",
    """
WITH c AS (SELECT record_id, unnest(grid.cells) AS cell FROM candidates), w AS (SELECT record_id, cell.row AS r, cell."column" AS k, unnest(range(CAST(cell.row AS BIGINT), CAST(cell.row + cell.rowspan AS BIGINT))) AS row, cell."column" AS c0, cell.colspan AS cs FROM c WHERE cell.rowspan > 1 OR cell.colspan > 1),
x AS (SELECT record_id, r, k, row, unnest(range(CAST(c0 AS BIGINT), CAST(c0 + cs AS BIGINT))) AS "column" FROM w)
SELECT DISTINCT record_id, CAST(row AS INT) AS row, CAST("column" AS INT) AS "column" FROM x WHERE row <> r OR "column" <> k
""",
)
def covered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "candidates", "record_id bigint, grid struct<cells:array<struct<row:int,column:int,rowspan:int,colspan:int>>>").select("record_id", F.inline("grid.cells"))
    return P.covered(cells, "record_id")


@query(
    "component_offsets",
    """
WITH c AS (SELECT record_id, unnest(components) AS c, generate_subscripts(components, 1) AS pos FROM candidates), n AS (SELECT record_id, pos, len(coalesce(c.grid.rows, [])) AS n_rows FROM c WHERE c IS NOT NULL)
SELECT record_id, CAST(pos AS INT) AS pos, CAST(n_rows AS INT) AS n_rows, CAST(coalesce(sum(n_rows) OVER (PARTITION BY record_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM n
""",
)
def component_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "candidates", "record_id bigint, components array<struct<grid:struct<rows:array<array<string>>>>>")
    flat = rows.select("record_id", F.posexplode("components").alias("p", "c")).where("c is not null")
    sized = flat.select("record_id", (F.col("p") + 1).alias("pos"), F.greatest(F.coalesce(F.size("c.grid.rows"), F.lit(0)), F.lit(0)).alias("n_rows"))
    return P.offsets(sized, "record_id", "pos", "n_rows").withColumn("offset", F.col("offset").cast("bigint"))


@query("patched_candidates")
def patched_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "candidates").where("candidate_id is not null and grid.rows is not null").select(F.concat_ws("#", "candidate_id", "record_id").alias("candidate_id"), "caption", F.col("grid.rows").alias("rows"))
    state = F.to_json(F.struct("rows", F.array().cast("array<string>").alias("merges"), F.struct("caption").alias("metadata"), F.array().cast("array<string>").alias("notes")), {"ignoreNullFields": "false"})
    first = F.get(F.get("rows", F.lit(0)), F.lit(0))
    set_op = F.to_json(F.struct(F.lit("set_cell").alias("op"), F.struct(F.lit(1).alias("row"), F.lit(1).alias("column")).alias("target"), first.alias("before"), F.lit("checked").alias("after")), {"ignoreNullFields": "false"})
    note_op = F.to_json(F.struct(F.lit("add_note").alias("op"), F.lit("read again").alias("after")))
    candidates = rows.select("candidate_id", state.alias("state"))
    patches = rows.where(first.isNotNull()).select("candidate_id", F.posexplode(F.array(set_op, note_op)).alias("op_no", "op"))
    return P.apply_patches(candidates, patches)


@query(
    "review_valid",
    """
WITH p AS (SELECT o_orderkey, o_orderkey % 4 AS d, o_orderkey % 3 AS n_ops, o_orderkey % 2 AS n_open, o_orderkey % 5 AS pages, o_custkey % 5 AS want FROM orders)
SELECT o_orderkey, 'decision' AS rule FROM p WHERE d = 3
UNION ALL SELECT o_orderkey, 'accepted_without_operations' FROM p WHERE d = 0 AND (n_ops > 0 OR n_open > 0)
UNION ALL SELECT o_orderkey, 'patched_with_operations' FROM p WHERE d = 1 AND n_ops = 0
UNION ALL SELECT o_orderkey, 'partial_with_unresolved' FROM p WHERE (d = 2) <> (n_open > 0)
UNION ALL SELECT o_orderkey, 'page_coverage' FROM p WHERE pages <> want
UNION ALL SELECT o_orderkey, 'unique_operations' FROM p WHERE n_ops = 2
UNION ALL SELECT o_orderkey, 'evidence_pages' FROM p WHERE n_ops > 0 AND want < 1
""",
)
def review_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    op = F.struct(F.lit("op1").alias("op_id"), F.lit("high").alias("confidence"), F.array(F.lit(2)).alias("pages"))
    pages = lambda n: F.sequence(F.lit(1), (n + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        o,
        F.lit(1).alias("schema_version"),
        F.lit("2.0").alias("contract_version"),
        o.alias("candidate_id"),
        o.alias("c_candidate_id"),
        F.element_at(F.array(*map(F.lit, ("accept", "patch", "partial", "other"))), (o % 4 + 1).cast("int")).alias("decision"),
        F.array_repeat(op, (o % 3).cast("int")).alias("operations"),
        F.array_repeat(F.lit("x"), (o % 2).cast("int")).alias("unresolved"),
        pages(o % 5).alias("reviewed_source_pages"),
        F.when(c % 5 < 1, F.array(F.lit(1))).otherwise(pages(c % 5)).alias("c_pages"),
        F.array(F.lit("a"), F.lit("b")).alias("resolved_codes"),
        F.array(F.lit("b"), F.lit("a")).alias("c_issue_codes"),
    )
    return P.broken_rules(rows, ["o_orderkey"], P.patch_rules())


@query(
    "set_coverage",
    "SELECT coalesce(a.run_id, b.run_id) AS run_id, a.run_id IS NOT NULL AS assigned, b.run_id IS NOT NULL AS reported FROM (SELECT DISTINCT run_id FROM plan_luna_batches WHERE weight > 5) a FULL JOIN (SELECT DISTINCT run_id FROM plan_luna_batches WHERE cell_count > 60) b ON a.run_id = b.run_id",
)
def set_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "plan_luna_batches")
    a = queue.where("weight > 5").select("run_id").distinct().withColumn("a", F.lit(True))
    b = queue.where("cell_count > 60").select("run_id").distinct().withColumn("b", F.lit(True))
    return a.join(b, "run_id", "full").select("run_id", F.coalesce("a", F.lit(False)).alias("assigned"), F.coalesce("b", F.lit(False)).alias("reported"))
