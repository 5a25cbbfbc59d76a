"""Queries that shred nested table candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliolith.operators.shred import EACH, candidate_links, flat_table
from foliolith.plans.catalog import query
from foliolith.runtime import table

_IDS = "array<struct<cell_id:string>>"
_CELL = "array<struct<cell_id:string,row:int,column:int,rowspan:int,colspan:int,text:string,source_table:int>>"
_LEAVES = {"cell_id": "string", "row": "int", "column": "int", "rowspan": "int", "colspan": "int", "text": "string", "source_table": "int"}

_LIST = "unnest({0}) AS item, generate_subscripts({0}, 1) AS pos"

FOUND_SQL = f"""
WITH comp AS (SELECT record_id, {_LIST.format("components")} FROM candidates),
cell AS (SELECT record_id, {_LIST.format("grid.cells")} FROM candidates),
med AS (SELECT record_id, {_LIST.format("grid.embedded_media")} FROM candidates),
iss AS (SELECT record_id, {_LIST.format("issues")} FROM candidates),
inner_cell AS (SELECT record_id, pos AS parent_pos, {_LIST.format("item.grid.cells").replace("AS pos", "AS p").replace("AS item", "AS i")} FROM comp WHERE item IS NOT NULL),
first_cell AS (SELECT record_id, item.cell_id AS cell_id, min(pos) AS at FROM cell WHERE item.cell_id IS NOT NULL GROUP BY ALL),
tree AS (SELECT record_id, pos, CAST(v AS JSON) AS v FROM (
  SELECT record_id, pos, unnest([json_extract(e, '$.cells'), json_extract(e, '$.detail.cells')]) AS v
  FROM (SELECT record_id, pos, CASE WHEN json_valid(item.extra) THEN item.extra END AS e FROM iss)) WHERE v IS NOT NULL),
entry AS (SELECT record_id, pos AS parent_pos, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) ELSE [v] END) AS x,
  generate_subscripts(CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) ELSE [v] END, 1) AS pos FROM tree)
SELECT record_id, 'component' AS entity, 0 AS parent_pos, CAST(pos AS INT) AS pos FROM comp WHERE item IS NOT NULL
UNION ALL SELECT record_id, 'grid_cell', 0, CAST(pos AS INT) FROM cell WHERE item IS NOT NULL
UNION ALL SELECT record_id, 'component_cell', CAST(parent_pos AS INT), CAST(p AS INT) FROM inner_cell WHERE i IS NOT NULL
UNION ALL SELECT m.record_id, 'media', CAST(coalesce(f.at, 0) AS INT), CAST(m.pos AS INT) FROM med m
  LEFT JOIN first_cell f ON f.record_id = m.record_id AND f.cell_id = m.item.cell_id WHERE m.item IS NOT NULL
UNION ALL SELECT record_id, 'issue', 0, CAST(pos AS INT) FROM iss WHERE item IS NOT NULL
UNION ALL SELECT record_id, 'issue_cell', CAST(parent_pos AS INT), CAST(pos AS INT) FROM entry WHERE json_type(x) <> 'NULL'
"""


@query("p3_found", FOUND_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = f"record_id bigint, components array<struct<component_id:string,grid:struct<cells:{_IDS}>>>, grid struct<cells:{_IDS},embedded_media:{_IDS}>, issues array<struct<extra:string>>"
    return candidate_links(table(spark, sf_dir, "candidates", ids))


@query(
    "p3_components",
    f"SELECT record_id, CAST(pos AS INT) AS pos, item.component_id AS component_id, item.title_raw AS title_raw FROM (SELECT record_id, {_LIST.format('components')} FROM candidates) WHERE item IS NOT NULL",
)
def p3_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "candidates", "record_id bigint, components array<struct<component_id:string,title_raw:string>>")
    return flat_table(df, "record_id", "components", (EACH,), {"component_id": "string", "title_raw": "string"})


@query(
    "p3_cells",
    "SELECT record_id, CAST(pos AS INT) AS pos, " + ", ".join(f'item."{x}" AS "{x}"' for x in _LEAVES) + f" FROM (SELECT record_id, {_LIST.format('grid.cells')} FROM candidates) WHERE item IS NOT NULL",
)
def p3_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "candidates", f"record_id bigint, grid struct<cells:{_CELL}>")
    return flat_table(df, "record_id", "grid", ("cells", EACH), _LEAVES)


@query(
    "p3_component_cells",
    "SELECT record_id, CAST(component_pos AS INT) AS component_pos, CAST(p AS INT) AS pos, "
    + ", ".join(f'i."{x}" AS "{x}"' for x in _LEAVES)
    + " FROM (SELECT record_id, component_pos, unnest(item.grid.cells) AS i, generate_subscripts(item.grid.cells, 1) AS p FROM (SELECT record_id, unnest(components) AS item, generate_subscripts(components, 1) AS component_pos FROM candidates)) WHERE i IS NOT NULL",
)
def p3_component_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "candidates", f"record_id bigint, components array<struct<grid:struct<cells:{_CELL}>>>")
    return flat_table(df, "record_id", "components", (EACH, "grid", "cells", EACH), _LEAVES, ("component_pos",))


@query(
    "p3_media",
    f"SELECT record_id, CAST(pos AS INT) AS pos, item.cell_id AS cell_id, item.tag AS tag, item.source AS source FROM (SELECT record_id, {_LIST.format('grid.embedded_media')} FROM candidates) WHERE item IS NOT NULL",
)
def p3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = {"cell_id": "string", "tag": "string", "source": "string"}
    df = table(spark, sf_dir, "candidates", "record_id bigint, grid struct<embedded_media:array<struct<cell_id:string,tag:string,source:string>>>")
    return flat_table(df, "record_id", "grid", ("embedded_media", EACH), leaves)


@query(
    "p3_issues",
    f"SELECT record_id, CAST(pos AS INT) AS pos, item.code AS code, item.message AS message, item.severity AS severity, item.extra AS extra FROM (SELECT record_id, {_LIST.format('issues')} FROM candidates) WHERE item IS NOT NULL",
)
def p3_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = {"code": "string", "message": "string", "severity": "string", "extra": "string"}
    df = table(spark, sf_dir, "candidates", "record_id bigint, issues array<struct<code:string,message:string,severity:string,extra:string>>")
    return flat_table(df, "record_id", "issues", (EACH,), leaves)
