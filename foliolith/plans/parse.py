"""Queries of page parsing: lines, tokens, captions, references, outlines, assets, second readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolith.operators import parsing as R
from foliolith.plans.catalog import query
from foliolith.runtime import table


@query(
    "styled_lines",
    """
SELECT l_orderkey, trim(string_agg(l_returnflag || l_linestatus || ' ', '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)) AS text, max(l_quantity) AS size, bool_or(l_tax > 0.07) AS bold FROM lineitem GROUP BY 1
""",
)
def styled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", order.alias("o"), F.concat("l_returnflag", "l_linestatus", F.lit(" ")).alias("text"), F.col("l_quantity").alias("size"), (F.col("l_tax") > 0.07).alias("bold"))
    return R.styled_lines(spans, ["l_orderkey"], "o")


@query(
    "char_tokens",
    """
WITH w AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_brand, ' ')) AS text, generate_subscripts(string_split(p_name || ' ' || p_brand, ' '), 1) AS token_no FROM part)
SELECT p_partkey, CAST(token_no AS INT) AS token_no, text, CAST(length(text) AS BIGINT) AS width FROM w
""",
)
def char_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split(F.concat_ws(" ", "p_name", "p_brand"), "")).alias("i", "char")).where("char <> ''")
    placed = chars.select("p_partkey", "i", "char", F.lit(False).alias("raised"), F.col("i").alias("x0"), (F.col("i") + 1).alias("x1"), F.lit(0).alias("y0"), F.lit(1).alias("y1"))
    tokens = R.char_tokens(placed, ["p_partkey"], "i")
    return tokens.select("p_partkey", "token_no", "text", (F.col("box.x1") - F.col("box.x0")).cast("bigint").alias("width"))


@query(
    "page_captions",
    """
WITH l AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders)
SELECT o_custkey, o_orderkey, CASE k WHEN 0 THEN '2.' || o_orderkey % 90 ELSE '7.1' END AS match_key FROM l WHERE k = 0 OR (k = 1 AND nxt % 4 = 2)
""",
)
def page_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    text = F.when(o % 4 == 0, F.concat(F.lit("Table 2."), o % 90, F.lit(" Name "), o)).when(o % 4 == 1, "Table").when(o % 4 == 2, F.concat(F.lit("7.1 wrapped "), o)).otherwise("prose on Table 3.1")
    lines = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", text.alias("text"))
    return R.page_captions(lines, ["o_custkey"], "o_orderkey", "table").select("o_custkey", "o_orderkey", "match_key")


@query("document_sections")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\\r?\\n")).alias("line_no", "text"), F.col("physical_page").alias("page"))
    bare = F.regexp_replace("text", r"^(?:#+ |=+ |\\(?:sub)*section\{|<h[1-6]>)", "")
    return R.sections(lines.select("doc_id", "line_no", bare.alias("text"), F.lit(12.0).alias("size"), F.lit(True).alias("bold"), "page"), "doc_id", ["line_no"])


@query("continued_captions")
def continued_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.col("bbox")
    lines = table(spark, sf_dir, "ocr_blocks").where("page_idx is not null and bbox is not null and size(bbox) = 4").select(
        F.concat_ws("/", "manual", F.col("page_idx").cast("string")).alias("page"),
        F.coalesce(F.nullif(F.array_join("table_caption", " "), F.lit("")), "text", F.lit("")).alias("text"),
        *(F.get(box, F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))),
    )
    return R.continued_captions(lines, "page")


_PAGES = "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 5 = 0 AS ref, o_orderkey % 3 > 0 AS num, o_orderkey % 7 = 0 AS head FROM orders"


@query(
    "reference_pages",
    f"""
WITH p AS ({_PAGES}), f AS (SELECT o_custkey, min(page) AS first FROM p WHERE ref GROUP BY 1),
b AS (SELECT p.o_custkey, min(page) AS stop FROM p JOIN f ON f.o_custkey = p.o_custkey WHERE page > first AND NOT (num AND NOT head) GROUP BY 1)
SELECT p.o_custkey, CAST(p.page AS INT) AS page, CASE WHEN p.page >= first AND p.page < coalesce(stop, 1000000) THEN 'reference' ELSE 'front' END AS kind FROM p LEFT JOIN f ON f.o_custkey = p.o_custkey LEFT JOIN b ON b.o_custkey = p.o_custkey
""",
)
def reference_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pages = table(spark, sf_dir, "orders").select("o_custkey", nth.alias("page"), (o % 5 == 0).alias("is_references"), (o % 3 > 0).alias("has_numbered"), (o % 7 == 0).alias("has_heading"))
    return R.reference_pages(pages, "o_custkey").select("o_custkey", "page", "kind")


@query(
    "outline_order",
    """
SELECT o_custkey, o_orderkey, coalesce(o_orderkey % 97 < max(o_orderkey % 97) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS order_issue FROM orders
""",
)
def outline_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 97).alias("sequence"))
    return R.outline_order(rows, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "order_issue")


@query(
    "figure_assets",
    """
WITH n AS (SELECT p_partkey AS node_id, '1.' || p_partkey % 200 AS core, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'a' END AS suffix FROM part), k AS (SELECT *, core || '|' || suffix AS key FROM n),
a AS (SELECT s_suppkey AS asset_id, '1.' || s_suppkey % 200 AS core, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'b' END AS suffix FROM supplier), b AS (SELECT *, core || '|' || suffix AS key FROM a)
SELECT node_id, asset_id, 'exact' AS how FROM k JOIN b ON k.key = b.key UNION ALL SELECT node_id, asset_id, 'panel' FROM k JOIN b ON k.core = b.core AND k.suffix = '' AND b.suffix <> '' AND b.key NOT IN (SELECT key FROM k)
""",
)
def figure_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    keyed = lambda df: df.withColumn("key", F.concat_ws("|", "core", "suffix"))
    nodes = table(spark, sf_dir, "part").select(p.alias("node_id"), F.concat(F.lit("1."), p % 200).alias("core"), F.when(p % 3 == 0, "").otherwise("a").alias("suffix"))
    assets = table(spark, sf_dir, "supplier").select(s.alias("asset_id"), F.concat(F.lit("1."), s % 200).alias("core"), F.when(s % 3 == 0, "").when(s % 3 == 1, "a").otherwise("b").alias("suffix"))
    return R.figure_assets(keyed(nodes), keyed(assets))


_IDENTITY = "coalesce(nullif(node_id_raw, ''), nullif(synthetic_id, ''), nullif(candidate_id, ''))"


@query(
    "reparse_status",
    f"""
WITH a AS (SELECT {_IDENTITY} AS identity, list_distinct(flatten(list(coalesce(source_physical_pages, [])))) AS was FROM candidates GROUP BY 1),
b AS (SELECT {_IDENTITY} AS identity, list_distinct(flatten(list(coalesce(source_physical_pages, [])))) AS now FROM candidates_mirror GROUP BY 1)
SELECT coalesce(a.identity, b.identity) AS identity, CASE WHEN a.identity IS NULL THEN 'new' WHEN b.identity IS NULL THEN 'gone' WHEN len(list_filter(now, lambda x: x IS NOT NULL AND NOT list_contains(was, x))) > 0 THEN 'grown' ELSE 'updated' END AS status
FROM (SELECT * FROM a WHERE identity IS NOT NULL) a FULL JOIN (SELECT * FROM b WHERE identity IS NOT NULL) b ON a.identity = b.identity
""",
)
def reparse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda t: table(spark, sf_dir, t).select(F.col("node_id_raw").alias("key"), "synthetic_id", "candidate_id", F.array_compact("source_physical_pages").alias("pages"))
    return R.reparse(side("candidates"), side("candidates_mirror"))


EXAMPLES = {"creep": ["creep rate", "creep"], "fatigue": ["fatigue limit", "cycles", "crack growth"], "strength": ["yield strength", "ultimate strength", "MPa"], "thermal": ["thermal conductivity", "°C"]}
_SCORES = " UNION ALL ".join(f"SELECT p_partkey, '{name}' AS example, {' + '.join(f'CAST(contains(t, {chr(39)}' + ''.join(c.lower().split()) + f'{chr(39)}) AS INT)' for c in cues)} AS score FROM p" for name, cues in EXAMPLES.items())


@query(
    "example_ranking",
    f"""
WITH p AS (SELECT p_partkey, lower(replace(p_name || CASE p_size % 4 WHEN 0 THEN ' Yield strength, MPa' WHEN 1 THEN ' creep rate' WHEN 2 THEN ' Cycles of  crack growth' ELSE '' END, ' ', '')) AS t FROM part), s AS ({_SCORES})
SELECT p_partkey, example, score, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, example) AS INT) AS rank FROM s
""",
)
def example_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    text = F.concat("p_name", F.when(k == 0, " Yield strength, MPa").when(k == 1, " creep rate").when(k == 2, " Cycles of  crack growth").otherwise(""))
    return R.ranked_examples(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), EXAMPLES, "p_partkey")


@query(
    "axis_sides",
    "SELECT source_id, CASE WHEN count(*) FILTER (WHERE (bbox_px.x0 + bbox_px.x1) / 2 > 300) > count(*) FILTER (WHERE (bbox_px.x0 + bbox_px.x1) / 2 < 300) THEN 1 ELSE 0 END AS side FROM text_observations WHERE source_id IS NOT NULL GROUP BY 1",
)
def axis_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    center = (F.col("bbox_px.x0") + F.col("bbox_px.x1")) / 2
    return R.voted_side(table(spark, sf_dir, "text_observations").where("source_id is not null"), "source_id", center, F.lit(300.0))


@query(
    "node_pages",
    """
SELECT record_id, array_to_string(CASE WHEN len(list_filter(coalesce(source_physical_pages, []), lambda x: x IS NOT NULL)) > 0 THEN list_sort(list_distinct(list_filter(source_physical_pages, lambda x: x IS NOT NULL))) WHEN record_id % 3 = 0 THEN [CAST(record_id % 50 AS INT)] ELSE [] END, ',') AS pages FROM candidates
""",
)
def node_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("record_id") % 3 == 0, (F.col("record_id") % 50).cast("int"))
    none = F.lit(None).cast("array<int>")
    pages = R.source_pages(F.array_compact("source_physical_pages"), target, none, none)
    return table(spark, sf_dir, "candidates").select("record_id", F.array_join(pages, ",").alias("pages"))
