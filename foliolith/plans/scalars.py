"""Queries of the scalar functions, over texts made from numbers so that the oracle can work from the numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.functions import identifiers as I
from foliolith.functions import numbers as N
from foliolith.functions import text as X
from foliolith.plans.catalog import query
from foliolith.runtime import table


@query(
    "identifier_parse",
    """
WITH t AS (SELECT concat_ws('.', 1 + l_orderkey % 9, l_linenumber, l_partkey % 50) AS core, chr(CAST(97 + l_suppkey % 4 AS INT)) AS x, l_suppkey % 7 AS style FROM lineitem),
p AS (SELECT core, CASE style WHEN 0 THEN core WHEN 6 THEN core || '|' || x || '|1' ELSE core || '|' || x END AS match_key FROM t)
SELECT core, match_key, CAST(3 AS INT) AS depth, count(*) AS n FROM p GROUP BY ALL
""",
)
def identifier_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = F.concat_ws(".", 1 + F.col("l_orderkey") % 9, F.col("l_linenumber"), F.col("l_partkey") % 50)
    x = F.chr(97 + F.col("l_suppkey") % 4)
    style = F.col("l_suppkey") % 7
    forms = [F.lit(""), F.concat(F.lit("("), x, F.lit(")")), F.concat(F.lit("["), F.upper(x), F.lit("]")), F.concat(F.lit("-"), F.upper(x)), F.concat(F.lit("."), x), x, F.concat(F.upper(x), F.lit("(1)"))]
    suffix = F.element_at(F.array(*forms), (style + 1).cast("int"))
    parsed = table(spark, sf_dir, "lineitem").select(I.parse_identifier(F.concat(core, suffix, F.lit(" Yield strength"))).alias("p"))
    return parsed.groupBy("p.core", "p.match_key", "p.depth").agg(F.count("*").alias("n"))


@query(
    "caption_parse",
    """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'table' WHEN 2 THEN 'figure' WHEN 3 THEN 'figure' END AS kind,
CASE WHEN o_orderkey % 5 < 4 THEN (1 + o_custkey % 9) || '.' || (o_orderkey % 30) END AS core, CASE WHEN o_orderkey % 5 < 4 THEN o_orderpriority END AS title FROM orders
""",
)
def caption_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ("Table ", "Tbl. ", "Figure No. ", "FIG. ", "as in Table "))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    text = F.concat(word, 1 + F.col("o_custkey") % 9, F.lit("."), F.col("o_orderkey") % 30, F.lit(" — "), F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", I.parse_caption(text).alias("c"))
    return orders.select("o_orderkey", "c.kind", F.col("c.identifier.core").alias("core"), "c.title")


@query(
    "catalog_entries",
    """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' END AS kind, CASE WHEN p_partkey % 3 < 2 THEN (1 + p_partkey % 9) || '.' || p_size END AS core,
CASE WHEN p_partkey % 3 < 2 THEN trim(p_name) END AS title FROM part
""",
)
def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.array(*map(F.lit, (" [Table] ", " [Figure] ", " Section "))), (F.col("p_partkey") % 3 + 1).cast("int"))
    line = F.concat(1 + F.col("p_partkey") % 9, F.lit("."), F.col("p_size"), mark, F.col("p_name"))
    part = table(spark, sf_dir, "part").select("p_partkey", I.parse_catalog_entry(line).alias("c"))
    return part.select("p_partkey", "c.kind", F.col("c.identifier.core").alias("core"), "c.title")


@query(
    "headings",
    """
SELECT l_orderkey % 6 AS style, count(*) AS n, CAST(count_if(CASE l_orderkey % 6 WHEN 0 THEN true WHEN 5 THEN l_linenumber <= 9 ELSE false END) AS BIGINT) AS n_headings FROM lineitem GROUP BY 1
""",
)
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber").cast("string")
    forms = [
        F.concat(F.lit("3."), k, F.lit(" Yield Strength")),
        F.concat(F.lit("3."), k, F.lit(", the toughness would be")),
        F.concat(F.lit("1."), k, F.lit(" inch specimen")),
        F.concat(F.lit("2."), k, F.lit(" and 3.2 show")),
        F.concat(k, F.lit("V Alloy Castings")),
        F.concat(k, F.lit(" General")),
    ]
    style = F.col("l_orderkey") % 6
    text = F.element_at(F.array(*forms), (style + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(style.alias("style"), I.is_heading(text).alias("h")).groupBy("style").agg(F.count("*").alias("n"), F.count_if("h").alias("n_headings"))


@query(
    "numeric_labels",
    """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN round(p_retailprice, 2) WHEN 2 THEN 1000.0 * p_partkey + 1000000 WHEN 3 THEN 2.0 * 10 ** (p_size % 5)
WHEN 4 THEN NULL ELSE 10.0 ** (-(p_size % 4)) END AS value FROM part
""",
)
def numeric_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    raised = F.translate(F.concat(F.lit("-"), (size % 4).cast("string")), X.PLAIN, X.RAISED)
    forms = [
        F.concat(size, F.lit("%")),
        F.round("p_retailprice", 2).cast("string"),
        F.format_number(1000 * F.col("p_partkey") + 1000000, 0),
        F.concat(F.lit("2 × 10^"), size % 5),
        F.concat(size, F.lit(",20")),
        F.concat(F.lit("10"), raised),
    ]
    label = F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", N.numeric_value(F.replace(X.squeeze(X.label_marked(label)), F.lit("−"), F.lit("-"))).alias("value"))


@query("observed_numbers")
def observed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "text_observations").select("obs_id", X.label_text(F.col("raw_text")).alias("label"))
    return rows.select("obs_id", "label", N.numeric_value(F.col("label")).alias("value"))


@query(
    "sheet_typing",
    """
SELECT l_orderkey % 5 AS style, CASE l_orderkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'text' WHEN 2 THEN 'float' WHEN 3 THEN 'text' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'float' ELSE 'text' END END AS kind,
count(*) AS n, CAST(coalesce(sum(CASE WHEN l_orderkey % 5 = 0 THEN l_partkey END), 0) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2
""",
)
def sheet_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey").cast("string")
    forms = [k, F.concat(F.lit("0"), k), F.concat(k, F.lit(".5")), F.concat(k, F.lit(" MPa")), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("-"), k, F.lit(".0e3"))).otherwise(F.concat(k, F.lit("e3")))]
    style = F.col("l_orderkey") % 5
    typed = table(spark, sf_dir, "lineitem").select(style.alias("style"), N.sheet_value(F.element_at(F.array(*forms), (style + 1).cast("int"))).alias("v"))
    return typed.groupBy("style", F.col("v.type").alias("kind")).agg(F.count("*").alias("n"), F.coalesce(F.sum("v.long"), F.lit(0)).alias("total"))


@query(
    "join_wrapped",
    """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_brand || ' intergranular' WHEN 1 THEN p_brand || ' A-Beta' WHEN 2 THEN p_brand || ' 7-fold' ELSE p_brand || ' self-test-bed next' END AS line FROM part
""",
)
def join_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.col("p_brand")
    forms = [
        F.array(F.concat(brand, F.lit("   inter-")), F.lit(""), F.lit(" granular")),
        F.array(brand, F.lit("A-"), F.lit("Beta")),
        F.array(F.concat(brand, F.lit(" 7-")), F.lit("fold ")),
        F.array(F.concat(brand, F.lit("\tself-test-")), F.lit("bed"), F.lit("next")),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", X.join_lines(F.element_at(F.array(*forms), (F.col("p_size") % 4 + 1).cast("int"))).alias("line"))


@query(
    "safe_segments",
    """
WITH r AS (SELECT p_partkey, repeat(p_name || '/' || p_partkey || ' ', 1 + p_size % 9) AS raw FROM part),
v AS (SELECT p_partkey, raw, trim(regexp_replace(regexp_replace(raw, '[\\\\/:*?"<>|]', ' - ', 'g'), '\\s+', ' ', 'g'), ' .') AS s FROM r)
SELECT p_partkey, CASE WHEN s = '' THEN 'untitled' WHEN length(s) <= 60 THEN s ELSE rtrim(substr(s, 1, 50)) || '__' || substr(sha1(raw), 1, 8) END AS segment FROM v
""",
)
def safe_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.repeat(F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(" ")), 1 + F.col("p_size") % 9)
    return table(spark, sf_dir, "part").select("p_partkey", X.safe_segment(raw, 60).alias("segment"))


@query(
    "markdown_grid",
    """
WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|[\\n\\r]')) AS line, generate_subscripts(string_split_regex(text, '\\r\\n|[\\n\\r]'), 1) AS line_no FROM documents WHERE text LIKE '%|%'),
c AS (SELECT doc_id, line_no, string_split(regexp_replace(regexp_replace(line, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '^\\|+|\\|+$', '', 'g'), '|') AS cells FROM l WHERE line LIKE '%|%'),
k AS (SELECT doc_id, line_no, list_transform(cells, lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS cells FROM c),
d AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS row_no, cells FROM k WHERE len(list_filter(cells, lambda x: NOT regexp_full_match(replace(x, ' ', ''), ':?-{3,}:?'))) > 0)
SELECT doc_id, count(*) AS n_cells, max(row_no) AS n_rows, max(w) AS width, CAST(sum(length(cell)) AS BIGINT) AS signs FROM (SELECT doc_id, row_no, len(cells) AS w, unnest(cells) AS cell FROM d) GROUP BY 1
""",
)
def markdown_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.operators.tables import markdown_cells

    cells = markdown_cells(table(spark, sf_dir, "documents").where(F.contains("text", F.lit("|"))), "doc_id", "text")
    width = cells.groupBy("doc_id", "row").agg(F.count("*").alias("w"), F.sum(F.length("text")).alias("signs"))
    return width.groupBy("doc_id").agg(F.sum("w").alias("n_cells"), F.count("*").alias("n_rows"), F.max("w").alias("width"), F.sum("signs").alias("signs"))


@query(
    "sheet_ranges",
    """
SELECT l_orderkey % 30 + 1 AS row, l_partkey % 900 + 1 AS col, CAST(l_linenumber AS BIGINT) AS rowspan, CAST(l_quantity AS BIGINT) AS colspan, count(*) AS n FROM lineitem GROUP BY ALL
""",
)
def sheet_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = N.sheet_range(F.col("l_orderkey") % 30 + 1, F.col("l_partkey") % 900 + 1, F.col("l_linenumber"), F.col("l_quantity").cast("bigint"))
    parsed = table(spark, sf_dir, "lineitem").select(N.parsed_range(made).alias("r"))
    return parsed.groupBy(F.col("r.row").alias("row"), F.col("r.column").alias("col"), F.col("r.rowspan").alias("rowspan"), F.col("r.colspan").alias("colspan")).agg(F.count("*").alias("n"))


@query(
    "cell_ids",
    "SELECT l_linenumber AS row, CAST(l_partkey % 40 AS INT) AS col, CASE WHEN l_partkey % 40 > 0 THEN printf('R%03dC%03d', l_linenumber, CAST(l_partkey % 40 AS INT)) END AS cell, count(*) AS n FROM lineitem GROUP BY ALL",
)
def cell_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    col = (F.col("l_partkey") % 40).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("row"), col.alias("col"), N.cell_id(F.col("l_linenumber"), col).alias("cell"))
    back = N.cell_position(F.col("cell"))
    return rows.withColumn("cell", F.when((back["row"] == F.col("row")) & (back["column"] == F.col("col")), F.col("cell"))).groupBy("row", "col", "cell").agg(F.count("*").alias("n"))


@query(
    "page_furniture",
    """
SELECT manual, count(*) AS n_blocks, CAST(count_if(bbox IS NOT NULL AND (bbox[2] < 70 OR bbox[4] > 721)) AS BIGINT) AS n_furniture FROM ocr_blocks GROUP BY 1
""",
)
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, bottom = F.get("bbox", F.lit(1)), F.get("bbox", F.lit(3))
    return table(spark, sf_dir, "ocr_blocks").groupBy("manual").agg(F.count("*").alias("n_blocks"), F.count_if(F.coalesce((top < 70) | (bottom > 721), F.lit(False))).alias("n_furniture"))


@query(
    "outline_keys",
    "SELECT p_partkey, regexp_replace(replace(lower(p_name || ' & ' || p_brand), '&', 'and'), '[^a-z0-9]+', '', 'g') AS key FROM part",
)
def outline_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.outline_key(F.concat("p_name", F.lit(" & "), "p_brand")).alias("key"))


@query(
    "coordinates",
    """
SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN log10(p_retailprice) ELSE p_retailprice END, 6) AS coordinate, round(greatest(1000 - p_retailprice, 0, p_retailprice - 1500), 4) AS distance,
CASE WHEN p_size * 25 <= 1000 THEN round(p_size * 25 * 640 / 1000.0, 4) END AS x FROM part
""",
)
def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    scale = F.when(size % 2 == 0, "log").otherwise("linear")
    point = N.to_pixels((size * 25).cast("double"), F.lit(10.0), F.lit(640), F.lit(480))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(N.axis_coordinate(price, scale), 6).alias("coordinate"),
        F.round(N.interval_distance(price, F.lit(1000.0), F.lit(1500.0)), 4).alias("distance"),
        F.round(point["x"], 4).alias("x"),
    )
