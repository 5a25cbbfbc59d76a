"""Queries of order-dependent operators and document trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolith.operators import sequences as S
from foliolith.operators import tables as G
from foliolith.operators import tree as T
from foliolith.plans.catalog import query
from foliolith.runtime import table


@query(
    "page_runs",
    """
WITH d AS (SELECT DISTINCT manual, page_idx + 1 AS page FROM ocr_blocks WHERE page_idx IS NOT NULL), i AS (SELECT manual, page, page - row_number() OVER (PARTITION BY manual ORDER BY page) AS g FROM d)
SELECT manual, min(page) AS first, max(page) AS last, count(*) AS n FROM i GROUP BY manual, g
""",
)
def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.runs(table(spark, sf_dir, "ocr_blocks").select("manual", (F.col("page_idx") + 1).alias("page")), ["manual"], "page")


@query(
    "page_class",
    """
WITH p AS (SELECT manual, page_idx + 1 AS page, bool_or(type = 'table') AS has_table, bool_or(type = 'image') AS has_image, bool_or(type = 'list') AS has_list, count_if(text IS NOT NULL OR content IS NOT NULL) AS n_text FROM ocr_blocks WHERE page_idx IS NOT NULL GROUP BY 1, 2),
k AS (SELECT manual, CASE WHEN page <= 2 THEN 'metadata' WHEN has_list AND NOT has_table AND NOT has_image AND n_text = 0 THEN 'reference' WHEN has_table AND has_image THEN 'mixed_figure_table' WHEN has_image AND n_text = 0 THEN 'pure_figure' WHEN has_table THEN 'table_candidate' ELSE 'unresolved' END AS page_class FROM p)
SELECT manual, page_class, count(*) AS n FROM k GROUP BY 1, 2
""",
)
def page_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda t: F.bool_or(F.col("type") == t)
    has_text = F.count_if(F.col("text").isNotNull() | F.col("content").isNotNull())
    pages = table(spark, sf_dir, "ocr_blocks").where("page_idx is not null").groupBy("manual", (F.col("page_idx") + 1).alias("page")).agg(kind("table").alias("t"), kind("image").alias("i"), kind("list").alias("l"), has_text.alias("x"))
    cls = (
        F.when(F.col("page") <= 2, "metadata")
        .when(F.col("l") & ~F.col("t") & ~F.col("i") & (F.col("x") == 0), "reference")
        .when(F.col("t") & F.col("i"), "mixed_figure_table")
        .when(F.col("i") & (F.col("x") == 0), "pure_figure")
        .when(F.col("t"), "table_candidate")
        .otherwise("unresolved")
    )
    return pages.groupBy("manual", cls.alias("page_class")).agg(F.count("*").alias("n"))


@query(
    "page_inventory",
    """
SELECT manual, page_idx + 1 AS page, count(*) AS n_blocks, CAST(count_if(type = 'image') AS BIGINT) AS n_images, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, CAST(sum(length(coalesce(text, ''))) AS BIGINT) < 40 AS sparse FROM ocr_blocks WHERE page_idx IS NOT NULL GROUP BY 1, 2
""",
)
def page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.coalesce(F.sum(F.length("text")), F.lit(0))
    return table(spark, sf_dir, "ocr_blocks").where("page_idx is not null").groupBy("manual", (F.col("page_idx") + 1).alias("page")).agg(F.count("*").alias("n_blocks"), F.count_if(F.col("type") == "image").alias("n_images"), chars.alias("n_chars"), (chars < 40).alias("sparse"))


_TREE = "SELECT * FROM (SELECT c_nationkey AS manual, c_custkey AS seq, CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1 THEN 1 ELSE 1 + (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 4 END AS depth FROM customer)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("manual"), F.col("c_custkey").alias("seq"), (1 + (nth - 1) % 4).cast("int").alias("depth"))


@query(
    "tree_hierarchy",
    f"WITH t AS ({_TREE}) SELECT a.manual, a.seq, max(b.seq) AS parent FROM t a LEFT JOIN t b ON a.manual = b.manual AND b.seq < a.seq AND b.depth < a.depth GROUP BY 1, 2",
)
def tree_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.hierarchy(_tree(spark, sf_dir), "manual", "seq", "depth").select("manual", "seq", "parent")


@query(
    "tree_stack",
    f"WITH t AS ({_TREE}) SELECT a.manual, a.seq, max(b.seq) AS parent FROM t a LEFT JOIN t b ON a.manual = b.manual AND b.seq < a.seq AND b.depth < a.depth GROUP BY 1, 2",
)
def tree_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.hierarchy_by_stack(_tree(spark, sf_dir), "manual", "seq", "depth")


_NODES = """SELECT -1 - r_regionkey AS node, CAST(NULL AS BIGINT) AS parent, r_name AS name FROM region UNION ALL SELECT -100 - n_nationkey, -1 - n_regionkey, n_name FROM nation
UNION ALL SELECT c_custkey, -100 - c_nationkey, c_mktsegment FROM customer WHERE c_custkey IS NOT NULL"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select((-1 - F.col("r_regionkey")).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("parent"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select((-100 - F.col("n_nationkey")).cast("bigint"), (-1 - F.col("n_regionkey")).cast("bigint"), F.col("n_name"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", (-100 - F.col("c_nationkey")).cast("bigint"), "c_mktsegment")
    return region.union(nation).union(customer)


@query(
    "tree_paths",
    f"""
WITH RECURSIVE n AS ({_NODES}), k AS (SELECT *, row_number() OVER (PARTITION BY parent, lower(name) ORDER BY node) AS o FROM n),
s AS (SELECT node, parent, CASE WHEN o > 1 THEN name || '__' || printf('%02d', o) ELSE name END AS seg FROM k),
p AS (SELECT node, 1 AS depth, seg AS path FROM s WHERE parent IS NULL UNION ALL SELECT s.node, p.depth + 1, p.path || '/' || s.seg FROM s JOIN p ON s.parent = p.node)
SELECT CAST(node AS BIGINT) AS node, CAST(depth AS INT) AS depth, path FROM p
""",
)
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.paths(_nodes(spark, sf_dir), "node", "parent", "name")


@query(
    "path_budget",
    f"""
WITH n AS (SELECT node, parent, length(name) AS w FROM ({_NODES})), l1 AS (SELECT parent AS node, max(w + 1) AS b FROM n WHERE parent IS NOT NULL GROUP BY 1),
m AS (SELECT n.node, n.parent, n.w, coalesce(l1.b, 0) AS b FROM n LEFT JOIN l1 ON l1.node = n.node), l2 AS (SELECT parent AS node, max(1 + w + b) AS b FROM m WHERE parent IS NOT NULL GROUP BY 1),
m2 AS (SELECT n.node, n.parent, n.w, greatest(coalesce(l1.b, 0), coalesce(l2.b, 0)) AS b FROM n LEFT JOIN l1 ON l1.node = n.node LEFT JOIN l2 ON l2.node = n.node), l3 AS (SELECT parent AS node, max(1 + w + b) AS b FROM m2 WHERE parent IS NOT NULL GROUP BY 1)
SELECT n.node, CAST(coalesce(l3.b, 0) AS BIGINT) AS budget FROM n LEFT JOIN l3 ON l3.node = n.node
""",
)
def path_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.budgets(_nodes(spark, sf_dir).withColumn("w", F.length("name")), "node", "parent", "w")


@query(
    "citations",
    """
WITH a AS (SELECT l_orderkey, 1 + l_partkey % 99 AS number FROM lineitem UNION ALL SELECT l_orderkey, 1 + l_suppkey % 99 FROM lineitem)
SELECT l_orderkey, CAST(number AS INT) AS number, count(*) AS n FROM a GROUP BY 1, 2
""",
)
def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = 1 + F.col("l_partkey") % 99, 1 + F.col("l_suppkey") % 99
    style = F.col("l_linenumber") % 3
    text = F.when(style == 0, F.concat(F.lit("as in Ref. "), a, F.lit(" and "), b, F.lit("."))).when(style == 1, F.concat(F.lit("known ("), a, F.lit(", "), b, F.lit(") for long"))).otherwise(F.concat(F.lit("see (250) and ("), a, F.lit("), refs "), b, F.lit("; 12 mm")))
    return T.citations(table(spark, sf_dir, "lineitem").select("l_orderkey", text.alias("text")), "l_orderkey", "text")


_BLOCKS = "SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN (1 + event_id % 300) || '. ' || event_type ELSE event_type END AS text FROM events"


@query(
    "reference_entries",
    f"""
WITH b AS (SELECT *, CASE WHEN text LIKE '%. purchase' THEN CAST(split_part(text, '.', 1) AS INT) END AS num FROM ({_BLOCKS})),
e AS (SELECT *, count(num) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT user_id, max(num) AS number, string_agg(text, ' ' ORDER BY ts, event_id) AS text, count(*) AS n_parts FROM e WHERE k > 0 GROUP BY user_id, k
""",
)
def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = F.concat(1 + F.col("event_id") % 300, F.lit(". "), F.col("event_type"))
    text = F.when(F.col("event_type") == "purchase", numbered).otherwise(F.col("event_type"))
    return S.reference_entries(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", text.alias("text")), ["user_id"], ["ts", "event_id"], "text")


@query(
    "reading_order",
    """
SELECT block_id, CAST(row_number() OVER (PARTITION BY manual, page_idx ORDER BY CASE WHEN bbox[1] < 306 THEN 0 ELSE 1 END, bbox[2], bbox[1], block_id) AS INT) AS position FROM ocr_blocks WHERE page_idx IS NOT NULL AND bbox IS NOT NULL
""",
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "ocr_blocks").where("page_idx is not null and bbox is not null").select("block_id", "manual", "page_idx", F.get("bbox", F.lit(0)).alias("x0"), F.struct(F.get("bbox", F.lit(1)), F.get("bbox", F.lit(0)), "block_id").alias("y0"))
    return S.reading_order(blocks, ["manual", "page_idx"], "x0", "y0", F.lit(306)).select("block_id", "position")


@query(
    "duplicate_figures",
    "SELECT manual, figure_id, count(DISTINCT source_page) AS n_pages FROM figure_captions WHERE manual IS NOT NULL AND figure_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT source_page) > 1 OR count(*) > 2",
)
def duplicate_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "figure_captions").where("manual is not null and figure_id is not null").groupBy("manual", "figure_id").agg(F.countDistinct("source_page").alias("n_pages"), F.count("*").alias("n"))
    return rows.where("n_pages > 1 or n > 2").select("manual", "figure_id", "n_pages")


@query(
    "link_counts",
    "SELECT l_linestatus AS relation, l_returnflag AS type, l_partkey % 100 AS target, l_suppkey % 10 AS page, l_linenumber AS line, count(*) AS occurrences FROM lineitem GROUP BY ALL",
)
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("l_linestatus").alias("relation"), F.col("l_returnflag").alias("type"), (F.col("l_partkey") % 100).alias("target"), (F.col("l_suppkey") % 10).alias("page"), F.col("l_linenumber").alias("line")]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count("*").alias("occurrences"))


@query(
    "latest_revision",
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY revision DESC, received_at DESC, record_id DESC) AS rn FROM candidates WHERE candidate_id IS NOT NULL)
SELECT candidate_id, record_id, revision, data_status FROM r WHERE rn = 1
""",
)
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "candidates").where("candidate_id is not null").select("candidate_id", "record_id", "revision", "data_status", "received_at")
    return S.latest(rows, ["candidate_id"], ["revision", "received_at", "record_id"]).select("candidate_id", "record_id", "revision", "data_status")


@query(
    "stored_revisions",
    """
WITH s AS (SELECT o_custkey AS k, max(o_orderkey % 5) AS now FROM orders GROUP BY 1), i AS (SELECT c_custkey AS k, c_custkey % 6 AS base FROM customer)
SELECT i.k AS c_custkey, CASE WHEN s.k IS NULL THEN 1 WHEN i.base = s.now THEN s.now + 1 END AS revision, CASE WHEN s.k IS NULL THEN 'created' WHEN i.base = s.now THEN 'stored' ELSE 'stale' END AS status FROM i LEFT JOIN s ON s.k = i.k
""",
)
def stored_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 5).alias("revision"), F.lit("old").alias("text"))
    incoming = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 6).alias("base_revision"), F.lit("new").alias("text"))
    return S.append_revisions(stored, incoming, "c_custkey", ["text"]).select("c_custkey", "revision", "status")


@query(
    "review_weight",
    """
SELECT record_id, CAST(1 + greatest(len(coalesce(list_filter(source_physical_pages, lambda x: x IS NOT NULL), [])) - 1, 0) + CASE WHEN len(list_filter(coalesce(grid.cells, []), lambda c: c IS NOT NULL)) > 100 THEN 1 ELSE 0 END
 + CASE WHEN list_has_any(list_transform(coalesce(issues, []), lambda i: i.code), ['embedded_media', 'large_merged_region', 'suspicious_numeric_ocr', 'cross_fragment_column_mismatch']) THEN 2 ELSE 0 END
 + CASE WHEN list_has_any(list_transform(coalesce(issues, []), lambda i: i.code), ['unresolved_identifier', 'orphan_table_fragment']) THEN 3 ELSE 0 END AS INT) AS weight FROM candidates
""",
)
def review_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.coalesce("issues.code", F.array().cast("array<string>"))
    has = lambda *c: F.coalesce(F.arrays_overlap(codes, F.array(*map(F.lit, c))), F.lit(False)).cast("int")
    n = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))
    pages = F.array_compact(F.coalesce("source_physical_pages", F.array().cast("array<int>")))
    weight = (
        1
        + F.greatest(n(pages) - 1, F.lit(0))
        + (n(F.filter("grid.cells", lambda c: c.isNotNull())) > 100).cast("int")
        + 2 * has("embedded_media", "large_merged_region", "suspicious_numeric_ocr", "cross_fragment_column_mismatch")
        + 3 * has("unresolved_identifier", "orphan_table_fragment")
    )
    return table(spark, sf_dir, "candidates").select("record_id", weight.cast("int").alias("weight"))


@query(
    "review_batches",
    """
WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey, 1 + o_orderkey % 4 AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
b AS (SELECT o_custkey, o_orderkey, n, w AS load, 1 AS held, 1 AS batch FROM r WHERE n = 1
UNION ALL SELECT r.o_custkey, r.o_orderkey, r.n, CASE WHEN b.load + r.w > 9 OR b.held >= 4 THEN r.w ELSE b.load + r.w END, CASE WHEN b.load + r.w > 9 OR b.held >= 4 THEN 1 ELSE b.held + 1 END, CASE WHEN b.load + r.w > 9 OR b.held >= 4 THEN b.batch + 1 ELSE b.batch END
 FROM b JOIN r ON r.o_custkey = b.o_custkey AND r.n = b.n + 1)
SELECT o_custkey, o_orderkey, CAST(batch AS INT) AS batch FROM b
""",
)
def review_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (1 + F.col("o_orderkey") % 4).alias("w"))
    return S.next_fit(rows, "o_custkey", ["o_orderkey"], {"w": 9}, 4).select("o_custkey", "o_orderkey", "batch")


@query(
    "quality_rules",
    """
WITH q AS (SELECT record_id, node_id_raw, synthetic_id, grid, list_filter(coalesce(source_physical_pages, []), lambda x: x IS NOT NULL) AS pages, list_filter(coalesce(grid.cells, []), lambda c: c IS NOT NULL) AS cells, list_filter(coalesce(grid.rows, []), lambda r: r IS NOT NULL) AS rows FROM candidates)
SELECT record_id, 'unresolved_identifier' AS code, 'review' AS severity FROM q WHERE node_id_raw IS NULL AND synthetic_id IS NULL
UNION ALL SELECT record_id, 'unnumbered_table', 'review' FROM q WHERE node_id_raw IS NULL AND synthetic_id IS NOT NULL
UNION ALL SELECT record_id, 'missing_page_provenance', 'error' FROM q WHERE len(pages) = 0
UNION ALL SELECT record_id, 'empty_grid', 'error' FROM q WHERE len(list_filter(rows, lambda r: len(list_filter(r, lambda c: c IS NOT NULL AND trim(c) <> '')) > 0)) = 0
UNION ALL SELECT record_id, 'inconsistent_width', 'review' FROM q WHERE len(list_distinct(list_transform(rows, lambda r: len(r)))) > 1
UNION ALL SELECT record_id, 'multiple_html_tables', 'review' FROM q WHERE grid.source_table_count > greatest(1, len(pages))
UNION ALL SELECT record_id, 'embedded_media', 'review' FROM q WHERE len(grid.embedded_media) > 0
UNION ALL SELECT record_id, 'large_merged_region', 'review' FROM q WHERE len(list_filter(cells, lambda c: c.rowspan > 3 OR c.colspan > 5)) > 0
UNION ALL SELECT record_id, 'suspicious_numeric_ocr', 'review' FROM q WHERE len(list_filter(cells, lambda c: regexp_matches(c.text, '[0-9][OoIl][0-9]|[0-9][OoIl][.,]|[.,][OoIl][0-9]'))) > 0
UNION ALL SELECT record_id, 'multi_page_table', 'info' FROM q WHERE len(pages) > 1
""",
)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.quality_issues(table(spark, sf_dir, "candidates"))


@query(
    "grid_cells",
    """
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS row, 1 AS column, 'p' || l_partkey AS text FROM lineitem
UNION ALL SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT), 2, 's' || l_suppkey FROM lineitem
""",
)
def grid_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(F.lit("<tr><td>p"), x["l_partkey"], F.lit("</td><td> s"), x["l_suppkey"], F.lit("<br></td></tr>")))
    html = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("<table border=1>"), F.array_join(rows, ""), F.lit("</table>")).alias("html"))
    return G.grid_cells(html, "l_orderkey", "html").select("l_orderkey", "row", "column", "text")


@query("block_grids")
def block_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "ocr_blocks").select("block_id", F.coalesce(F.nullif("table_body", F.lit("")), F.nullif("html", F.lit("")), "content").alias("markup"))
    return G.grid_summary(G.grid_cells(blocks, "block_id", "markup"), "block_id")


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.functions.identifiers import caption_line

    blocks = table(spark, sf_dir, "ocr_blocks")
    newest = S.latest(blocks.where("segment_id is not null and block_index is not null").select("segment_id", "block_index", "block_id", "type", "page_idx", "end_page_idx", "pages", "text", "content", "table_caption", "table_body", "html", "table_footnote", "bbox", "loaded_at"), ["segment_id", "block_index"], ["loaded_at", "block_id"])
    markup = F.coalesce(F.nullif("table_body", F.lit("")), F.nullif("html", F.lit("")), "content")
    grids = G.grid_summary(G.grid_cells(newest.where("type = 'table'").select("block_id", markup.alias("markup")), "block_id", "markup"), "block_id").select("block_id", "width", "header")
    said = F.when(F.col("type") == "table", F.array_join(F.array_compact(F.coalesce("table_caption", F.array().cast("array<string>"))), " ")).otherwise(F.coalesce("text", "content"))
    caption = caption_line(said)["identifier"]["match_key"]
    rows = newest.select(
        "segment_id",
        "block_index",
        "block_id",
        "type",
        (F.col("page_idx") + 1).alias("page"),
        (F.coalesce("end_page_idx", "page_idx") + 1).alias("last_page"),
        "pages",
        caption.alias("caption"),
        F.coalesce("text", "content").alias("title"),
        F.col("table_footnote").alias("footnote"),
        F.get("bbox", F.lit(1)).alias("top"),
        F.get("bbox", F.lit(3)).alias("bottom"),
    )
    return G.components(G.associate(rows.join(grids, "block_id", "left")))


@query("fragment_assoc")
def fragment_assoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragments(spark, sf_dir).select("segment_id", "block_index", "reason", "table_key", "component")


@query("candidate_agg")
def candidate_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.candidates(_fragments(spark, sf_dir))


@query(
    "event_components",
    """
WITH t AS (SELECT event_id, user_id, ts, sum(CASE WHEN event_type IN ('purchase', 'login') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS component FROM events)
SELECT user_id, CAST(component AS BIGINT) AS component, count(*) AS n, min(event_id) AS first_event FROM t GROUP BY 1, 2
""",
)
def event_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.opened(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("purchase", "login"), "component")
    return rows.groupBy("user_id", "component").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(
    "overview",
    """
SELECT m.manual, count(c.record_id) AS total, count(*) FILTER (WHERE c.data_status = 'partial') AS partial, count(*) FILTER (WHERE c.node_id_raw IS NULL AND c.record_id IS NOT NULL) AS unidentified, count(DISTINCT c.candidate_id) AS n_candidates FROM manuals m LEFT JOIN candidates c ON c.manual = m.manual GROUP BY 1
""",
)
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "candidates").select("manual", "record_id", "candidate_id", "node_id_raw", "data_status")
    joined = table(spark, sf_dir, "manuals").select("manual").join(rows, "manual", "left")
    return joined.groupBy("manual").agg(
        F.count("record_id").alias("total"),
        F.count_if(F.col("data_status") == "partial").alias("partial"),
        F.count_if(F.col("node_id_raw").isNull() & F.col("record_id").isNotNull()).alias("unidentified"),
        F.countDistinct("candidate_id").alias("n_candidates"),
    )


@query(
    "bounding_boxes",
    """
SELECT source_id, round(min(bbox_px.x0), 4) AS x0, round(min(bbox_px.y0), 4) AS y0, round(max(bbox_px.x1), 4) AS x1, round(max(bbox_px.y1), 4) AS y1, count(*) AS n, count(DISTINCT raw_text) AS n_texts FROM text_observations WHERE source_id IS NOT NULL GROUP BY 1
""",
)
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [F.round(f(f"bbox_px.{c}"), 4).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    return table(spark, sf_dir, "text_observations").where("source_id is not null").groupBy("source_id").agg(*edges, F.count("*").alias("n"), F.countDistinct("raw_text").alias("n_texts"))
