"""Queries of the joins, set operations and page bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolith.functions.text import outline_key
from foliolith.operators import joins as J
from foliolith.operators.tables import block_pages
from foliolith.plans.catalog import query
from foliolith.runtime import small, table


@query(
    "ambiguous_match",
    """
WITH r AS (SELECT s_suppkey, s_nationkey || '|' || s_suppkey % 40 AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'A' ELSE 'b' END || s_suppkey % 5 AS raw FROM supplier),
l AS (SELECT c_custkey, c_nationkey || '|' || c_custkey % 40 AS k, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'B' END || c_custkey % 5 AS raw FROM customer),
j AS (SELECT c_custkey, count(s_suppkey) AS n, count_if(lower(l.raw) = lower(r.raw)) AS m, min(s_suppkey) AS any_, min(CASE WHEN lower(l.raw) = lower(r.raw) THEN s_suppkey END) AS one FROM l LEFT JOIN r ON l.k = r.k GROUP BY 1)
SELECT c_custkey, CASE WHEN m = 1 THEN one WHEN n = 1 THEN any_ END AS s_suppkey, CASE WHEN m = 1 THEN 'exact' WHEN n = 1 THEN 'sole' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM j
""",
)
def ambiguous_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    left = table(spark, sf_dir, "customer").select(c, F.concat_ws("|", "c_nationkey", c % 40).alias("k"), F.concat(F.when(c % 2 == 0, "a").otherwise("B"), c % 5).alias("raw"))
    right = table(spark, sf_dir, "supplier").select(s, F.concat_ws("|", "s_nationkey", s % 40).alias("k"), F.concat(F.when(s % 3 == 0, "A").otherwise("b"), s % 5).alias("raw"))
    return J.unambiguous_match(left, right, "k", "raw", "raw", "c_custkey", "s_suppkey")


_SECTIONS = "SELECT seq, core FROM (SELECT c_custkey AS seq, CASE c_custkey % 3 WHEN 0 THEN CAST(1 + c_nationkey AS VARCHAR) WHEN 1 THEN (1 + c_nationkey) || '.' || c_custkey % 20 ELSE (1 + c_nationkey) || '.' || c_custkey % 20 || '.' || c_custkey % 7 END AS core FROM customer)"


@query(
    "longest_prefix_parent",
    f"""
WITH s AS ({_SECTIONS}), c AS (SELECT o_orderkey, (1 + o_custkey % 25) || '.' || o_orderkey % 20 || '.' || o_orderkey % 7 || '.' || o_orderkey % 11 AS core FROM orders),
m AS (SELECT o_orderkey, seq, row_number() OVER (PARTITION BY o_orderkey ORDER BY length(s.core) DESC, seq DESC) AS rn FROM c JOIN
  (SELECT core, max(seq) AS seq FROM s GROUP BY 1) s ON s.core = split_part(c.core, '.', 1) OR s.core = split_part(c.core, '.', 1) || '.' || split_part(c.core, '.', 2) OR s.core = array_to_string(string_split(c.core, '.')[1:3], '.'))
SELECT c.o_orderkey, m.seq AS parent FROM c LEFT JOIN m ON m.o_orderkey = c.o_orderkey AND rn = 1
""",
)
def longest_prefix_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    one, two = 1 + F.col("c_nationkey"), F.concat_ws(".", 1 + F.col("c_nationkey"), c % 20)
    core = F.when(c % 3 == 0, one.cast("string")).when(c % 3 == 1, two).otherwise(F.concat_ws(".", two, c % 7))
    sections = table(spark, sf_dir, "customer").select(c.alias("parent"), core.alias("score"), c.alias("seq"))
    o = F.col("o_orderkey")
    children = table(spark, sf_dir, "orders").select(o, F.concat_ws(".", 1 + F.col("o_custkey") % 25, o % 20, o % 7, o % 11).alias("core"))
    return J.longest_prefix_parent(children, sections, "o_orderkey", "core", "score", "parent", "seq")


@query(
    "asof_parent",
    """
SELECT e.event_id, p.event_id AS parent FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts > p.ts
""",
)
def asof_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.last_before(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"), "parent")
    return rows.select("event_id", "parent")


@query("missing_assets", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query(
    "uncaptioned_figures",
    "SELECT source_id, count(*) AS n FROM text_observations t WHERE source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM figure_captions c WHERE c.manual = t.manual AND c.figure_id = split_part(t.source_id, '/', 3) AND c.caption IS NOT NULL) GROUP BY 1",
)
def uncaptioned_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions = table(spark, sf_dir, "figure_captions").where("caption is not null").select("manual", "figure_id").distinct()
    texts = table(spark, sf_dir, "text_observations").where("source_id is not null").groupBy("manual", "source_id").agg(F.count("*").alias("n"))
    named = texts.withColumn("figure_id", F.split_part("source_id", F.lit("/"), F.lit(3)))
    return named.join(captions, ["manual", "figure_id"], "left_anti").groupBy("source_id").agg(F.sum("n").alias("n"))


@query(
    "division_complete",
    """
WITH need AS (SELECT DISTINCT o_orderkey, flag FROM orders, (VALUES ('A'), ('N'), ('R')) f(flag) WHERE o_orderkey % 3 > 0 OR flag <> 'R'), have AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem)
SELECT o_orderkey, count(*) AS n_required, count(l_orderkey) AS n_present, count(*) = count(l_orderkey) AS complete FROM need LEFT JOIN have ON l_orderkey = o_orderkey AND l_returnflag = flag GROUP BY 1
""",
)
def division_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, "ANR"))).alias("flag")).where("o_orderkey % 3 > 0 or flag <> 'R'")
    have = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("flag"))
    return J.complete(need, have, "o_orderkey", "flag")


@query(
    "upsert_partial",
    """
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS status, o_totalprice + 1 AS total FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT -c_custkey, 'N', c_acctbal FROM customer)
SELECT coalesce(o.o_orderkey, d.o_orderkey) AS o_orderkey, coalesce(d.status, o_orderstatus) AS status, round(coalesce(d.total, o_totalprice), 2) AS total, d.o_orderkey IS NOT NULL AS changed FROM orders o FULL JOIN d ON o.o_orderkey = d.o_orderkey
""",
)
def upsert_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    changed = orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").alias("status"), (F.col("total") + 1).alias("total"))
    new = table(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("o_orderkey"), F.lit("N").alias("status"), F.col("c_acctbal").alias("total"))
    return J.upsert(orders, changed.unionByName(new), "o_orderkey", ["status", "total"]).withColumn("total", F.round("total", 2))


@query(
    "requested_ids",
    "SELECT b.candidate_id, bool_or(c.candidate_id IS NOT NULL) AS known FROM (SELECT DISTINCT candidate_id FROM plan_luna_batches WHERE candidate_id IS NOT NULL) b LEFT JOIN candidates c ON b.candidate_id = c.candidate_id GROUP BY 1",
)
def requested_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "plan_luna_batches").where("candidate_id is not null").select("candidate_id").distinct()
    known = table(spark, sf_dir, "candidates").select("candidate_id").distinct().withColumn("k", F.lit(True))
    return asked.join(known, "candidate_id", "left").select("candidate_id", F.coalesce("k", F.lit(False)).alias("known"))


@query(
    "shared_roots",
    """
WITH RECURSIVE p AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 10 = 7 THEN s_suppkey + 1 WHEN s_suppkey % 10 = 8 THEN s_suppkey - 1 ELSE s_suppkey - 1 END AS up FROM supplier),
k AS (SELECT p.node, q.node AS up FROM p LEFT JOIN p q ON p.up = q.node), c AS (SELECT node, node AS at, 0 AS hops FROM k UNION ALL SELECT c.node, k.up, c.hops + 1 FROM c JOIN k ON k.node = c.at WHERE k.up IS NOT NULL AND c.hops < 20),
e AS (SELECT c.node, c.at, c.hops FROM c JOIN k ON k.node = c.at WHERE k.up IS NULL)
SELECT k.node AS s_suppkey, e.at AS root, CAST(e.hops AS BIGINT) AS hops FROM k LEFT JOIN e ON e.node = k.node
""",
)
def shared_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    up = F.when(s % 10 == 0, None).when(s % 10 == 7, s + 1).otherwise(s - 1)
    return J.roots(table(spark, sf_dir, "supplier").select(s, up.alias("up")), "s_suppkey", "up")


@query(
    "outline_match",
    """
WITH s AS (SELECT n_nationkey AS node, 1 + n_nationkey % 2 AS depth, n_regionkey AS page, lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '', 'g')) AS k FROM nation),
o AS (SELECT c_custkey, 1 + c_nationkey % 2 AS depth, n_regionkey AS page, lower(regexp_replace(CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name || ': more' ELSE substr(n_name, 1, 4) END, '[^A-Za-z0-9:]+', '', 'g')) AS raw FROM customer JOIN nation ON n_nationkey = c_nationkey),
t AS (SELECT *, replace(raw, ':', '') AS k, split_part(raw, ':', 1) AS base FROM o),
m AS (SELECT c_custkey, count_if(s.k = t.k) AS ne, min(CASE WHEN s.k = t.k THEN node END) AS e, count_if(length(base) >= 6 AND (starts_with(s.k, base) OR starts_with(base, s.k))) AS np, min(CASE WHEN length(base) >= 6 AND (starts_with(s.k, base) OR starts_with(base, s.k)) THEN node END) AS p
 FROM t LEFT JOIN s ON s.depth = t.depth AND s.page = t.page GROUP BY 1)
SELECT c_custkey, CASE WHEN ne = 1 THEN e WHEN ne = 0 AND np = 1 THEN p END AS node, CASE WHEN ne = 1 THEN 'exact' WHEN ne > 1 THEN 'ambiguous' WHEN np = 1 THEN 'prefix' WHEN np > 1 THEN 'ambiguous' ELSE 'no_match' END AS status FROM m
""",
)
def outline_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    sections = nation.select(F.col("n_nationkey").alias("node"), (1 + F.col("n_nationkey") % 2).alias("depth"), F.col("n_regionkey").alias("page"), outline_key(F.col("n_name")).alias("k"))
    c = F.col("c_custkey")
    title = F.when(c % 3 == 0, F.col("n_name")).when(c % 3 == 1, F.concat("n_name", F.lit(": more"))).otherwise(F.substring("n_name", 1, 4))
    named = table(spark, sf_dir, "customer").join(small(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    outline = named.select(c, (1 + F.col("c_nationkey") % 2).alias("depth"), F.col("n_regionkey").alias("page"), outline_key(title).alias("key"), outline_key(F.split(title, "[:;]")[0]).alias("base"))
    pairs = outline.join(small(sections), ["depth", "page"], "left")
    near = (F.length("base") >= 6) & (F.startswith("k", "base") | F.startswith("base", "k"))
    found = pairs.groupBy("c_custkey").agg(
        F.count_if(F.col("k") == F.col("key")).alias("ne"),
        F.min(F.when(F.col("k") == F.col("key"), F.col("node"))).alias("e"),
        F.count_if(near).alias("np"),
        F.min(F.when(near, F.col("node"))).alias("p"),
    )
    status = F.when(F.col("ne") == 1, "exact").when(F.col("ne") > 1, "ambiguous").when(F.col("np") == 1, "prefix").when(F.col("np") > 1, "ambiguous").otherwise("no_match")
    return found.select("c_custkey", F.when(F.col("ne") == 1, F.col("e")).when((F.col("ne") == 0) & (F.col("np") == 1), F.col("p")).alias("node"), status.alias("status"))


@query(
    "block_pages",
    """
WITH e AS (SELECT manual, unnest(list_concat(coalesce(pages, []), [page_idx + 1], CASE WHEN end_page_idx >= start_page_idx THEN range(CAST(start_page_idx + 1 AS BIGINT), CAST(end_page_idx + 2 AS BIGINT)) ELSE [] END)) AS page, block_id FROM ocr_blocks)
SELECT manual, CAST(page AS INT) AS page, count(DISTINCT block_id) AS n_blocks FROM e WHERE page IS NOT NULL GROUP BY 1, 2
""",
)
def pages_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "ocr_blocks")
    pages = block_pages(blocks.select("block_id", "pages", "page_idx", "start_page_idx", "end_page_idx", "manual").withColumn("block_id", F.struct("manual", "block_id")))
    return pages.groupBy("block_id.manual", "page").agg(F.count("*").alias("n_blocks"))


@query(
    "page_coverage",
    """
WITH have AS (SELECT DISTINCT manual, page_idx + 1 AS page FROM ocr_blocks WHERE page_idx IS NOT NULL), want AS (SELECT manual, unnest(range(1, CAST(page_count AS BIGINT) + 1)) AS page FROM manuals)
SELECT coalesce(w.manual, h.manual) AS manual, CAST(count_if(h.page IS NULL) AS BIGINT) AS n_missing, CAST(count_if(w.page IS NULL) AS BIGINT) AS n_extra, min(CASE WHEN h.page IS NULL THEN w.page END) AS first_missing FROM want w FULL JOIN have h ON w.manual = h.manual AND w.page = h.page GROUP BY 1
""",
)
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "ocr_blocks").where("page_idx is not null").select("manual", (F.col("page_idx") + 1).cast("bigint").alias("page")).distinct().withColumn("h", F.lit(1))
    want = table(spark, sf_dir, "manuals").select("manual", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("page_count").cast("bigint"))).alias("page")).withColumn("w", F.lit(1))
    both = want.join(have, ["manual", "page"], "full")
    return both.groupBy("manual").agg(F.count_if(F.col("h").isNull()).alias("n_missing"), F.count_if(F.col("w").isNull()).alias("n_extra"), F.min(F.when(F.col("h").isNull(), F.col("page"))).alias("first_missing"))


@query(
    "caption_merge",
    """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY manual, figure_id, caption_source ORDER BY loaded_at DESC, caption_id DESC) AS rn FROM figure_captions WHERE manual IS NOT NULL AND figure_id IS NOT NULL),
p AS (SELECT * FROM n WHERE rn = 1 AND caption_source = 'pdf_text_layer'), o AS (SELECT * FROM n WHERE rn = 1 AND caption_source <> 'pdf_text_layer')
SELECT coalesce(p.manual, o.manual) AS manual, coalesce(p.figure_id, o.figure_id) AS figure_id, p.caption_id AS pdf_id, o.caption_id AS ocr_id,
CASE WHEN o.caption_id IS NULL THEN 'pdf_only' WHEN p.caption_id IS NULL THEN 'ocr_only' WHEN p.caption = o.caption THEN 'agreed' ELSE 'differs' END AS status
FROM p FULL JOIN o ON p.manual = o.manual AND p.figure_id = o.figure_id
""",
)
def caption_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("manual", "figure_id", "caption_source").orderBy(F.desc("loaded_at"), F.desc("caption_id"))
    newest = table(spark, sf_dir, "figure_captions").where("manual is not null and figure_id is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    pdf = newest.where("caption_source = 'pdf_text_layer'").select("manual", "figure_id", F.col("caption_id").alias("pdf_id"), F.col("caption").alias("pc"))
    ocr = newest.where("caption_source <> 'pdf_text_layer'").select("manual", "figure_id", F.col("caption_id").alias("ocr_id"), F.col("caption").alias("oc"))
    status = F.when(F.col("ocr_id").isNull(), "pdf_only").when(F.col("pdf_id").isNull(), "ocr_only").when(F.col("pc") == F.col("oc"), "agreed").otherwise("differs")
    return pdf.join(ocr, ["manual", "figure_id"], "full").select("manual", "figure_id", "pdf_id", "ocr_id", status.alias("status"))


@query(
    "page_sets",
    """
WITH c AS (SELECT record_id, list_sort(list_distinct(list_filter(coalesce(source_physical_pages, []), lambda x: x IS NOT NULL))) AS a,
 list_sort(list_distinct(flatten(list_transform(coalesce(source_fragments, []), lambda f: list_filter(coalesce(f.physical_pages, []), lambda x: x IS NOT NULL))))) AS b FROM candidates)
SELECT record_id, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS n_missing, CAST(len(list_filter(b, lambda x: NOT list_contains(a, x))) AS BIGINT) AS n_extra, a = b AS equal, len(list_filter(a, lambda x: list_contains(b, x))) > 0 AS overlap FROM c
""",
)
def page_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<int>")
    mine = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("source_physical_pages", none))))
    parts = F.transform(F.coalesce("source_fragments.physical_pages", F.array().cast("array<array<int>>")), lambda p: F.array_compact(F.coalesce(p, none)))
    rows = table(spark, sf_dir, "candidates").select("record_id", mine.alias("a"), F.array_sort(F.array_distinct(F.flatten(parts))).alias("b"))
    return rows.select(
        "record_id",
        F.size(F.array_except("a", "b")).cast("bigint").alias("n_missing"),
        F.size(F.array_except("b", "a")).cast("bigint").alias("n_extra"),
        (F.col("a") == F.col("b")).alias("equal"),
        F.arrays_overlap("a", "b").alias("overlap"),
    )


@query(
    "link_resolution",
    """
WITH l AS (SELECT l_orderkey AS source_page, l_partkey % 500 AS target, l_linestatus AS kind FROM lineitem),
r AS (SELECT p_partkey % 500 AS page, min(p_partkey) AS entry FROM part WHERE p_partkey % 4 = 0 GROUP BY 1), f AS (SELECT s_suppkey % 500 AS page, min(s_suppkey) AS leaf FROM supplier WHERE s_suppkey % 5 = 0 GROUP BY 1)
SELECT CASE WHEN entry IS NOT NULL THEN 'citation' WHEN leaf IS NOT NULL THEN 'related' ELSE 'external' END AS relation, kind, target, coalesce(entry, leaf) AS target_id, count(*) AS occurrences
FROM l LEFT JOIN r ON r.page = target LEFT JOIN f ON f.page = target GROUP BY ALL
""",
)
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("kind"), (F.col("l_partkey") % 500).alias("target")).groupBy("kind", "target").agg(F.count("*").alias("occurrences"))
    entries = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").groupBy((F.col("p_partkey") % 500).alias("target")).agg(F.min("p_partkey").alias("entry"))
    leaves = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").groupBy((F.col("s_suppkey") % 500).alias("target")).agg(F.min("s_suppkey").alias("leaf"))
    relation = F.when(F.col("entry").isNotNull(), "citation").when(F.col("leaf").isNotNull(), "related").otherwise("external")
    return links.join(entries, "target", "left").join(leaves, "target", "left").select(relation.alias("relation"), "kind", "target", F.coalesce("entry", "leaf").alias("target_id"), "occurrences")
