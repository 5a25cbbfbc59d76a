"""Queries of chart evidence, fits and structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.operators import charts as C
from foliolith.operators.joins import mutual_centers
from foliolith.operators.sequences import latest
from foliolith.plans.catalog import query
from foliolith.runtime import table

_NEWEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, id ORDER BY loaded_at DESC, obs_id DESC) AS rn FROM text_observations WHERE source_id IS NOT NULL AND id IS NOT NULL) WHERE rn = 1"""


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "text_observations").where("source_id is not null and id is not null").select("source_id", "id", "obs_id", "source", "normalized_text", "numeric_value", "bbox_px", "loaded_at")
    return latest(rows, ["source_id", "id"], ["loaded_at", "obs_id"])


_PAIRS = f"""n AS ({_NEWEST}), e AS (SELECT p.source_id, p.obs_id AS a, o.obs_id AS b FROM n p JOIN n o ON p.source_id = o.source_id AND p.source = 'pdf_text_layer' AND o.source <> 'pdf_text_layer'
AND (p.bbox_px.x0 + p.bbox_px.x1) / 2 BETWEEN o.bbox_px.x0 AND o.bbox_px.x1 AND (p.bbox_px.y0 + p.bbox_px.y1) / 2 BETWEEN o.bbox_px.y0 AND o.bbox_px.y1
AND (o.bbox_px.x0 + o.bbox_px.x1) / 2 BETWEEN p.bbox_px.x0 AND p.bbox_px.x1 AND (o.bbox_px.y0 + o.bbox_px.y1) / 2 BETWEEN p.bbox_px.y0 AND p.bbox_px.y1)"""


@query("bbox_match", f"WITH {_PAIRS} SELECT source_id, a AS pdf_id, b AS ocr_id FROM e")
def bbox_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _newest(spark, sf_dir).select("source_id", "obs_id", "source", "bbox_px")
    pdf, ocr = rows.where(F.col("source") == C.PDF), rows.where(F.col("source") != C.PDF)
    return mutual_centers(pdf.withColumnRenamed("obs_id", "pdf_id"), ocr.withColumnRenamed("obs_id", "ocr_id"), "source_id", "pdf_id", "ocr_id", "bbox_px", "bbox_px")


@query(
    "text_reconcile",
    f"""
WITH RECURSIVE {_PAIRS}, l AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), c AS (SELECT u AS node, u AS m FROM l UNION SELECT l.v, c.m FROM c JOIN l ON l.u = c.node WHERE c.m < l.v),
k AS (SELECT node, min(m) AS component FROM (SELECT node, m FROM c UNION ALL SELECT u, u FROM l) GROUP BY 1),
m AS (SELECT component, count(*) AS n, count(DISTINCT coalesce(normalized_text, chr(1))) AS t FROM k JOIN n ON n.obs_id = k.node GROUP BY 1),
r AS (SELECT * FROM n WHERE obs_id NOT IN (SELECT node FROM k)),
g AS (SELECT source_id, normalized_text AS t, count(*) FILTER (WHERE source = 'pdf_text_layer') AS p, count(*) FILTER (WHERE source <> 'pdf_text_layer') AS o, min(obs_id) AS least FROM r GROUP BY 1, 2)
SELECT k.node AS obs_id, k.component AS "match", CASE WHEN m.n > 2 THEN 'multiple_candidates' WHEN m.t = 1 THEN 'agreed' ELSE 'text_conflict' END AS status FROM k JOIN m ON m.component = k.component
UNION ALL SELECT r.obs_id, CASE WHEN p > 0 AND o > 0 THEN least ELSE obs_id END, CASE WHEN p = 1 AND o = 1 THEN 'position_conflict' WHEN p > 0 AND o > 0 THEN 'multiple_candidates' WHEN r.source = 'pdf_text_layer' THEN 'pdf_only' ELSE 'ocr_only' END
FROM r JOIN g ON g.source_id = r.source_id AND g.t IS NOT DISTINCT FROM r.normalized_text
""",
)
def text_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reconcile(_newest(spark, sf_dir), "source_id", "obs_id", "source", "normalized_text", "bbox_px")


@query(
    "tick_assoc",
    f"""
WITH n AS ({_NEWEST}), t AS (SELECT source_id, obs_id AS tick_id, (bbox_px.x0 + bbox_px.x1) / 2 AS x, bbox_px.y0 - 4 AS y, obs_id % 2 = 0 AS vertical, 2.0 AS width FROM n WHERE source = 'rapidocr_tick_crop' AND bbox_px IS NOT NULL),
x AS (SELECT source_id, bbox_px AS box, numeric_value AS value, source FROM n WHERE numeric_value IS NOT NULL AND bbox_px IS NOT NULL),
h AS (SELECT t.source_id, t.tick_id, x.value, x.source FROM t JOIN x ON t.source_id = x.source_id AND CASE WHEN vertical THEN y BETWEEN box.y0 - 3 AND box.y1 + 3 AND least(abs(x - box.x0), abs(x - box.x1)) <= 3 * (box.y1 - box.y0)
 ELSE x BETWEEN box.x0 - 3 AND box.x1 + 3 AND least(abs(y - box.y0), abs(y - box.y1)) <= 3 * (box.y1 - box.y0) END),
a AS (SELECT source_id, tick_id, count(*) AS n_texts, count(DISTINCT value) AS n_values, count(DISTINCT source) AS k, bool_or(source = 'pdf_text_layer') AS pdf FROM h GROUP BY 1, 2)
SELECT t.source_id, t.tick_id, coalesce(n_texts, 0) AS n_texts, coalesce(n_values, 0) AS n_values, CASE WHEN n_values > 1 THEN 'multiple_candidates' WHEN k > 1 THEN 'agreed' WHEN pdf THEN 'pdf_only' ELSE 'ocr_only' END AS status FROM t LEFT JOIN a ON a.source_id = t.source_id AND a.tick_id = t.tick_id
""",
)
def tick_assoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _newest(spark, sf_dir)
    b = F.col("bbox_px")
    ticks = rows.where("source = 'rapidocr_tick_crop' and bbox_px is not null").select("source_id", F.col("obs_id").alias("tick_id"), ((b["x0"] + b["x1"]) / 2).alias("x"), (b["y0"] - 4).alias("y"), (F.col("obs_id") % 2 == 0).alias("vertical"), F.lit(2.0).alias("width"))
    return C.associate_ticks(ticks, rows.select("source_id", b.alias("box"), F.col("numeric_value").alias("value"), "source"), "source_id")


@query(
    "nearest_values",
    f"""
WITH n AS ({_NEWEST}), h AS (SELECT source_id, obs_id AS hint_id, numeric_value AS value, bbox_px.x0 AS px FROM n WHERE source = 'rapidocr_general' AND numeric_value IS NOT NULL AND bbox_px IS NOT NULL),
t AS (SELECT source_id, obs_id AS text_id, numeric_value AS v, bbox_px.x0 AS lo, bbox_px.x1 AS hi, source FROM n WHERE source <> 'rapidocr_general' AND numeric_value IS NOT NULL AND bbox_px.x0 <= bbox_px.x1),
r AS (SELECT h.source_id, hint_id, text_id, row_number() OVER (PARTITION BY h.source_id, hint_id ORDER BY source <> 'pdf_text_layer', greatest(lo - px, 0, px - hi), text_id) AS rn FROM h JOIN t ON h.source_id = t.source_id AND h.value = t.v AND greatest(lo - px, 0, px - hi) <= 40)
SELECT source_id, hint_id, text_id FROM r WHERE rn = 1
""",
)
def nearest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _newest(spark, sf_dir).where("numeric_value is not null and bbox_px is not null")
    hints = rows.where("source = 'rapidocr_general'").select("source_id", F.col("obs_id").alias("hint_id"), F.col("numeric_value").alias("value"), F.col("bbox_px.x0").alias("at"))
    texts = rows.where("source <> 'rapidocr_general'").select("source_id", F.col("obs_id").alias("text_id"), F.col("numeric_value").alias("value"), F.col("bbox_px.x0").alias("lo"), F.col("bbox_px.x1").alias("hi"), "source")
    return C.nearest_value_text(hints, texts, "source_id", 40.0)


_POINTS = "SELECT p_brand, p_partkey AS o, CAST(p_partkey % 700 AS DOUBLE) AS v, (p_partkey % 700) * 1.5 + 20 + CASE WHEN p_partkey % 37 = 0 THEN 9 ELSE 0 END AS p FROM part"


@query(
    "two_point_fit",
    f"""
WITH q AS ({_POINTS}), e AS (SELECT p_brand, arg_min(struct_pack(p := p, v := v), row(p, o)) AS a, arg_max(struct_pack(p := p, v := v), row(p, -o)) AS b FROM q GROUP BY 1),
l AS (SELECT p_brand, (b.p - a.p) / (b.v - a.v) AS slope, a.p - (b.p - a.p) / (b.v - a.v) * a.v AS intercept FROM e WHERE a.v <> b.v)
SELECT q.p_brand, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(max(abs(p - (slope * v + intercept))), 4) AS residual, count(*) AS n, count(*) FILTER (WHERE abs(p - (slope * v + intercept)) <= 2.001) AS n_close FROM q JOIN l ON l.p_brand = q.p_brand GROUP BY 1, slope, intercept
""",
)
def two_point_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pixel = (k % 700) * 1.5 + 20 + F.when(k % 37 == 0, 9).otherwise(0)
    fits = C.two_point_fit(table(spark, sf_dir, "part"), "p_brand", k % 700, pixel, k, 2.001)
    return fits.select("p_brand", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("residual", 4).alias("residual"), "n", "n_close")


@query(
    "label_fit",
    """
WITH q AS (SELECT p_type, CAST(p_size AS DOUBLE) + p_partkey * 0.0001 AS v, p_size * 4.0 + p_partkey * 0.0004 AS c, p_partkey = min(p_partkey) OVER (PARTITION BY p_type) AS s FROM part),
f AS (SELECT p_type, regr_slope(c, v) AS slope, max(CASE WHEN s THEN c END) AS c0, max(CASE WHEN s THEN v END) AS v0, count(*) AS n FROM q GROUP BY 1)
SELECT p_type, round(slope, 4) AS slope, round(c0 - slope * v0, 3) AS intercept, true AS monotone, n FROM f WHERE n > 1
""",
)
def label_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k, size = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part").withColumn("s", k == F.min("p_partkey").over(Window.partitionBy("p_type")))
    fits = C.anchored_fit(part, "p_type", size.cast("double") + k * 0.0001, size * 4.0 + k * 0.0004, F.col("s"))
    return fits.select("p_type", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), "monotone", "n")


@query("collinear_spines")
def collinear_spines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox_px")
    pieces = table(spark, sf_dir, "text_observations").where("bbox_px is not null and source_id is not null").select(
        "source_id", b["x0"].alias("x0"), b["x1"].alias("x1"), ((b["y0"] + b["y1"]) / 2).alias("coordinate"), F.lit(2.0).alias("width"), (b["x1"] - b["x0"] + 1).alias("strength")
    )
    return C.merge_collinear(pieces, "source_id", 6.0)


@query(
    "axis_expand",
    """
WITH y AS (SELECT n_regionkey AS region, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, n_nationkey % 3 = 0 AS cat FROM nation)
SELECT region, printf('axis_%03d_%03d', region, CAST(i AS INT)) AS axis_id, r_name || ' - ' || n_name AS display_name, CASE WHEN r_regionkey % 2 = 1 AND cat THEN NULL WHEN r_regionkey % 2 = 1 THEN 'categorical_x_numeric_y' WHEN cat THEN 'numeric_x_categorical_y' ELSE 'xy' END AS axis_type,
CASE WHEN i > 0 AND r_regionkey % 2 = 0 THEN printf('axis_%03d_000', region) END AS shared_x_axis_id FROM y JOIN region ON r_regionkey = region
""",
)
def axis_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.struct("n_nationkey", F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "categorical").otherwise("linear").alias("scale"))
    ys = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(y)).alias("ys"))
    x = F.struct(F.col("r_name").alias("name"), F.when(F.col("r_regionkey") % 2 == 1, "categorical").otherwise("linear").alias("scale"))
    groups = ys.join(table(spark, sf_dir, "region").select("r_regionkey", x.alias("x")), F.col("region") == F.col("r_regionkey")).withColumn("group_index", F.col("region"))
    return C.expand_axes(groups, "region")


@query(
    "axis_rules",
    """
WITH a AS (SELECT c_nationkey AS figure, c_custkey % 3 AS x, CASE c_custkey % 6 WHEN 0 THEN 'Axis' WHEN 1 THEN '(MPa)' ELSE 'Stress ' || c_custkey % 500 END AS y, c_custkey % 6 = 4 AS xc, c_custkey % 12 = 4 AS yc FROM customer),
k AS (SELECT *, count(*) OVER (PARTITION BY figure, x, lower(y)) AS same FROM a)
SELECT DISTINCT figure, 'no_numeric_direction' AS code FROM k WHERE xc AND yc UNION ALL SELECT DISTINCT figure, 'placeholder_label' FROM k WHERE lower(y) = 'axis'
UNION ALL SELECT DISTINCT figure, 'unit_only_label' FROM k WHERE y = '(MPa)' UNION ALL SELECT DISTINCT figure, 'duplicate_axis_pair' FROM k WHERE same > 1
""",
)
def axis_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    y = F.when(c % 6 == 0, "Axis").when(c % 6 == 1, "(MPa)").otherwise(F.concat(F.lit("Stress "), c % 500))
    scale = lambda bad: F.when(bad, "categorical").otherwise("linear")
    axes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("figure"), (c % 3).cast("string").alias("x_label"), y.alias("y_label"), scale(c % 6 == 4).alias("x_scale"), scale(c % 12 == 4).alias("y_scale"))
    return C.axis_issues(axes, "figure")


@query(
    "dataset_rules",
    """
WITH d AS (SELECT l_orderkey AS figure, l_linenumber AS axis, CASE WHEN l_linenumber % 2 = 1 THEN 'range_boundary' ELSE 'curve' END AS kind, CASE l_partkey % 3 WHEN 0 THEN 'upper B' WHEN 1 THEN 'B Lower' ELSE 'B' END AS name FROM lineitem),
b AS (SELECT figure, axis, count(*) AS n, count(DISTINCT name) FILTER (WHERE name <> 'B') AS roles, count(*) FILTER (WHERE name = 'B') AS plain FROM d WHERE kind = 'range_boundary' GROUP BY 1, 2)
SELECT figure, axis, 'B' AS base, 'incomplete_band' AS code FROM b WHERE NOT (n = 2 AND roles = 2 AND plain = 0)
UNION ALL SELECT figure, axis, lower(name), 'duplicate_dataset' FROM d GROUP BY figure, axis, lower(name) HAVING count(*) > 1
""",
)
def dataset_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    name = F.when(p % 3 == 0, "upper B").when(p % 3 == 1, "B Lower").otherwise("B")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("figure"), F.col("l_linenumber").alias("axis"), F.when(F.col("l_linenumber") % 2 == 1, "range_boundary").otherwise("curve").alias("kind"), name.alias("name"))
    return C.band_issues(rows, "figure")


@query("plot_projects")
def plot_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    point = lambda d, e: F.struct(F.lit(d).alias("direction"), (F.col("p_size") * e).cast("double").alias("px"), F.lit(10.0 * e).alias("py"), (F.col("p_partkey") * e).cast("double").alias("value"))
    both = F.array(F.lit("x"), F.lit("y"))
    axes = part.select(F.col("p_partkey").alias("figure"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, both).otherwise(F.array(F.lit("y"))).alias("numeric"), F.lit(False).alias("log_x"), (F.col("p_size") % 3 == 0).alias("log_y"), F.array(point("x", 1), point("x", 2), point("y", 1), point("y", 2)).alias("points"))
    datasets = part.select(F.col("p_partkey").alias("figure"), F.col("p_brand").alias("name"), F.col("p_name").alias("axis"))
    return C.plot_project(axes, datasets, "figure")
