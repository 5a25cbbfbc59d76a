"""Chart evidence: reconciling readings, ticks and labels, axis fits, axis and dataset structures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolith.operators.joins import bucket_range, connected, mutual_centers
from foliolith.runtime import cut

PDF = "pdf_text_layer"


def reconcile(observations: DataFrame, group: str, key: str, source: str, text: str, box: str) -> DataFrame:
    """Rows (key, match, status), one per observation: readings of one label by the PDF (source PDF) and by OCR.

    Boxes that hold each other's center are linked; a linked component is agreed or text_conflict if it has two members,
    else multiple_candidates: no winner is chosen. The rest pair by equal text (null equals null): one of each side is a
    position_conflict, more are multiple_candidates. What is left is pdf_only or ocr_only. `match` is the least key.
    """
    rows = cut(observations.select(F.col(group).alias("g"), F.col(key).alias("id"), (F.col(source) == PDF).alias("pdf"), F.col(text).alias("t"), F.col(box).alias("b")))
    pairs = mutual_centers(rows.where("pdf"), rows.where("not pdf").select("g", F.col("id").alias("id2"), "b"), "g", "id", "id2", "b", "b")
    linked = cut(connected(pairs, "id", "id2"))
    members = linked.join(rows, F.col("node") == F.col("id"))
    kinds = members.groupBy("component").agg(F.count("*").alias("n"), (F.countDistinct("t") + F.max(F.col("t").isNull().cast("int"))).alias("texts"))
    status = F.when(F.col("n") > 2, "multiple_candidates").when(F.col("texts") == 1, "agreed").otherwise("text_conflict")
    spatial = linked.join(kinds, "component").select(F.col("node").alias("id"), F.col("component").alias("match"), status.alias("status"))
    rest = rows.join(linked, F.col("id") == F.col("node"), "left_anti")
    counts = rest.groupBy("g", "t").agg(F.count_if("pdf").alias("p"), F.count_if(~F.col("pdf")).alias("o"), F.min("id").alias("least"))
    again = rest.alias("r").join(counts.alias("c"), F.col("r.g").eqNullSafe(F.col("c.g")) & F.col("r.t").eqNullSafe(F.col("c.t")))
    both = (F.col("p") > 0) & (F.col("o") > 0)
    left = F.when(both & (F.col("p") == 1) & (F.col("o") == 1), "position_conflict").when(both, "multiple_candidates").when(F.col("pdf"), "pdf_only").otherwise("ocr_only")
    by_text = again.select("r.id", F.when(both, F.col("least")).otherwise(F.col("r.id")).alias("match"), left.alias("status"))
    return spatial.unionByName(by_text).select(F.col("id").alias(key), "match", "status")


def associate_ticks(ticks: DataFrame, texts: DataFrame, group: str, tile: float = 64.0) -> DataFrame:
    """Rows (group, tick_id, n_texts, n_values, status): numeric texts beside each tick.

    `ticks` has tick_id, x, y, vertical (of its spine), width (of its spine); `texts` has box, value, source. Along the
    spine the text's interval, widened by the spine's width and a pixel, must hold the tick; across it the gap must be at
    most three times the glyph height. Buckets along the spine make it an equality join; ticks without text stay.
    """
    t = texts.where("value is not null and box is not null")
    lo = F.when(F.col("vertical"), F.col("box.y0")).otherwise(F.col("box.x0"))
    hi = F.when(F.col("vertical"), F.col("box.y1")).otherwise(F.col("box.x1"))
    margin = tile / 4
    sides = t.withColumn("vertical", F.explode(F.array(F.lit(True), F.lit(False))))
    listed = sides.withColumn("_k", F.explode(bucket_range(lo - margin, hi + margin, tile))).select(group, "vertical", "_k", "box", "value", "source")
    at = ticks.withColumn("_p", F.when(F.col("vertical"), F.col("y")).otherwise(F.col("x"))).withColumn("_k", F.floor(F.col("_p") / tile))
    slack = F.least(F.col("width") + 1, F.lit(margin))
    near = F.col("_p").between(lo - slack, hi + slack)
    gap = F.when(F.col("vertical"), F.least(F.abs(F.col("x") - F.col("box.x0")), F.abs(F.col("x") - F.col("box.x1")))).otherwise(F.least(F.abs(F.col("y") - F.col("box.y0")), F.abs(F.col("y") - F.col("box.y1"))))
    hits = at.join(listed, [group, "vertical", "_k"]).where(near & (gap <= 3 * (F.col("box.y1") - F.col("box.y0"))))
    found = hits.groupBy(group, "tick_id").agg(F.count("*").alias("n_texts"), F.countDistinct("value").alias("n_values"), F.countDistinct("source").alias("n_sources"), F.bool_or(F.col("source") == PDF).alias("pdf"))
    status = F.when(F.col("n_values") > 1, "multiple_candidates").when(F.col("n_sources") > 1, "agreed").when(F.col("pdf"), "pdf_only").otherwise("ocr_only")
    return ticks.select(group, "tick_id").join(found, [group, "tick_id"], "left").select(group, "tick_id", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_values", F.lit(0)).alias("n_values"), status.alias("status"))


def nearest_value_text(hints: DataFrame, texts: DataFrame, group: str, radius: float, size: float = 64.0) -> DataFrame:
    """Rows (group, hint_id, text_id): the text with the hinted value nearest to the hinted pixel, PDF first, then by
    distance, then by id; hints have hint_id, value, at; texts text_id, value, lo, hi, source. Values equal to a billionth.
    """
    close = F.abs(F.col("value") - F.col("v")) <= F.greatest(F.lit(1e-12), 1e-9 * F.greatest(F.abs("value"), F.abs("v")))
    distance = F.greatest(F.col("lo") - F.col("at"), F.lit(0.0), F.col("at") - F.col("hi"))
    listed = texts.where("lo <= hi").select(group, "text_id", F.col("value").alias("v"), "lo", "hi", "source", F.explode(bucket_range(F.col("lo") - radius, F.col("hi") + radius, size)).alias("_k"))
    pairs = hints.withColumn("_k", F.floor(F.col("at") / size)).join(listed, [group, "_k"]).where(close & (distance <= radius))
    best = F.min_by("text_id", F.struct((F.col("source") != PDF).cast("int"), distance, F.col("text_id")))
    return pairs.groupBy(group, "hint_id").agg(best.alias("text_id"))


def two_point_fit(points: DataFrame, by: str, value: Column, pixel: Column, order: Column, tolerance: float) -> DataFrame:
    """Rows (by, slope, intercept, residual, n, n_close): the line through the widest pair of points of distinct values,
    and how the others lie. The widest pair is found from the outermost points, without pairing all: if those share a value,
    the next of another value on either side decides.
    """
    rows = points.select(by, value.cast("double").alias("v"), pixel.cast("double").alias("p"), order.alias("o")).where("v is not null and p is not null")
    low = F.min_by(F.struct("p", "v"), F.struct("p", "o"))
    high = F.max_by(F.struct("p", "v"), F.struct(F.col("p"), -F.col("o")))
    outer = rows.groupBy(by).agg(low.alias("a"), high.alias("b"))
    inner = rows.join(outer, by).groupBy(by).agg(
        F.first("a").alias("a"),
        F.first("b").alias("b"),
        F.min_by(F.struct("p", "v"), F.when(F.col("v") != F.col("b.v"), F.struct("p", "o"))).alias("a2"),
        F.max_by(F.struct("p", "v"), F.when(F.col("v") != F.col("a.v"), F.struct(F.col("p"), -F.col("o")))).alias("b2"),
    )
    wide = F.when(F.col("a.v") != F.col("b.v"), F.struct("a", "b"))
    left = F.when(F.col("a2").isNotNull(), F.struct(F.col("a2").alias("a"), F.col("b").alias("b")))
    right = F.when(F.col("b2").isNotNull(), F.struct(F.col("a").alias("a"), F.col("b2").alias("b")))
    other = F.when(F.coalesce(F.col("b2.p") - F.col("a.p"), F.lit(-1.0)) > F.coalesce(F.col("b.p") - F.col("a2.p"), F.lit(-1.0)), right).otherwise(left)
    pair = inner.select(by, F.coalesce(wide, other).alias("e")).where("e is not null and e.a.p <> e.b.p")
    slope = (F.col("e.b.p") - F.col("e.a.p")) / (F.col("e.b.v") - F.col("e.a.v"))
    lines = pair.select(by, slope.alias("slope"), (F.col("e.a.p") - slope * F.col("e.a.v")).alias("intercept"))
    off = F.abs(F.col("p") - (F.col("slope") * F.col("v") + F.col("intercept")))
    return rows.join(lines, by).groupBy(by).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.max(off).alias("residual"), F.count("*").alias("n"), F.count_if(off <= tolerance).alias("n_close"))


def anchored_fit(points: DataFrame, by: str, value: Column, center: Column, is_station: Column) -> DataFrame:
    """Rows (by, slope, intercept, monotone, n): slope by least squares over label centers, intercept through the one real
    station. Groups without exactly one station, or with under two labels, give no row.
    """
    rows = points.select(by, value.alias("v"), center.alias("c"), is_station.alias("s"))
    w = Window.partitionBy(by).orderBy("v", "c")
    step = F.lead("c").over(w) - F.col("c")
    fits = rows.withColumn("step", step).groupBy(by).agg(
        F.regr_slope("c", "v").alias("slope"),
        F.count_if("s").alias("k"),
        F.max_by("c", F.when(F.col("s"), 1)).alias("c0"),
        F.max_by("v", F.when(F.col("s"), 1)).alias("v0"),
        (F.coalesce(F.min("step") > 0, F.lit(False)) | F.coalesce(F.max("step") < 0, F.lit(False))).alias("monotone"),
        F.count("*").alias("n"),
    )
    return fits.where("k = 1 and n > 1").select(by, "slope", (F.col("c0") - F.col("slope") * F.col("v0")).alias("intercept"), "monotone", "n")


def merge_collinear(spines: DataFrame, by: str, radius: float) -> DataFrame:
    """Rows (by, x0, x1, coordinate, width, strength, n): pieces of one line joined along x0.

    A piece joins the cluster before it if the gap is at most `radius` and it lies within the larger width plus two pixels
    of the cluster's strength-weighted coordinate. The mean depends on the members, so it is a fold over sorted batches; the
    state carried on is one cluster.
    """
    columns = [by, "x0", "x1", "coordinate", "width", "strength"]
    rows = spines.select(*columns).repartition(by).sortWithinPartitions(by, "x0", "x1", "coordinate")
    kind = spines.schema[by].dataType.simpleString()

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list | None = None
        for part in parts:
            out = []
            for g, x0, x1, c, w, s in part[columns].itertuples(index=False, name=None):
                if now and now[0] == g and x0 <= now[2] + radius and abs(c - now[3] / now[5]) <= max(w, now[4]) + 2:
                    now = [g, min(now[1], x0), max(now[2], x1), now[3] + c * s, max(now[4], w), now[5] + s, now[6] + 1]
                else:
                    if now:
                        out.append(now)
                    now = [g, x0, x1, c * s, w, s, 1]
            yield _spines(out, by)
        if now:
            yield _spines([now], by)

    return rows.mapInPandas(fold, f"{by} {kind}, x0 double, x1 double, coordinate double, width double, strength double, n int")


def _spines(rows: list, by: str) -> pd.DataFrame:
    return pd.DataFrame([(g, a, b, c / s, w, s, n) for g, a, b, c, w, s, n in rows], columns=[by, "x0", "x1", "coordinate", "width", "strength", "n"])


def expand_axes(groups: DataFrame, key: str) -> DataFrame:
    """One row per y direction of a group: deterministic ids, display names, types; the first shares its x with the others
    if that is numeric. `groups` has key, group_index, x struct<name, scale>, ys array<struct<name, scale>>.
    """
    flat = groups.select(key, "group_index", "x", F.posexplode("ys").alias("y_index", "y"))
    axis = F.format_string("axis_%03d_%03d", F.col("group_index").cast("int"), F.col("y_index"))
    root = F.format_string("axis_%03d_000", F.col("group_index").cast("int"))
    x_cat, y_cat = F.col("x.scale") == "categorical", F.col("y.scale") == "categorical"
    kind = F.when(x_cat & y_cat, None).when(x_cat, "categorical_x_numeric_y").when(y_cat, "numeric_x_categorical_y").otherwise("xy")
    return flat.select(
        key,
        axis.alias("axis_id"),
        F.concat(F.col("x.name"), F.lit(" - "), F.col("y.name")).alias("display_name"),
        kind.alias("axis_type"),
        F.when((F.col("y_index") > 0) & ~x_cat, root).alias("shared_x_axis_id"),
    )


def expand_datasets(structures: DataFrame, key: str) -> DataFrame:
    """One row per dataset of a structure: deterministic id, owner, name, kind, group names of point groups."""
    flat = structures.select(key, F.posexplode("datasets").alias("i", "d"))
    names = F.when(F.col("d.kind") == "point_group", F.array(*map(F.lit, ("upper", "average", "lower")))).otherwise(F.array().cast("array<string>"))
    return flat.select(key, F.format_string("dataset_%03d", F.col("i")).alias("dataset_id"), F.col("d.axis").alias("axis_id"), F.col("d.name").alias("display_name"), F.col("d.kind").alias("kind"), names.alias("group_names"))


def axis_issues(axes: DataFrame, key: str) -> DataFrame:
    """Rows (key, code): structure rules that a figure's axes break."""
    pair = Window.partitionBy(key, F.lower("x_label"), F.lower("y_label"))
    checked = axes.withColumn("_same", F.count("*").over(pair))
    rules = {
        "no_numeric_direction": (F.col("x_scale") == "categorical") & (F.col("y_scale") == "categorical"),
        "placeholder_label": F.coalesce(F.lower("y_label").isin("x", "y", "axis", "unknown", ""), F.lit(True)),
        "unit_only_label": F.coalesce(F.col("y_label").rlike(r"^\s*[\[(].*[\])]\s*$"), F.lit(False)),
        "duplicate_axis_pair": F.col("_same") > 1,
    }
    found = F.array_compact(F.array(*(F.when(bad, F.lit(code)) for code, bad in rules.items())))
    return checked.select(key, F.explode(found).alias("code")).distinct()


def band_issues(datasets: DataFrame, key: str) -> DataFrame:
    """Rows (key, axis, base, code) of range bands whose roles are not exactly upper and lower, and of repeated names."""
    role = F.lower(F.regexp_extract("name", r"(?i)\b(upper|lower)\b", 1))
    base = F.btrim(F.regexp_replace(F.regexp_replace("name", r"(?i)\b(?:upper|lower)\b", " "), r"\s+", " "))
    bands = datasets.where("kind = 'range_boundary'").groupBy(key, "axis", base.alias("base")).agg(F.array_sort(F.collect_set(role)).alias("roles"), F.count("*").alias("n"))
    broken = bands.where((F.col("n") != 2) | ~F.col("roles").eqNullSafe(F.array(F.lit("lower"), F.lit("upper")))).select(key, "axis", "base", F.lit("incomplete_band").alias("code"))
    twice = datasets.groupBy(key, "axis", F.lower("name").alias("base")).agg(F.count("*").alias("n")).where("n > 1").select(key, "axis", "base", F.lit("duplicate_dataset").alias("code"))
    return broken.unionByName(twice)


def plot_project(axes: DataFrame, datasets: DataFrame, key: str) -> DataFrame:
    """Rows (key, project): a figure's axes, calibrations and datasets as one JSON text for a plot digitizer.

    `axes` has name, numeric (directions), log_x, log_y and points array<struct<direction, px, py, value>>; two numeric
    directions make XYAxes, one BarAxes; figures with an axis that lacks two points for a numeric direction give no row.
    """
    two = F.size("numeric") == 2
    enough = F.forall("numeric", lambda d: F.size(F.filter("points", lambda p: p["direction"] == d)) == 2)
    points = F.transform(
        "points",
        lambda p: F.struct(
            p["px"].alias("px"),
            p["py"].alias("py"),
            F.when(two & (p["direction"] == "x"), p["value"].cast("string")).otherwise("0").alias("dx"),
            F.when(~two | (p["direction"] == "y"), p["value"].cast("string")).otherwise("0").alias("dy"),
        ),
    )
    item = F.struct(F.col("name"), F.when(two, "XYAxes").otherwise("BarAxes").alias("type"), F.col("log_x").alias("isLogX"), F.col("log_y").alias("isLogY"), points.alias("calibrationPoints"))
    a = axes.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("axesColl"), F.bool_and(enough).alias("_ok")).where("_ok")
    d = datasets.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("name", F.col("axis").alias("axesName"), F.array().cast("array<int>").alias("data")))).alias("datasetColl"))
    empty = F.array().cast("array<int>")
    joined = a.join(d, key, "left")
    return joined.select(key, F.to_json(F.struct(F.array(F.lit(4), F.lit(2)).alias("version"), "axesColl", "datasetColl", empty.alias("measurementColl"))).alias("project"))
