"""Reading order and structure of extracted pages: lines, tokens, headings, captions, references, outlines."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolith.functions.identifiers import is_heading, parse_caption, parse_identifier
from foliolith.functions.text import join_lines


def styled_lines(spans: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows (keys, text, size, bold): the spans of a line in order as one text, the largest size, whether any is bold.
    Blank lines are left out.
    """
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    lines = spans.groupBy(*keys).agg(F.btrim(F.array_join(F.transform(parts, lambda x: x["text"]), "")).alias("text"), F.max("size").alias("size"), F.bool_or("bold").alias("bold"))
    return lines.where("text <> ''")


def char_tokens(chars: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows (keys, token_no, text, box): characters joined between white space; a raised character inside a token brings a
    `^` before the raised run; the box is the union of its characters'.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    blank = F.col("char").rlike("^\\s*$")
    marked = chars.withColumn("_word", F.sum(F.when(blank, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_first", F.lag(blank, 1, True).over(w)).withColumn("_raised", F.lag("raised", 1, False).over(w))
    shown = F.when(F.col("raised") & ~F.col("_raised") & ~F.col("_first"), F.concat(F.lit("^"), F.col("char"))).otherwise(F.col("char"))
    parts = F.array_sort(F.collect_list(F.struct(order, shown.alias("c"))))
    box = F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    words = marked.where(~blank).groupBy(*keys, "_word").agg(F.min(order).alias("_at"), F.array_join(F.transform(parts, lambda x: x["c"]), "").alias("text"), box.alias("box"))
    return words.withColumn("token_no", F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))).drop("_word", "_at")


def sections(lines: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """Rows (by, section, core, title, page, body): a heading opens a section, the lines after it are its body.

    A line opens a section if it may be a heading, stands out (bold, of size 9.5 or more, or short with a title) and its
    top number is the current one or the next; the first heading is a bold `1` of size 11 or more. The top number depends
    on what was accepted before, so acceptance is a fold over sorted batches with two integers of state; bodies are windows.
    """
    i = parse_identifier(F.col("text"))
    rows = lines.withColumn("_top", F.when(is_heading(F.col("text")), F.regexp_extract(i["core"], "^[0-9]+", 0).try_cast("int")))
    strong = F.coalesce(F.col("bold"), F.lit(False)) | (F.col("size") >= 9.5) | (F.length("text") <= 50)
    rows = rows.withColumn("_top", F.when(strong, F.col("_top"))).withColumn("_start", F.coalesce((F.col("_top") == 1) & F.col("bold") & (F.col("size") >= 11), F.lit(False)))
    rows = rows.repartition(by).sortWithinPartitions(by, *order)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, top, section = object(), 0, 0
        for part in parts:
            out = []
            for group, candidate, start in zip(part[by].tolist(), part["_top"].tolist(), part["_start"].tolist(), strict=True):
                if group != at:
                    at, top, section = group, 0, 0
                opens = candidate == candidate and candidate is not None and (start if not top else candidate in (top, top + 1))
                if opens:
                    top, section = int(candidate), section + 1
                out.append((section, bool(opens)))
            yield part.assign(section=pd.array([s for s, _ in out], dtype="int32"), opens=[o for _, o in out])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    marked = rows.mapInPandas(fold, f"{ddl}, section int, opens boolean").where("section > 0")
    parts = F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct(*order, "text"))))
    head = F.max(F.when(F.col("opens"), F.struct("text", "page")))
    grouped = marked.groupBy(by, "section").agg(head.alias("h"), join_lines(F.transform(parts, lambda x: x["text"])).alias("body"))
    parsed = grouped.withColumn("i", parse_identifier(F.col("h.text")))
    return parsed.select(by, "section", F.col("i.core").alias("core"), F.btrim(F.substring(F.col("h.text"), F.col("i.end") + 1, F.length("h.text"))).alias("title"), F.col("h.page").alias("page"), "body")


def page_captions(lines: DataFrame, by: Sequence[str], order: str, kind: str) -> DataFrame:
    """Rows (by, order, match_key, title) of captions on a page: a line that parses alone, or together with the next."""
    w = Window.partitionBy(*by).orderBy(order)
    both = F.concat_ws(" ", F.col("text"), F.lead("text").over(w))
    found = F.coalesce(parse_caption(F.col("text"), kind), parse_caption(both, kind))
    return lines.withColumn("_c", found).where("_c is not null").select(*by, order, F.col("_c.identifier.match_key").alias("match_key"), F.col("_c.title").alias("title")).dropDuplicates([*by, "match_key", "title"])


def continued_captions(lines: DataFrame, by: str) -> DataFrame:
    """Rows (by, caption_no, text, n_lines): a caption line and the lines below that go on with it, until a new caption, a
    gap above the line height or no horizontal overlap with the caption so far. A fold over sorted batches.
    """
    rows = lines.withColumn("_new", parse_caption(F.col("text")).isNotNull()).select(by, "text", "x0", "y0", "x1", "y1", "_new")
    rows = rows.repartition(by).sortWithinPartitions(by, "y0", "x0")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list | None = None
        number = 0
        for part in parts:
            out = []
            for g, text, x0, y0, x1, y1, new in part.itertuples(index=False, name=None):
                if now and (now[0] != g or new or y0 - now[4] > y1 - y0 or x0 > now[3] or x1 < now[2]):
                    out.append((now[0], now[5], " ".join(now[1]), len(now[1])))
                    number = number if now[0] == g else 0
                    now = None
                if new:
                    number += 1
                    now = [g, [text], x0, x1, y1, number]
                elif now:
                    now = [g, [*now[1], text], min(now[2], x0), max(now[3], x1), y1, now[5]]
            yield pd.DataFrame(out, columns=[by, "caption_no", "text", "n_lines"])
        if now:
            yield pd.DataFrame([(now[0], now[5], " ".join(now[1]), len(now[1]))], columns=[by, "caption_no", "text", "n_lines"])

    return rows.mapInPandas(fold, f"{by} {lines.schema[by].dataType.simpleString()}, caption_no int, text string, n_lines int")


def reference_pages(pages: DataFrame, by: str) -> DataFrame:
    """Pages with kind front or reference: references begin at the first page with that heading and go on while pages have
    numbered blocks and no figure or table heading. `pages` has page, is_references, has_numbered, has_heading.
    """
    first = F.min(F.when(F.col("is_references"), F.col("page"))).over(Window.partitionBy(by))
    w = Window.partitionBy(by).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    after = pages.withColumn("_first", first)
    goes_on = (F.col("page") == F.col("_first")) | (F.col("has_numbered") & ~F.col("has_heading"))
    held = F.min(F.when(F.col("page") >= F.col("_first"), goes_on.cast("int"))).over(w)
    return after.withColumn("kind", F.when((F.col("page") >= F.col("_first")) & (held == 1), "reference").otherwise("front")).drop("_first")


def outline_order(matches: DataFrame, by: str, order: str) -> DataFrame:
    """Adds `order_issue`: the matched section lies before one that an earlier outline entry matched (running maximum)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return matches.withColumn("order_issue", F.coalesce(F.col("sequence") < F.max("sequence").over(w), F.lit(False)))


def figure_assets(nodes: DataFrame, assets: DataFrame) -> DataFrame:
    """Rows (node_id, asset_id, how): assets of figure nodes by equal key, or, for a node without suffix, the panels that
    share its core and are no nodes of their own. `nodes` has node_id, core, suffix, key; `assets` asset_id, core, suffix, key.
    """
    a = assets.select("asset_id", F.col("core").alias("a_core"), F.col("suffix").alias("a_suffix"), F.col("key").alias("a_key"))
    exact = nodes.join(a, F.col("key") == F.col("a_key")).select("node_id", "asset_id", F.lit("exact").alias("how"))
    panels = a.where("a_suffix <> ''").join(nodes.select(F.col("key").alias("a_key")).distinct(), "a_key", "left_anti")
    implied = nodes.where("suffix = ''").join(panels, F.col("core") == F.col("a_core")).select("node_id", "asset_id", F.lit("panel").alias("how"))
    return exact.unionByName(implied)


def reparse(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows (identity, status): what a second reading does to stored tables. Both sides have key, synthetic_id,
    candidate_id, pages. Identity is the first of them that isn't empty; pages may only shrink: updated, grown (an error),
    new or gone.
    """
    none = F.array().cast("array<int>")
    side = lambda df, p: df.select(F.coalesce(*(F.nullif(c, F.lit("")) for c in ("key", "synthetic_id", "candidate_id"))).alias("identity"), F.coalesce("pages", none).alias(p)).where("identity is not null").groupBy("identity").agg(F.array_distinct(F.flatten(F.collect_list(p))).alias(p))
    both = side(stored, "was").join(side(fresh, "now"), "identity", "full")
    grown = F.size(F.array_except("now", "was")) > 0
    return both.select("identity", F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(grown, "grown").otherwise("updated").alias("status"))


def ranked_examples(texts: DataFrame, examples: Mapping[str, Sequence[str]], key: str) -> DataFrame:
    """Rows (key, example, score, rank): examples by the number of their cues that a text contains, white space aside.

    The examples are a fixed table of the program, so they are literals of the plan: no join.
    """
    bare = F.lower(F.regexp_replace("text", "\\s+", ""))
    score = lambda t, cues: sum((F.contains(t, F.lit("".join(c.lower().split()))).cast("int") for c in cues), F.lit(0))
    scored = F.transform(F.array(bare), lambda t: F.array(*(F.struct(F.lit(name).alias("example"), score(t, cues).alias("score")) for name, cues in sorted(examples.items()))))
    flat = texts.select(key, F.inline(F.get(scored, F.lit(0))))
    return flat.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "example")))


def source_pages(explicit: Column, target: Column, catalog: Column, regions: Column) -> Column:
    """Pages of a node: the explicit ones, else its target, else those of its catalog entry and text regions."""
    none = F.array().cast("array<int>")
    fallback = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce(catalog, none), F.coalesce(regions, none)))))
    return F.when(F.size(F.coalesce(explicit, none)) > 0, F.array_sort(F.array_distinct(explicit))).when(target.isNotNull(), F.array(target)).otherwise(fallback)


def related_name(page: Column, kind: Column, key: Column) -> Column:
    """File name of a related page: page of four digits or more, kind of at most 24 signs, id of at most 40."""
    plain = lambda c, n: F.substring(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9.-]+", "_"), F.lit("_")), 1, n)
    return F.concat(F.lit("p"), F.when(page.isNotNull(), F.format_string("%04d", page.cast("bigint"))), F.lit("_"), plain(kind, 24), F.lit("_"), plain(key, 40), F.lit(".pdf"))


def combined(parts: DataFrame, by: str) -> DataFrame:
    """Rows (by, row_offset, component_offset ...) of the parts of tables stacked in order: the offsets by which rows, cells
    and components of each part move. `parts` has order, n_rows, n_components.
    """
    w = Window.partitionBy(by).orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("row_offset", F.coalesce(F.sum("n_rows").over(w), F.lit(0))).withColumn("component_offset", F.coalesce(F.sum("n_components").over(w), F.lit(0)))


def voted_side(texts: DataFrame, by: str, center: Column, coordinate: Column) -> DataFrame:
    """Rows (by, side): the side of the axis on which more texts lie; ties go to side 0."""
    counts = texts.groupBy(by).agg(F.count_if(center < coordinate).alias("before"), F.count_if(center > coordinate).alias("after"))
    return counts.select(by, F.when(F.col("after") > F.col("before"), 1).otherwise(0).alias("side"))
