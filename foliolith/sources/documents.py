"""Readers and sinks for documents: JSON blocks of any depth, page files, Markdown notes, spreadsheets, raster lines."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.functions.numbers import column_letters, sheet_value
from foliolith.functions.text import yaml_list, yaml_quoted


def walk_blocks(value: object) -> Iterator[dict]:
    """Every object with a `type`, in document order, at any depth; inside such an object nothing is looked for."""
    stack = [value]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            if "type" in node:
                yield node
            else:
                stack.extend(reversed(node.values()))
        elif isinstance(node, list):
            stack.extend(reversed(node))


def json_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, block_index, type, block, error): the blocks of JSON documents; block is the object as JSON. A document
    that isn't valid gives one row with the error; null and empty ones give none.
    """
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, block_index int, type string, block string, error string"

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                if not value:
                    continue
                try:
                    found = [(i, str(b["type"]), json.dumps(b, ensure_ascii=False), None) for i, b in enumerate(walk_blocks(json.loads(value)))]
                except (ValueError, RecursionError) as wrong:
                    found = [(None, None, None, str(wrong)[:200])]
                at.extend([k] * len(found))
                rows.extend(found)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = (pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, "block_index", "type", "block", "error"])

    return texts.select(key, text).mapInArrow(read, schema)


def page_files(spark: SparkSession, folder: str, expected: int) -> DataFrame:
    """Rows (page, path, status) of files `page_<4 or more digits>.pdf`: ok, duplicate, extra or missing of 1..expected.

    Only names are listed (the content column is pruned); the check is one full join.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    number = F.regexp_extract("path", r"(?i)(?:^|/)page_([0-9]{4,9})\.pdf$", 1).try_cast("int")
    found = files.select(number.alias("page"), "path").where("page is not null").groupBy("page").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    wanted = spark.range(1, expected + 1).select(F.col("id").cast("int").alias("page"), F.lit(1).alias("w"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("w").isNull(), "extra").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return wanted.join(found, "page", "full").select("page", "path", status.alias("status"))


def markdown_notes(candidates: DataFrame) -> DataFrame:
    """Rows (candidate_id, markdown): front matter, caption, pages and footnotes of each candidate as a Markdown note."""
    pages = F.array_join(F.transform(F.coalesce("source_physical_pages", F.array().cast("array<int>")), lambda p: p.cast("string")), ", ")
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), yaml_quoted(F.col("candidate_id"))), F.concat(F.lit("pages: "), yaml_list(F.transform(F.coalesce("source_physical_pages", F.array().cast("array<int>")), lambda p: p.cast("string")))), F.lit("---"))
    return candidates.where("candidate_id is not null").select("candidate_id", F.concat_ws("\n\n", front, F.concat(F.lit("# "), F.coalesce("caption", F.lit("Untitled"))), F.concat(F.lit("Pages: "), pages), F.nullif("footnotes", F.lit(""))).alias("markdown"))


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>'
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_REL = '<Relationship Id="rId{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(sheets: list[tuple[str, list[tuple[str, int, str, str | None]], list[str]]]) -> bytes:
    """Bytes of a spreadsheet file: for each sheet its name, cells (letters, row, type, text) and merged ranges."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ids = range(1, len(sheets) + 1)
        z.writestr("[Content_Types].xml", _TYPES.format("".join(_SHEET_TYPE.format(i) for i in ids)))
        z.writestr("_rels/.rels", _RELS.format(_REL.format(1, "officeDocument", "xl/workbook.xml")))
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format("".join(_REL.format(i, "worksheet", f"worksheets/sheet{i}.xml") for i in ids)))
        names = "".join(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (name, _, _) in zip(ids, sheets, strict=True))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        for i, (_, cells, merges) in zip(ids, sheets, strict=True):
            rows: dict[int, list[str]] = {}
            for letters, row, kind, text in cells:
                at = f'r="{letters}{row}"'
                number = kind in ("int", "float")
                rows.setdefault(row, []).append(f"<c {at}><v>{text}</v></c>" if number else f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(text or "")}</t></is></c>')
            body = "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in sorted(rows.items()))
            joined = f'<mergeCells count="{len(merges)}">{"".join(f"<mergeCell ref={chr(34)}{m}{chr(34)}/>" for m in merges)}</mergeCells>' if merges else ""
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData>{joined}</worksheet>')
    return out.getvalue()


def workbooks(cells: DataFrame, key: str) -> DataFrame:
    """Rows (key, xlsx) from cells (key, sheet, row, column, rowspan, colspan, text): typed values, merged ranges that end
    inside the sheet, texts that begin with = kept as texts. One record's cells at a time.
    """
    typed = sheet_value(F.col("text"))
    cell = F.struct("sheet", "row", "column", column_letters(F.col("column")).alias("letters"), typed["type"].alias("kind"), "text", "rowspan", "colspan", column_letters(F.col("column") + F.col("colspan") - 1).alias("last"))
    grouped = cells.groupBy(key).agg(F.array_sort(F.collect_list(cell)).alias("cells"))

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = []
            for found in part["cells"]:
                sheets: dict[str, tuple[list, list]] = {}
                height: dict[str, int] = {}
                for c in found:
                    height[c["sheet"]] = max(height.get(c["sheet"], 0), c["row"])
                for c in found:
                    values, merges = sheets.setdefault(c["sheet"], ([], []))
                    values.append((c["letters"], c["row"], c["kind"], c["text"]))
                    end = c["row"] + c["rowspan"] - 1
                    if (c["rowspan"] > 1 or c["colspan"] > 1) and end <= height[c["sheet"]]:
                        merges.append(f"{c['letters']}{c['row']}:{c['last']}{end}")
                made.append(workbook([(name or "Sheet", v, m) for name, (v, m) in sheets.items()]))
            yield pd.DataFrame({key: part[key], "xlsx": made})

    return grouped.mapInPandas(build, f"{key} {cells.schema[key].dataType.simpleString()}, xlsx binary")


def ink(image: np.ndarray, threshold: int = 210) -> np.ndarray:
    """Mask of dark pixels of a grey or color image."""
    grey = image if image.ndim == 2 else image[..., :3].mean(axis=2)
    return grey < threshold


def spines(mask: np.ndarray) -> list[tuple[str, int, int, int, int, float, int]]:
    """Long straight strokes of an ink mask: (orientation, x0, y0, x1, y1, coordinate, strength), borders included.

    A pixel counts if it lies in a run of at least max(21, side / 13) dark pixels along the direction; touching runs on
    neighbouring lines are one stroke, and its coordinate is the mean over its pixels.
    """
    found = []
    for orientation, grid in (("horizontal", mask), ("vertical", mask.T)):
        least = max(21, grid.shape[1] // 13)
        runs: list[list[int]] = []
        for line in range(grid.shape[0]):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], grid[line].astype(np.int8), [0]))))
            runs += [[line, a, b - 1] for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]
        parent = list(range(len(runs)))

        def root(i: int) -> int:
            while parent[i] != i:  # noqa: B023
                parent[i] = parent[parent[i]]  # noqa: B023
                i = parent[i]  # noqa: B023
            return i

        last: dict[int, list[int]] = {}
        for i, (line, a, b) in enumerate(runs):
            for j in last.get(line - 1, []):
                if runs[j][1] <= b + 1 and a <= runs[j][2] + 1:
                    parent[root(i)] = root(j)
            last.setdefault(line, []).append(i)
        groups: dict[int, list[list[int]]] = {}
        for i, run in enumerate(runs):
            groups.setdefault(root(i), []).append(run)
        for members in groups.values():
            lines = [m[0] for m in members]
            weight = [m[2] - m[1] + 1 for m in members]
            a, b = min(m[1] for m in members), max(m[2] for m in members)
            coordinate = float(np.dot(lines, weight) / sum(weight))
            box = (a, min(lines), b, max(lines)) if orientation == "horizontal" else (min(lines), a, max(lines), b)
            found.append((orientation, *map(int, box), coordinate, int(sum(weight))))
    return found


def tick_marks(mask: np.ndarray, spine: tuple, width: int) -> list[float]:
    """Positions along a spine where ink leaves it sideways for at least 2 * width + 3 pixels; runs count at their center."""
    orientation, x0, y0, x1, y1, coordinate, _ = spine
    grid = mask if orientation == "horizontal" else mask.T
    line, a, b = round(coordinate), (x0 if orientation == "horizontal" else y0), (x1 if orientation == "horizontal" else y1)
    reach = 2 * width + 3
    half = width // 2 + 1
    marks = []
    for side in (grid[line + half : line + half + reach, a : b + 1], grid[max(0, line - half - reach + 1) : line - half + 1, a : b + 1]):
        if len(side) >= reach:
            marks.append(side.all(axis=0))
    if not marks:
        return []
    at = np.flatnonzero(np.logical_or.reduce(marks))
    return [float(g.mean() + a) for g in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(g)]


def image_spines(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (path, orientation, x0, y0, x1, y1, coordinate, strength, n_ticks) of the images in a folder, decoded by Spark."""
    images = spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def detect(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for origin, h, w, c, data in part.itertuples(index=False, name=None):
                mask = ink(np.frombuffer(data, np.uint8).reshape(h, w, c) if c > 1 else np.frombuffer(data, np.uint8).reshape(h, w))
                for s in spines(mask):
                    width = (s[4] - s[2] if s[0] == "horizontal" else s[3] - s[1]) + 1
                    out.append((origin, *s, len(tick_marks(mask, s, width))))
            yield pd.DataFrame(out, columns=["path", "orientation", "x0", "y0", "x1", "y1", "coordinate", "strength", "n_ticks"])

    return images.mapInPandas(detect, "path string, orientation string, x0 int, y0 int, x1 int, y1 int, coordinate double, strength int, n_ticks int")
