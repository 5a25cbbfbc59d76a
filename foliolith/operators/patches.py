"""Grid and record edits: cell patches, row and column shifts, spans, ordered folds, validation of reviews."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("grid_id", "row", "column")


def set_cells(cells: DataFrame, patches: DataFrame) -> DataFrame:
    """Cells after `patches` (grid_id, row, column, before, after) with a status for each: `applied` where the cell has the
    expected text, `stale` where it hasn't, `none` without a patch. One patch per cell; addresses outside give no row here,
    see `outside`. Null texts compare like texts.
    """
    p = patches.select(*KEYS, "before", "after", F.lit(True).alias("_p"))
    joined = cells.join(p, list(KEYS), "left")
    fits = F.col("before").eqNullSafe(F.col("text"))
    status = F.when(F.col("_p").isNull(), "none").when(fits, "applied").otherwise("stale")
    return joined.withColumn("status", status).withColumn("text", F.when(F.col("status") == "applied", F.col("after")).otherwise(F.col("text"))).drop("before", "after", "_p")


def outside(cells: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches whose address is not in the grid."""
    return patches.join(cells.select(*KEYS), list(KEYS), "left_anti")


def insert_line(cells: DataFrame, edits: DataFrame, axis: str) -> DataFrame:
    """Cells with an empty row or column inserted before `at` of each edited grid (grid_id, at); spans keep their address."""
    other = "column" if axis == "row" else "row"
    e = edits.select("grid_id", F.col("at").alias("_at"))
    moved = cells.join(e, "grid_id", "left").withColumn(axis, F.when(F.col(axis) >= F.col("_at"), F.col(axis) + 1).otherwise(F.col(axis)).cast("int")).drop("_at")
    width = cells.groupBy("grid_id").agg(F.max(other).alias("_n"))
    fresh = e.join(width, "grid_id").select("grid_id", F.col("_at").cast("int").alias(axis), F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias(other), F.lit("").alias("text"))
    return moved.select(*KEYS, "text").unionByName(fresh.select(*KEYS, "text"))


def delete_line(cells: DataFrame, edits: DataFrame, axis: str) -> DataFrame:
    """Cells without the row or column `at` of each edited grid; later ones move up."""
    joined = cells.join(edits.select("grid_id", F.col("at").alias("_at")), "grid_id", "left").where(F.col("_at").isNull() | (F.col(axis) != F.col("_at")))
    return joined.withColumn(axis, F.when(F.col(axis) > F.col("_at"), F.col(axis) - 1).otherwise(F.col(axis)).cast("int")).select(*KEYS, "text")


def covered(cells: DataFrame, key: str) -> DataFrame:
    """Rows (key, row, column): grid positions that a spanning cell covers besides its anchor."""
    wide = cells.where((F.col("rowspan") > 1) | (F.col("colspan") > 1))
    rows = F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)
    columns = F.sequence(F.col("column"), F.col("column") + F.col("colspan") - 1)
    flat = wide.select(key, F.col("row").alias("_r"), F.col("column").alias("_c"), F.explode(rows).alias("row"), "colspan", columns.alias("_cs"))
    return flat.select(key, "_r", "_c", "row", F.explode("_cs").alias("column")).where("row <> _r or column <> _c").select(key, "row", "column").distinct()


def offsets(parts: DataFrame, by: str, order: str, size: str) -> DataFrame:
    """Adds `offset`: rows of the earlier parts; what stacks grids and cuts them apart again."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


class EditError(ValueError):
    """An operation that does not fit the state before it."""


def _place(target: dict, name: str, most: int) -> int:
    """A 1-based place named by an operation, as an index."""
    value = target.get(name)
    if type(value) is not int or not 0 < value <= most:
        raise EditError(f"{name} is outside the grid")
    return value - 1


def _square(rows: list[list[str]]) -> int:
    """Make all rows as wide as the widest; the width."""
    width = max(map(len, rows), default=0)
    for row in rows:
        row.extend([""] * (width - len(row)))
    return width


def _cell(state: dict, target: dict, after: object):  # noqa: ANN202
    row = state["rows"][_place(target, "row", len(state["rows"]))]
    at = _place(target, "column", len(row))
    return row[at], lambda: row.__setitem__(at, after)


def _new_row(state: dict, target: dict, after: object):  # noqa: ANN202
    at = _place(target, "row", len(state["rows"]) + 1)
    return None, lambda: state["rows"].insert(at, list(after))


def _old_row(state: dict, target: dict, after: object):  # noqa: ANN202
    at = _place(target, "row", len(state["rows"]))
    return state["rows"][at], lambda: state["rows"].pop(at)


def _new_column(state: dict, target: dict, after: object):  # noqa: ANN202
    rows = state["rows"]
    at = _place(target, "column", _square(rows) + 1)
    if len(after) != len(rows):
        raise EditError("the column has another length than the grid")
    return None, lambda: [row.insert(at, value) for row, value in zip(rows, after, strict=True)]


def _old_column(state: dict, target: dict, after: object):  # noqa: ANN202
    at = _place(target, "column", _square(state["rows"]))
    return [row[at] for row in state["rows"]], lambda: [row.pop(at) for row in state["rows"]]


def _merge(there: bool):  # noqa: ANN202
    def handler(state: dict, target: dict, after: object):  # noqa: ANN202
        now = set(state["merges"])
        named = {target["range"]}
        return named <= now, lambda: state.update(merges=sorted(now | named if there else now - named))

    return handler


def _metadata(state: dict, target: dict, after: object):  # noqa: ANN202
    name = target.get("field")
    if name not in METADATA:
        raise EditError(f"{name} can't be edited")
    return state["metadata"].get(name), lambda: state["metadata"].update({name: after})


def _grid(state: dict, target: dict, after: object):  # noqa: ANN202
    rows = state["rows"]
    shape = {"rows": len(rows), "columns": max(map(len, rows), default=0)}
    grid = after if isinstance(after, dict) else {"rows": after}
    return (rows, shape), lambda: state.update(rows=[list(r) for r in grid["rows"]], merges=sorted(grid.get("merges") or ()))


#: Metadata that may be edited. Fixed values.
METADATA = ("caption", "footnotes", "node_id_raw")
#: Of each operation how to find what it must know before, and how to carry it out.
HANDLERS = {
    "set_cell": _cell,
    "insert_row": _new_row,
    "delete_row": _old_row,
    "insert_column": _new_column,
    "delete_column": _old_column,
    "merge_cells": _merge(True),
    "unmerge_cells": _merge(False),
    "set_metadata": _metadata,
    "replace_grid": _grid,
}


def apply_operation(state: dict, op: dict) -> None:
    """Apply one operation to {rows, merges, metadata, notes} in place, or raise EditError.

    Every operation but a note states what it expects before: the cell's text, the whole row or column, null for
    insertions, whether a merge is there, the metadata's value, the grid's shape or rows. A merge that is there already
    stays, one that isn't there can't be undone twice. A new grid brings its own merges.
    """
    if op.get("op") == "add_note":
        state["notes"].append(op.get("after"))
        return
    handler = HANDLERS.get(op.get("op"))
    if handler is None:
        raise EditError(f"unknown operation {op.get('op')}")
    known, carry_out = handler(state, op.get("target") or {}, op.get("after"))
    stated = op.get("before")
    if stated not in known if isinstance(known, tuple) else stated != known:
        raise EditError("what is there differs from what the operation expects")
    carry_out()


def apply_patches(candidates: DataFrame, patches: DataFrame) -> DataFrame:
    """Rows (candidate_id, state, applied, error): ordered edits of each candidate, each seeing the result of the ones
    before; the first that doesn't fit undoes all of them.

    `candidates` has candidate_id and state (JSON of rows, merges, metadata, notes); `patches` has candidate_id, op_no and
    op (JSON). Edits are collected per candidate in a bounded list (one review's) and folded in an Arrow map: no group
    ever meets in one task beyond its own edits.
    """
    edits = patches.groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("op_no", "op"))), lambda x: x["op"]).alias("ops"))
    joined = candidates.select("candidate_id", "state").join(edits, "candidate_id", "left")

    def fold(parts):  # noqa: ANN001, ANN202
        for part in parts:
            out = []
            for state, ops in zip(part["state"], part["ops"], strict=True):
                if ops is None or not len(ops):
                    out.append((state, 0, None))
                    continue
                now = {"rows": [], "merges": [], "metadata": {}, "notes": []} | json.loads(state)
                try:
                    for op in ops:
                        apply_operation(now, json.loads(op))
                    out.append((json.dumps(now, ensure_ascii=False, sort_keys=True), len(ops), None))
                except (EditError, ValueError, TypeError, KeyError) as wrong:
                    out.append((state, 0, str(wrong) or type(wrong).__name__))
            made = pd.DataFrame(out, columns=["state", "applied", "error"], index=part.index)
            yield pd.concat([part["candidate_id"], made], axis=1).astype({"applied": "int32"})

    return joined.mapInPandas(fold, "candidate_id string, state string, applied int, error string")


def broken_rules(rows: DataFrame, key: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """Rows (key, rule) for every rule whose condition is false; an unknown condition counts as broken."""
    found = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.select(*key, F.explode(found).alias("rule"))


def patch_rules() -> dict[str, Column]:
    """Rules of a review patch joined with its candidate (c_ columns): versions, identity, decision, coverage."""
    ops, open_ = F.size("operations"), F.size("unresolved")
    pages = lambda c: F.array_sort(F.array_distinct(F.col(c)))
    return {
        "version": (F.col("schema_version") == 1) & (F.col("contract_version") == "2.0"),
        "identity": F.col("candidate_id") == F.col("c_candidate_id"),
        "decision": F.col("decision").isin("accept", "patch", "partial"),
        "accepted_without_operations": (F.col("decision") != "accept") | ((ops == 0) & (open_ == 0)),
        "patched_with_operations": (F.col("decision") != "patch") | (ops > 0),
        "partial_with_unresolved": (F.col("decision") == "partial") == (open_ > 0),
        "page_coverage": pages("reviewed_source_pages") == pages("c_pages"),
        "issue_bijection": F.array_sort(F.col("resolved_codes")) == F.array_sort(F.col("c_issue_codes")),
        "unique_operations": ops == F.size(F.array_distinct(F.transform("operations", lambda o: o["op_id"]))),
        "confidence": F.forall("operations", lambda o: o["confidence"].isin("high", "medium")),
        "evidence_pages": F.forall("operations", lambda o: F.size(F.array_except(o["pages"], F.col("c_pages"))) == 0),
    }
