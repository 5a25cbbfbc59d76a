"""Columnar shredding of nested records into linked flat tables.

Every leaf path of an Arrow batch becomes three aligned sequences: repetition level, definition level and value.
Tables of any repeated ancestor are then rebuilt from the levels alone: an entry whose repetition level is at most the
ancestor's begins an element, its definition level tells whether the element is there, and running counts between
restarts give the element's position in each enclosing list. All steps are vectors; records never become Python objects.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Step of a leaf path that enters the elements of a list.
EACH = "[]"


class Levels(NamedTuple):
    """One leaf path, shredded. `slot[k]` is the definition level of a list slot at repetition level k+1."""

    repetition: np.ndarray
    definition: np.ndarray
    value: pa.Array
    slot: tuple[int, ...]


def shred(column: pa.Array, path: Sequence[str]) -> Levels:
    """Levels and values of the leaf at `path` below a column; EACH enters a list, other steps are field names."""
    n = len(column)
    at = np.arange(n, dtype=np.int64)
    repetition, definition = np.zeros(n, np.int32), np.zeros(n, np.int32)
    slots: list[int] = []
    depth = 0

    def valid() -> np.ndarray:
        there = at >= 0
        if len(column):
            there[there] = np.asarray(column.is_valid())[at[there]]
        return there

    for step in path:
        there = valid()
        definition[there] += 1
        depth += 1
        at = np.where(there, at, -1)
        if step != EACH:
            column = column.field(step)
            continue
        offsets = np.asarray(column.offsets, np.int64)
        safe = np.maximum(at, 0)
        length = np.where(there, offsets[safe + 1] - offsets[safe], 0) if len(offsets) > 1 else np.zeros(len(at), np.int64)
        count = np.maximum(length, 1)
        owner = np.repeat(np.arange(len(at)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        filled = length[owner] > 0
        begin = offsets[safe[owner]] if len(offsets) > 1 else np.zeros(len(owner), np.int64)
        slots.append(depth + 1)
        depth += 1
        repetition = np.where(nth == 0, repetition[owner], len(slots)).astype(np.int32)
        definition = definition[owner] + filled.astype(np.int32)
        at = np.where(filled, begin + nth, -1)
        column = column.values
    there = valid()
    definition[there] += 1
    return Levels(repetition, definition, column.take(pa.array(at, pa.int64(), mask=~there)), tuple(slots))


class Elements(NamedTuple):
    """Elements of one repeated ancestor: index of the record, 1-based positions (outermost first), entry in the levels."""

    record: np.ndarray
    positions: list[np.ndarray]
    entry: np.ndarray


def elements(levels: Levels, depth: int | None = None) -> Elements:
    """Elements at repetition level `depth` (the deepest by default) that are not null, read from the level sequences."""
    k = depth or len(levels.slot)
    entry = np.flatnonzero(levels.repetition <= k)
    repetition = levels.repetition[entry]
    record = np.cumsum(repetition == 0) - 1
    positions = []
    index = np.arange(len(entry))
    for level in range(1, k + 1):
        count = np.cumsum(repetition <= level)
        restart = np.maximum.accumulate(np.where(repetition < level, index, 0)) if len(index) else index
        positions.append(count - count[restart] + 1 if len(index) else count)
    there = levels.definition[entry] > levels.slot[k - 1]
    return Elements(record[there], [p[there].astype(np.int32) for p in positions], entry[there])


def values_at_key(text: str | None, key: str) -> list:
    """Entries of every value under `key` at any depth of a JSON text, in document order; [] if it isn't valid JSON.

    A list gives its entries, any other value is one entry. Nesting beyond the parser's limit counts as not valid.
    """
    if not text:
        return []
    try:
        found = json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return []
    out: list = []
    stack = [iter([found])]
    while stack:
        node = next(stack[-1], stack)
        if node is stack:
            stack.pop()
            continue
        if isinstance(node, tuple):
            if node[0] == key:
                out.extend(node[1] if isinstance(node[1], list) else [node[1]])
            node = node[1]
        if isinstance(node, dict):
            stack.append(iter(node.items()))
        elif isinstance(node, list):
            stack.append(iter(node))
    return out


def _refuse(name: str) -> None:
    raise ValueError(name)


def _links(levels_child: Levels, child: Elements, levels_target: Levels, target: Elements) -> np.ndarray:
    """Position of the first target element of the same record with the child's value, 0 if none."""
    wanted = pd.DataFrame({"record": child.record, "id": levels_child.value.take(pa.array(child.entry)).to_pandas()})
    if not len(wanted):
        return np.zeros(0, np.int32)
    near = np.isin(target.record, np.unique(child.record))
    have = pd.DataFrame({"record": target.record[near], "id": levels_target.value.take(pa.array(target.entry[near])).to_pandas(), "at": target.positions[-1][near]})
    have = have.dropna(subset=["id"]).drop_duplicates(["record", "id"])
    return wanted.merge(have, "left", on=["record", "id"])["at"].fillna(0).to_numpy(np.int32)


def candidate_links(candidates: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows (key, entity, parent_pos, pos) of every nested element of table candidates.

    Entities: component, grid_cell, component_cell (parent: its component), media (parent: the first grid cell with its
    cell_id, 0 if none or null), issue, and issue_cell (entries of `cells` in the issue's JSON, parent: the issue).
    Positions start at 1 and count null elements, which give no row; null or empty lists and structs give none; repeated
    rows and keys are all kept; columns besides those read are ignored. A map over the scan, without a shuffle.
    """
    schema = f"{key} {candidates.schema[key].dataType.simpleString()}, entity string, parent_pos int, pos int"

    def flatten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, components, grid, issues = batch.columns
            parts: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []

            def add(entity: str, record: np.ndarray, parent: np.ndarray | int, pos: np.ndarray) -> None:
                parts.append((entity, record, np.broadcast_to(np.asarray(parent, np.int32), record.shape), pos))  # noqa: B023

            own = elements(shred(components, (EACH, "component_id")))
            add("component", own.record, 0, own.positions[0])
            inner = elements(shred(components, (EACH, "grid", "cells", EACH, "cell_id")))
            add("component_cell", inner.record, inner.positions[0], inner.positions[1])
            cell_levels = shred(grid, ("cells", EACH, "cell_id"))
            cells = elements(cell_levels)
            add("grid_cell", cells.record, 0, cells.positions[0])
            media_levels = shred(grid, ("embedded_media", EACH, "cell_id"))
            media = elements(media_levels)
            add("media", media.record, _links(media_levels, media, cell_levels, cells), media.positions[0])
            issue_levels = shred(issues, (EACH, "extra"))
            issue = elements(issue_levels)
            add("issue", issue.record, 0, issue.positions[0])
            extra = issue_levels.value.take(pa.array(issue.entry)).dictionary_encode()
            entries = [[x is not None for x in values_at_key(t, "cells")] for t in extra.dictionary.to_pylist()]
            which = [(i, n) for i, d in enumerate(extra.indices.to_pylist()) if d is not None for n, there in enumerate(entries[d], 1) if there]
            at = np.array([i for i, _ in which], np.int64)
            add("issue_cell", issue.record[at], issue.positions[0][at], np.array([n for _, n in which], np.int32))
            record = np.concatenate([p[1] for p in parts])
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(record)),
                    pa.array(np.repeat(np.array([p[0] for p in parts], object), [len(p[1]) for p in parts]), pa.string()),
                    pa.array(np.concatenate([p[2] for p in parts]), pa.int32()),
                    pa.array(np.concatenate([p[3] for p in parts]).astype(np.int32), pa.int32()),
                ],
                [key, "entity", "parent_pos", "pos"],
            )

    return candidates.select(key, "components", "grid", "issues").mapInArrow(flatten, schema)


def flat_table(df: DataFrame, key: str, column: str, path: Sequence[str], leaves: dict[str, str], parents: Sequence[str] = ()) -> DataFrame:
    """The flat table of one repeated ancestor: key, a position per enclosing list, and the named leaves.

    `path` leads from `column` to the list (its last step is EACH); `parents` names the positions of the outer lists;
    `leaves` gives each leaf field's SQL type. Null elements give no row but keep their position.
    """
    names = [*parents, "pos"]
    schema = ", ".join([f"{key} {df.schema[key].dataType.simpleString()}", *(f"{n} int" for n in names), *(f"{n} {t}" for n, t in leaves.items())])

    def flatten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shredded = {leaf: shred(batch.column(1), (*path, leaf)) for leaf in leaves}
            out = None
            values = []
            for levels in shredded.values():
                own = elements(levels)
                out = out or own
                values.append(levels.value.take(pa.array(own.entry)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out.record)), *(pa.array(p, pa.int32()) for p in out.positions), *values], [key, *names, *leaves])

    return df.select(key, column).mapInArrow(flatten, schema)


def rebuild_lists(flat: DataFrame, key: str, leaves: Sequence[str]) -> DataFrame:
    """Inverse of `flat_table` for one list: an array of structs per key, in the order of the positions."""
    from pyspark.sql import functions as F

    rows = F.array_sort(F.collect_list(F.struct("pos", *leaves)))
    return flat.groupBy(key).agg(F.transform(rows, lambda x: F.struct(*(x[leaf].alias(leaf) for leaf in leaves))).alias("items"))


__all__ = ["EACH", "Elements", "Levels", "candidate_links", "elements", "flat_table", "rebuild_lists", "shred", "values_at_key"]
