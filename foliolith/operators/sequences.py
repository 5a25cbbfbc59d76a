"""Order-dependent operators as windows: runs, ordinals, openings and what follows them, latest versions, next-fit."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows (by, first, last, n): runs of consecutive distinct integers; nulls belong to none."""
    distinct = rows.where(F.col(value).isNotNull()).select(*by, value).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value))
    grouped = distinct.withColumn("_island", island).groupBy(*by, "_island")
    return grouped.agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("_island")


def opened(rows: DataFrame, by: Sequence[str], order: Sequence[str], opens: Column, name: str) -> DataFrame:
    """Number of the opening each row belongs to (0 before the first): a running count of `opens`."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(opens, 1).otherwise(0)).over(w))


def gathered(rows: DataFrame, by: Sequence[str], order: Sequence[str], text: str, sep: str = "\n") -> DataFrame:
    """Texts of each group in order as one; null texts are passed over."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    joined = F.array_join(F.transform(items, lambda x: x["_text"]), sep)
    return rows.groupBy(*by).agg(joined.alias(text), F.count("*").alias("n_parts"))


def reference_entries(blocks: DataFrame, by: Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """Rows (by, number, text, n_parts): a block that begins `N.` opens an entry, the next ones belong to it, across
    pages; blocks before the first are left out; repeated numbers stay apart.
    """
    number = F.regexp_extract(text, "^\\s*([0-9]{1,3})\\.(?:\\s|$)", 1).try_cast("int")
    marked = opened(blocks.withColumn("_number", number), by, order, F.col("_number").isNotNull(), "_entry").where("_entry > 0")
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return marked.groupBy(*by, "_entry").agg(F.max("_number").alias("number"), F.array_join(F.transform(items, lambda x: x["_text"]), " ").alias(text), F.count("*").alias("n_parts")).drop("_entry")


def reading_order(blocks: DataFrame, by: Sequence[str], x0: str, y0: str, middle: Column, name: str = "position") -> DataFrame:
    """Ordinal of each block in two-column reading order: the left column from the top, then the right one."""
    w = Window.partitionBy(*by).orderBy(F.when(F.col(x0) < middle, 0).otherwise(1), y0, x0)
    return blocks.withColumn(name, F.row_number().over(w))


def latest(rows: DataFrame, key: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """Per key the row with the highest rank; map-side, without sorting groups."""
    columns = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*rank)).alias("_row"))
    return best.select(*key, *(F.col("_row").getField(c).alias(c) for c in columns))


def append_revisions(stored: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows (key, columns, revision, status) of incoming edits: stored as the next revision if their base is the current
    one, stale otherwise; an edit equal to what is stored is unchanged. Unknown keys begin at revision 1.
    """
    current = latest(stored, [key], ["revision"]).select(key, F.col("revision").alias("_now"), F.struct(*columns).alias("_kept"))
    joined = incoming.join(current, key, "left")
    same = F.struct(*columns).eqNullSafe(F.col("_kept"))
    status = F.when(F.col("_now").isNull(), "created").when(same, "unchanged").when(F.col("base_revision") == F.col("_now"), "stored").otherwise("stale")
    made = joined.withColumn("status", status)
    return made.select(key, *columns, F.when(F.col("status") == "unchanged", F.col("_now")).when(F.col("status") != "stale", F.coalesce("_now", F.lit(0)) + 1).alias("revision"), "status")


def next_fit(rows: DataFrame, group: str, order: Sequence[str], sizes: dict[str, int], most: int, name: str = "batch") -> DataFrame:
    """Batches in the given order: a row opens a new one when a sum would pass its cap or the batch holds `most` rows; the
    first row of a batch is always taken. Sequential by definition, so a fold per group over bounded Arrow batches: the
    state carried on is one batch's sums, never the group's rows.
    """
    rows = rows.repartition(group).sortWithinPartitions(group, *order)

    def fold(parts):  # noqa: ANN001, ANN202
        at, load, n, batch = object(), dict.fromkeys(sizes, 0), 0, 0
        for part in parts:
            columns = [part[c].fillna(0).tolist() for c in sizes]
            out = []
            for g, *values in zip(part[group].tolist(), *columns, strict=True):
                if g != at:
                    at, load, n, batch = g, dict.fromkeys(sizes, 0), 0, 1
                elif n >= most or any(load[c] + v > cap for (c, cap), v in zip(sizes.items(), values, strict=True)):
                    load, n, batch = dict.fromkeys(sizes, 0), 0, batch + 1
                for c, v in zip(sizes, values, strict=True):
                    load[c] += v
                n += 1
                out.append(batch)
            yield part.assign(**{name: pd.Series(out, index=part.index, dtype="int32")})

    return rows.mapInPandas(fold, _ddl(rows, name))


def _ddl(rows: DataFrame, name: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"{name} int"])
