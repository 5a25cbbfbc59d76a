"""Texts that look the same but are different strings, within a group of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolith.llm.fold import looks_column, one_form_column


def _readings(readings: DataFrame, group: list[str], key: str, text: str) -> tuple[DataFrame, list[str]]:
    """Readings with a text and a whole group, with their form and looks, and the columns of group, form and looks."""
    names = [f"g{i}" for i in range(len(group))]
    rows = readings.select(*(F.col(g).cast("string").alias(n) for g, n in zip(group, names, strict=True)), F.col(key).alias("id"), F.col(text).alias("raw"))
    rows = rows.dropna(subset=[*names, "raw"]).withColumns({"form": one_form_column(F.col("raw")), "looks": looks_column(F.col("raw"))})
    return rows, [*names, "form", "looks"]


def _mixed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the groups that hold more than one string. The groups are found by an aggregate, combined before the
    shuffle, and met by a join: no window over a hot group.
    """
    held = rows.groupBy(*by).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*by)
    return rows.join(held, by, "left_semi")


def alike_pairs(readings: DataFrame, field: str, group: list[str], key: str, text: str) -> DataFrame:
    """Rows (field, id_a, id_b), id_a < id_b: readings of one group whose texts look the same but differ as strings.

    Candidates share the one form of `one_form`; whether they look the same (case, raised digits and accents are seen) is
    then checked exactly. Null texts and rows with a null group column have no partner; texts without any visible sign
    look the same. Repeated rows pair like others, as they have ids of their own; equal strings never pair. Forms are
    worked out once per distinct text of an Arrow batch. Groups with one string drop out before the self-join, so a group
    holding a third of all rows costs only its true pairs; `alike_classes` gives the same links one row per reading.
    """
    rows, by = _readings(readings, group, key, text)
    mixed = _mixed(rows, by)
    a, b = (mixed.select(*by, F.col("id").alias(f"id_{x}"), F.col("raw").alias(f"raw_{x}")) for x in "ab")
    pairs = a.join(b, by).where("raw_a <> raw_b and id_a < id_b")
    return pairs.select(F.lit(field).alias("field"), "id_a", "id_b")


def alike_classes(readings: DataFrame, field: str, group: list[str], key: str, text: str) -> DataFrame:
    """Rows (field, id, class_id, links): one per reading with a text and a whole group. Readings of a class look the same;
    class_id is its least id, links the number of its readings with another string. Linear in the rows for any group size.
    """
    rows, by = _readings(readings, group, key, text)
    strings = rows.groupBy(*by, "raw").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = strings.groupBy(*by).agg(F.sum("n").alias("all"), F.min("least").alias("class_id"))
    found = rows.join(strings.select(*by, "raw", "n"), [*by, "raw"]).join(classes, by)
    return found.select(F.lit(field).alias("field"), "id", "class_id", (F.col("all") - F.col("n")).alias("links"))


def forms(readings: DataFrame, field: str, key: str, text: str) -> DataFrame:
    """Rows (field, id, form, looks), one per input row: the text in one consistent form, and its key by looks."""
    return readings.select(F.lit(field).alias("field"), F.col(key).alias("id"), one_form_column(F.col(text)).alias("form"), looks_column(F.col(text)).alias("looks"))
