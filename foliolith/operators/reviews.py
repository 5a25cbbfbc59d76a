"""Reviews of tables: rules over sets of candidates and over people's reviews, their status, the ledger of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_issues(tables: DataFrame) -> DataFrame:
    """Rows (record_id, code) of the rules that look at several components or candidates; a candidate without one gives none.

    `tables` has record_id, candidate_id, manual, node_id_raw, components. Null components and lists count as empty, a null
    identifier is no duplicate. Widths differ if two components with rows do; a page is shared if it stands in two
    components; identifiers repeat if two candidates of a manual have one, case and white space aside.
    """
    none = F.array().cast("array<int>")
    parts = F.filter(F.coalesce("components", F.array().cast(tables.schema["components"].dataType)), lambda c: c.isNotNull())
    width = lambda c: F.array_max(F.transform(F.filter(c["grid"]["rows"], lambda r: r.isNotNull()), F.size))
    widths = F.array_distinct(F.filter(F.transform(parts, width), lambda w: w > 0))
    pages = F.flatten(F.transform(parts, lambda c: F.array_distinct(F.array_compact(F.coalesce(c["source_physical_pages"], none)))))
    key = F.nullif(F.lower(F.btrim("node_id_raw")), F.lit(""))
    flat = tables.select("record_id", "candidate_id", "manual", key.alias("key"), (F.size(widths) > 1).alias("w"), (F.size(pages) > F.size(F.array_distinct(pages))).alias("p"))
    named = flat.where("key is not null and candidate_id is not null")
    twice = named.groupBy("manual", "key").agg(F.min("candidate_id").alias("lo"), F.max("candidate_id").alias("hi")).where("lo <> hi").select("manual", "key")
    inner = F.array_compact(F.array(F.when(F.col("w"), F.lit("cross_fragment_column_mismatch")), F.when(F.col("p"), F.lit("same_page_multiple_components"))))
    return flat.select("record_id", F.explode(inner).alias("code")).unionByName(named.join(twice, ["manual", "key"], "left_semi").select("record_id", F.lit("duplicate_identifier_candidates").alias("code")))


def review_rules() -> dict[str, Column]:
    """Rules of a person's review joined with its table: status, base revision, pages, and the changed cell.

    Columns: status, base_revision, revision, reviewed_pages, pages, row, column, n_rows, n_columns, is_covered, n_same
    (changes of one cell), before, after, text.
    """
    beyond = F.size(F.array_except("reviewed_pages", "pages"))
    whole = F.array_sort(F.array_distinct("reviewed_pages")) == F.array_sort(F.array_distinct("pages"))
    return {
        "status": F.col("status").isin("draft", "partial", "verified"),
        "base_revision": F.col("base_revision") == F.col("revision"),
        "pages": (beyond == 0) & ((F.col("status") != "verified") | whole),
        "address": F.col("row").between(1, F.col("n_rows")) & F.col("column").between(1, F.col("n_columns")),
        "covered_cell": ~F.col("is_covered"),
        "repeated_change": F.col("n_same") == 1,
        "before": F.col("before").eqNullSafe(F.col("text")),
        "no_change": ~F.col("after").eqNullSafe(F.col("before")),
    }


def review_states(tables: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Rows (key, state) of every table: unreviewed without a review, stale if its review is of another revision, else the
    review's status. `tables` has revision; `reviews` base_revision and status, one per key.
    """
    joined = tables.select(key, "revision").join(reviews.select(key, "base_revision", "status"), key, "left")
    state = F.when(F.col("status").isNull(), "unreviewed").when(F.col("base_revision").eqNullSafe(F.col("revision")), F.col("status")).otherwise("stale")
    return joined.select(key, state.alias("state"))


def batch_ledger(planned: DataFrame, reports: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """Rows (key, outcome) of every planned item: pending without a report; unchanged if the applied report is equal;
    changed (an error) if another one was applied; stale if its base is not the current revision; else ready.

    `planned` has revision; `reports` base_revision and digest; `applied` digest; one row per key each. Applying the ready
    ones and adding them to the ledger makes a second run a no-op.
    """
    told = reports.select(key, "base_revision", F.col("digest").alias("_told"))
    joined = planned.select(key, "revision").join(told, key, "left").join(applied.select(key, F.col("digest").alias("_done")), key, "left")
    outcome = (
        F.when(F.col("_told").isNull(), "pending")
        .when(F.col("_told") == F.col("_done"), "unchanged")
        .when(F.col("_done").isNotNull(), "changed")
        .when(F.col("base_revision").eqNullSafe(F.col("revision")), "ready")
        .otherwise("stale")
    )
    return joined.select(key, outcome.alias("outcome"))


def ready_tables(tables: DataFrame, by: str, key: str) -> DataFrame:
    """Tables that need no review and whose key no table awaits that does. `tables` has needs_review; null keys are awaited
    by none."""
    awaited = tables.where(F.col("needs_review") & F.col(key).isNotNull()).select(by, key).distinct()
    return tables.where(~F.col("needs_review")).join(awaited, [by, key], "left_anti")


def minted_ids(blocks: DataFrame, by: str, page: str, order: str) -> DataFrame:
    """Adds `synthetic_id` to unnumbered tables: their page with four digits and their ordinal on it; null pages give none."""
    nth = F.row_number().over(Window.partitionBy(by, page).orderBy(order))
    return blocks.withColumn("synthetic_id", F.when(F.col(page).isNotNull(), F.format_string("unnumbered-p%04d-%02d", F.col(page).cast("int"), nth)))


def ancestors(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """Rows (node, ancestor, distance), one per node and node above it. Level by level with reliable checkpoints; a circle
    of parents is an error.
    """
    from foliolith.runtime import cut

    edges = cut(nodes.select(F.col(node).alias("n"), F.col(parent).alias("up")).where("up is not null"))
    most, level, done, distance = edges.count(), edges, edges.withColumn("distance", F.lit(1)), 1
    while True:
        distance += 1
        level = cut(level.join(edges.select(F.col("n").alias("up"), F.col("up").alias("higher")), "up").select("n", F.col("higher").alias("up")))
        if level.isEmpty():
            return done.select(F.col("n").alias(node), F.col("up").alias("ancestor"), "distance")
        if distance > most:
            raise ValueError("nodes whose parents form a circle")
        done = done.unionByName(level.withColumn("distance", F.lit(distance)))
