"""Queries that go through sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.plans.catalog import query
from foliolith.plans.figures import plot_projects
from foliolith.runtime import checkpoint_dir, table
from foliolith.sources import archives, documents


def _shared(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which every executor can reach."""
    return f"{checkpoint_dir(spark).removeprefix('file://').removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


@query(
    "archive_roundtrip",
    "SELECT 'fig_' || p_partkey AS name, true AS equal FROM part",
)
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives.register(spark)
    rows = plot_projects(spark, sf_dir).select(F.concat(F.lit("fig_"), "figure").alias("name"), "project", F.encode("project", "UTF-8").alias("image"))
    folder = _shared(spark, "archives")
    rows.write.format("plot_archives").mode("append").option("path", folder).save()
    again = spark.read.format("plot_archives").load(folder)
    return again.join(rows.select("name", F.col("project").alias("p"), F.col("image").alias("i")), "name").select("name", ((F.col("project") == F.col("p")) & (F.col("image") == F.col("i"))).alias("equal"))


@query(
    "json_blocks",
    """
SELECT o_orderkey, CAST(i AS INT) AS block_index, CASE WHEN i = 0 THEN 'title' ELSE 'text' END AS type FROM orders, range(0, 3) r(i) WHERE i <= o_orderkey % 3
""",
)
def json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = lambda kind: F.concat(F.lit(f'{{"type": "{kind}", "list": [{{"type": "inner"}}], "text": "'), "o_orderpriority", F.lit('"}'))
    texts = F.array_join(F.array_repeat(block("text"), (F.col("o_orderkey") % 3).cast("int")), ", ")
    text = F.concat(F.lit('{"pages": [{"n": 1, "blocks": ['), block("title"), F.lit(']}, {"blocks": [['), texts, F.lit("]]}]}"))
    return documents.json_blocks(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text").select("o_orderkey", "block_index", "type")


@query("candidate_notes")
def candidate_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.markdown_notes(table(spark, sf_dir, "candidates"))


@query("candidate_workbooks")
def candidate_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "candidates", "record_id bigint, grid struct<cells:array<struct<row:int,column:int,rowspan:int,colspan:int,text:string>>>")
    flat = cells.select("record_id", F.inline("grid.cells")).where("row is not null and column is not null").withColumn("sheet", F.lit("Table"))
    books = documents.workbooks(flat.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("rowspan", "colspan")}), "record_id")
    return books.select("record_id", F.length("xlsx").alias("n_bytes"))


@query(
    "stream_components",
    """
SELECT user_id, ts, event_type, CAST(sum(CASE WHEN event_type IN ('purchase', 'login') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS INT) AS component FROM events
""",
)
def stream_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.streaming.incremental import stream_openings

    source = table(spark, sf_dir, "events")
    folder = _shared(spark, "events")
    source.select("user_id", "ts", "event_type").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("user_id bigint, ts timestamp, event_type string").parquet(f"{folder}/in")
    out = stream_openings(stream, "user_id", "ts", "event_type", ("purchase", "login"))
    job = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


__all__ = ["archive_roundtrip", "candidate_notes", "candidate_workbooks", "json_blocks", "stream_components"]
