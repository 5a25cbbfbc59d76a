"""Queries that compare two copies of the table candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.operators.compare import differences, same_pages, same_text
from foliolith.plans.catalog import query
from foliolith.runtime import table, trimmed

_TRIM = "regexp_replace({0}, '^[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+|[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+$', '', 'g')"
_SIDE = """SELECT lower({trim}) AS k, arg_max(struct_pack(node := {node}, caption := {caption}, foot := {foot}, pages := coalesce(list_sort(list_distinct(source_physical_pages)), []), status := {status}, revision := revision), row(revision, received_at, {id})) AS v
FROM {t} WHERE candidate_id IS NOT NULL GROUP BY 1"""


def _side(t: str, row_id: str) -> str:
    return _SIDE.format(trim=_TRIM.format("candidate_id"), node=_TRIM.format("node_id_raw"), caption=_TRIM.format("caption"), foot=_TRIM.format("footnotes"), status=_TRIM.format("data_status"), t=t, id=row_id)


FOUND_SQL = f"""
WITH a AS ({_side("candidates", "record_id")}), b AS ({_side("candidates_mirror", "mirror_id")}),
j AS (SELECT coalesce(a.k, b.k) AS candidate_id, a.v AS x, b.v AS y, a.k IS NULL AS no_a, b.k IS NULL AS no_b FROM a FULL JOIN b ON a.k = b.k)
SELECT candidate_id, 'missing_in_mirror' AS difference FROM j WHERE no_b
UNION ALL SELECT candidate_id, 'missing_in_candidates' FROM j WHERE no_a
UNION ALL SELECT candidate_id, 'node_id_raw' FROM j WHERE NOT no_a AND NOT no_b AND x.node IS DISTINCT FROM y.node
UNION ALL SELECT candidate_id, 'caption' FROM j WHERE NOT no_a AND NOT no_b AND x.caption IS DISTINCT FROM y.caption
UNION ALL SELECT candidate_id, 'footnotes' FROM j WHERE NOT no_a AND NOT no_b AND x.foot IS DISTINCT FROM y.foot
UNION ALL SELECT candidate_id, 'source_physical_pages' FROM j WHERE NOT no_a AND NOT no_b AND x.pages IS DISTINCT FROM y.pages
UNION ALL SELECT candidate_id, 'data_status' FROM j WHERE NOT no_a AND NOT no_b AND x.status IS DISTINCT FROM y.status
UNION ALL SELECT candidate_id, 'revision' FROM j WHERE NOT no_a AND NOT no_b AND x.revision IS DISTINCT FROM y.revision
"""


@query("p4_found", FOUND_SQL)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {
        "node_id_raw": same_text(F.col("node_id_raw")),
        "caption": same_text(F.col("caption")),
        "footnotes": same_text(F.col("footnotes")),
        "source_physical_pages": same_pages(F.col("source_physical_pages")),
        "data_status": same_text(F.col("data_status")),
        "revision": F.col("revision"),
    }
    order = {"left": ["revision", "received_at", "record_id"], "right": ["revision", "received_at", "mirror_id"]}
    return differences(table(spark, sf_dir, "candidates"), table(spark, sf_dir, "candidates_mirror"), F.lower(trimmed(F.col("candidate_id"))), order, fields, ("missing_in_mirror", "missing_in_candidates"))
