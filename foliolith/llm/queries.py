"""Queries of the corpus operators and, where SQL can say the same, their oracle."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolith.runtime import table


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file; FOLIOLITH_TOKENIZERS names another folder."""
    return os.path.join(os.environ.get("FOLIOLITH_TOKENIZERS", "/opt/tokenizers"), name)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.llm.markup import markup_kinds

    return markup_kinds(table(spark, sf_dir, "ocr_blocks"))


def p1_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.llm.markup import clean_texts

    return clean_texts(table(spark, sf_dir, "ocr_blocks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.llm.alike import alike_pairs

    captions = alike_pairs(table(spark, sf_dir, "figure_captions"), "caption", ["manual", "figure_id"], "caption_id", "caption")
    return captions.unionByName(alike_pairs(table(spark, sf_dir, "text_observations"), "raw_text", ["source_id"], "obs_id", "raw_text"))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.llm.alike import forms

    captions = forms(table(spark, sf_dir, "figure_captions"), "caption", "caption_id", "caption")
    return captions.unionByName(forms(table(spark, sf_dir, "text_observations"), "raw_text", "obs_id", "raw_text"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.llm.alike import alike_classes

    captions = alike_classes(table(spark, sf_dir, "figure_captions"), "caption", ["manual", "figure_id"], "caption_id", "caption")
    return captions.unionByName(alike_classes(table(spark, sf_dir, "text_observations"), "raw_text", ["source_id"], "obs_id", "raw_text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.llm.packing import oversize, review_batches

    return oversize(review_batches(table(spark, sf_dir, "plan_luna_batches")))


def p5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.llm.packing import review_batches

    return review_batches(table(spark, sf_dir, "plan_luna_batches"))


def p5_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.llm.packing import certificates, review_batches
    from foliolith.runtime import cut

    return certificates(cut(review_batches(table(spark, sf_dir, "plan_luna_batches"))))


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run what its batches hold in all, and how many of them break a cap."""
    from foliolith.llm.packing import REVIEW_CAPACITY, REVIEW_MOST, review_batches

    dims = ("weight", "cell_count", "pages")
    batches = review_batches(table(spark, sf_dir, "plan_luna_batches")).groupBy("run_id", "batch").agg(F.count("*").alias("n"), *(F.sum(d).alias(d) for d in dims))
    broken = reduce(lambda a, b: a | b, (F.col(d) > c for d, c in zip((*dims, "n"), (*REVIEW_CAPACITY, REVIEW_MOST), strict=True)))
    return batches.groupBy("run_id").agg(F.sum("n").alias("pieces"), *(F.sum(d).alias(d) for d in dims), F.count_if(broken).alias("broken"))


P5_COVERAGE_SQL = """
WITH ranked AS (SELECT *, coalesce(len(source_physical_pages), 0) AS pages, row_number() OVER (PARTITION BY coalesce(candidate_id, chr(1) || queue_id) ORDER BY base_revision DESC NULLS LAST, queued_at DESC NULLS LAST, queue_id DESC) AS rn FROM plan_luna_batches)
SELECT run_id, CAST(sum(greatest(1, ceil(coalesce(weight, 0) / 9.0), ceil(coalesce(cell_count, 0) / 500.0), ceil(pages / 20.0))) AS BIGINT) AS pieces, CAST(sum(coalesce(weight, 0)) AS BIGINT) AS weight,
CAST(sum(coalesce(cell_count, 0)) AS BIGINT) AS cell_count, CAST(sum(pages) AS BIGINT) AS pages, CAST(0 AS BIGINT) AS broken FROM ranked WHERE rn = 1 GROUP BY 1
"""

P5_FOUND_SQL = """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY base_revision DESC NULLS LAST, queued_at DESC NULLS LAST, queue_id DESC) AS rn
FROM plan_luna_batches WHERE candidate_id IS NOT NULL)
SELECT candidate_id FROM ranked WHERE rn = 1 AND (weight > 9 OR cell_count > 500 OR len(source_physical_pages) > 20)
"""


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.llm.tokenize import Encoder, token_ids

    return token_ids(table(spark, sf_dir, "documents"), Encoder.from_file(tokenizer_path("byte_bpe_50k.tiktoken")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.llm.decontaminate import leaked_items

    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.llm.toxicity import toxic_documents, trained

    documents = table(spark, sf_dir, "documents")
    return toxic_documents(documents, trained(documents, table(spark, sf_dir, "labels")))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.llm.toxicity import toxicity, trained

    documents = table(spark, sf_dir, "documents")
    return toxicity(documents, trained(documents, table(spark, sf_dir, "labels")))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliolith.llm.toxicity import source_rates, trained

    documents = table(spark, sf_dir, "documents")
    return source_rates(documents, trained(documents, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_text": p1_text,
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p2_classes": p2_classes,
    "p5_found": p5_found,
    "p5_batches": p5_batches,
    "p5_certificates": p5_certificates,
    "p5_coverage": p5_coverage,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}
ORACLE: dict[str, str] = {"p5_found": P5_FOUND_SQL, "p5_coverage": P5_COVERAGE_SQL}
