"""The queries of this subpackage, each over its whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from sieveline.llm import chat, decontaminate, fingerprint, jaccard_join, language, line_dedup, packing, quality, substring_dedup, url_filter
from sieveline.llm.common import read, worker_path


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    worker_path(spark)
    return fingerprint.compare_with_edits(read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    worker_path(spark)
    return substring_dedup.report(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    worker_path(spark)
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, expected_grade, p_tail, keep."""
    worker_path(spark)
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(documents, quality.grades_of_labels(read(spark, sf_dir, "labels")))
    return quality.score(documents, model).select("doc_id", "expected_grade", "p_tail", "keep")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    worker_path(spark)
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out("doc_id"))
    counts = language.learn(documents.where(~F.col("held_out")))
    return language.identify(documents.select("doc_id", "held_out", "text"), counts).select("doc_id", "held_out", "lang_pred", "score", "lang_shares")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    worker_path(spark)
    return chat.repair(read(spark, sf_dir, "conversations"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    worker_path(spark)
    return jaccard_join.cluster_links(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    worker_path(spark)
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_chat_format": op7_chat_format,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_packing": op9_packing,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.oracle_sql(),
    "op10_url_filter": url_filter.oracle_sql(),
}
