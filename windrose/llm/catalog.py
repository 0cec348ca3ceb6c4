"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.llm import decontaminate, html_tree, licenses, line_dedup, pieces, quality, simhash, token_counts, toxicity, url_filter
from windrose.llm.common import read


def op1_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, d, "pages"))


def op2_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html_tree.extract(read(spark, d, "pages"))


def op3_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))


def op4_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, d, "documents")).select("doc_id", "text", "n_lines", "n_gone")


def op5_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.classify(read(spark, d, "documents"), read(spark, d, "labels"))


def op6_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(read(spark, d, "documents"))


def op7_license_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of a tree source/lang; one whose whole text is close to a template is a licence file."""
    docs = read(spark, d, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    files = docs.filter("doc_id IS NOT NULL").select(path.alias("path"), "text")
    out = licenses.scan(files, by_text=True)
    return out.select(F.regexp_extract("path", r"([^/]*)$", 1).cast("long").alias("doc_id"), "path", "own", "cosine", "license", F.col("source").alias("how"))


def op8_simhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, d, "documents"))


def op9_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return pieces.encode(read(spark, d, "documents"))


def op10_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_html_extraction, op3_decontamination, op4_line_dedup, op5_toxicity, op6_quality_rules, op7_license_scan, op8_simhash_dedup, op9_sentencepiece, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.oracle(), "op6_quality_rules": quality.oracle()}
