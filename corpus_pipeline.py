"""Raw documents to training tokens: five stages, each written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.llm import decontaminate, line_dedup, pieces, quality, simhash
from windrose.llm.common import SPACES, read
from windrose.shared import remove, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep. The verdict stands beside the row it judges, so nothing is joined."""
    return quality.keep(docs).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; documents of which no word is left go with them."""
    out = line_dedup.dedup_lines(docs)
    left = (F.col("n_gone") == 0) | (F.btrim("text", F.lit(SPACES)) != "")
    return out.filter(left).withColumn("n_chars", F.when(F.col("n_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, that with the least id."""
    return simhash.keep_one(docs, similarity=simhash.SIMILARITY).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", encoding),
]
#: Line dedup, SimHash components and encoding are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder, until the next is written."""
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{k}-{name}")
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
