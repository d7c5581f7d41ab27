"""A corpus pipeline of five stages: quality rules, exact dedup, near-duplicate join, secret scan, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscore.llm import exact_dedup, jaccard_join, packing, quality, secret_scan
from cohortscore.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier test reject go; null and empty texts fail the base rules.

    Null and empty languages or sources are one group; repeated rows are judged alike; no rows give no rows."""
    return quality.keep_good(docs).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; rows that repeat that doc_id all stay; null counts as empty."""
    return exact_dedup.drop_exact_copies(docs).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the one with the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs, percent=80, k=5).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows; every document stays."""
    return secret_scan.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in sequences of 2048."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(docs, path, public_tokenizers.PATTERN).withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the forest nor the packing; tests/llm hold the stages against brute force (of the forest's
#: stage: that all documents stay).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to the written output of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
