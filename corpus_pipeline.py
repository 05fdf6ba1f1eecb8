"""A training corpus from ``documents``: quality rules, near-duplicate join, repeated passages, benchmark passages, tokens.

Each stage is written as Parquet and read again as the documents of the next one. All but the last return the columns
of ``documents`` (n_chars follows the text).

Cases: null and empty texts fail the base rules of the first stage and go; rows of one doc_id with different texts are different documents; of
repeated rows and equal texts one stays; texts of any length are treated whole; an empty table gives an empty result with the same columns;
extra columns are carried on whatever their names, but for those that the last stage makes (``MADE``, in any case), which it replaces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm import bpe, decontaminate, ngram_join, quality_rules, suffix_dedup
from recoflow.session import scratch_path, ship_package

#: Near copies of the second stage: word shingles of this size, this Jaccard percentage or more (op7 alone has its own).
SHINGLE, SIMILAR = 5, 80

#: Columns of the last stage.
MADE = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language and source go."""
    ship_package(spark)
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    ship_package(spark)
    return ngram_join.representatives(docs, size=SHINGLE, pct=SIMILAR)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier are cut out; documents of which nothing is left go."""
    ship_package(spark)
    return _measured(suffix_dedup.remove_repeats(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that mostly consist of them go."""
    ship_package(spark)
    return _measured(decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus: ids of every document with their digest and that of the decoded text."""
    ship_package(spark)
    return bpe.encode_documents(docs, [c for c in docs.columns if c != "text" and c.lower() not in MADE], with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL expresses no stage but parts of the second and fourth; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    name = uuid.uuid4().hex[:8]
    for k, (stage, f) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{name}-{k}-{stage}")
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
