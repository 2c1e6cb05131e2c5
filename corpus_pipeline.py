"""From raw documents to packed training sequences."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from runmosaic.llm import exact_dedup, mixing, near_copies, packing, quality
from runmosaic.llm.common import documents, drop_tables, noted, small_batches, written


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Stages take documents that are stored, so the tables behind the result before them may go when one begins."""

    @wraps(fn)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark)
        small_batches(spark)
        with noted():
            return fn(spark, docs, sf_dir)

    return begun


@stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs)


@stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.kept_documents(docs)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is there twice."""
    return mixing.mixed_documents(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", good_documents), ("exact dedup", without_copies), ("near dedup", without_near_copies), ("mixing", mixed), ("packing", packed)]
# fitted classifiers, hashes of shingles and tokenizers are beyond SQL; tests/llm/test_pipeline.py follows each stage by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result is a table before the next begins."""
    docs = documents(spark, sf_dir)
    for _, step in STAGES[:-1]:
        docs = written(step(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
