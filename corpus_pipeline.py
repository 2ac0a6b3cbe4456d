"""From raw documents to sharded training data: five stages, each on all that the one before kept."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm import decontaminate, minimax, mixing, near_copies, quality_knn
from sessionloom.llm.common import table
from sessionloom.sources.scratch import delete_folder, scratch_folder, scratch_scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled ones vote to be good."""
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: candidates by op2's linked fingerprints and by
    min-hashes, held exactly against a similarity of 0.8 of their five-word shingles."""
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, documents repeated by epochs."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that takes them."""
    return minimax.with_shard(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
    ("shard", shard),
]

#: Votes of neighbours and fingerprints of windows are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. A stage's own tables, and its input, are deleted once it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
