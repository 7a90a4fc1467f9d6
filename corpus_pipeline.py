"""A training corpus from ``documents``: toxicity, near duplicates, benchmark leaks, mixing, shards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from strandspark.llm.common import discard, remove, shared_dir, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on their labels, doesn't reject."""
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard_join.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document of the mix."""
    return sharding.shard(docs, keep=["lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: A trained model can't be stated in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written as Parquet and read again; what is no longer read is removed."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before = written()
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, before)
        if old:
            remove(spark, old)
        docs, old = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
