"""A corpus made ready for training: five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candor.llm.decontamination import drop_contaminated
from candor.llm.mixing import mix_sources, take_epochs
from candor.llm.quality_rules import apply_rules
from candor.llm.sharding import interleaved_shards
from candor.llm.shared import keep
from candor.llm.simhash import drop_near_duplicates

SHARDS = 24
SHINGLE = 3
RADIUS = 3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return apply_rules(docs, labels).where("kept").select(docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of SHINGLE words link at RADIUS bits."""
    return drop_near_duplicates(docs, radius=RADIUS, shingle=SHINGLE)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return take_epochs(mix_sources(docs)).select(docs.columns)


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All of them with shard and slot."""
    return interleaved_shards(docs, SHARDS)


STAGES = [
    ("quality rules", good_documents),
    ("simhash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("mixing to target weights", mixed_documents),
    ("sharding", sharded_documents),
]

# Fingerprints, alignments and certified cutoffs are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, f"stage-{i + 1}")
    return docs
