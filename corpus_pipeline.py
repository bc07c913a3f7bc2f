"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tomefold.llm import chosen_path, mixing, packing, pii, weak_rules
from tomefold.llm.common import prepare, table
from tomefold.llm.tokens import default_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules fail or the weak supervision rejects go."""
    prepare(spark)
    return weak_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join stays."""
    prepare(spark)
    return chosen_path.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are masked in the texts."""
    prepare(spark)
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (a copy is a row of its own)."""
    prepare(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack every text into sequences of at most 1024 tokens (one row per piece)."""
    prepare(spark)
    return packing.pack_documents(docs, default_path("byte_bpe_50k.json"), end_id=2, blanks=True, capacity=1024)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data),
          ("mixing sources", mix_sources), ("best-fit packing", pack_sequences)]

#: Tokens and estimated rates have no SQL form; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and reread."""
    folder = f"{prepare(spark)}/tomefold-llm/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
