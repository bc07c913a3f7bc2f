"""Queries of the numbered operators: one per operator, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tomefold.llm import (alignment, chosen_path, langid, mixing, packing, periodic, pii, quality_cnn, radix_dedup,
                          secret_scan, token_store, weak_rules, winnowing)
from tomefold.llm.common import held_out, prepare, table
from tomefold.llm.tokens import default_path


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return winnowing.fingerprints(table(spark, sf_dir, "documents"))


def op3_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_cnn.train(quality_cnn.training_sample(docs, labels.where(~held_out(labels["doc_id"]))))
    return quality_cnn.classify(docs, model)


def op4_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return chosen_path.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs.where(~held_out(docs["doc_id"]))))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.detect(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return weak_rules.quality(table(spark, sf_dir, "documents")).drop("n_lines", "n_ended", "n_distinct")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, default_path("byte_bpe_50k.json"), end_id=2, blanks=True, capacity=1024)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{prepare(spark)}/tomefold-llm/token-store-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, default_path("word_bpe_49k.json"),
                            end_id=1, blanks=False)
    return token_store.document_digests(token_store.read_store(spark, path))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return periodic.run_digests(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return alignment.align(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return radix_dedup.repeat_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_source_mixing, op2_winnowing, op3_quality_cnn, op4_chosen_path_join, op5_language_id, op6_pii,
    op7_secret_scan, op8_weak_rules, op9_best_fit_packing, op10_token_store,
    op11_periodic_runs, op12_token_alignment, op13_suffix_dedup)}

#: None: each result depends on hashes, tokens, model fits or look-around patterns that the
#: oracle's SQL does not have; tests/llm compares every operator with brute force instead.
ORACLE: dict[str, str] = {}
