"""Physical plan properties of the registered queries (sf0.001)."""

import os
import sys
from collections import Counter

import __spark_entry__ as E
from tomefold.plans import registry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from plan_summary import walk  # noqa: E402

SF = "/root/testdata/sf0.001"


def _ops(spark, name):
    df = E.queries()[name](spark, SF)
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    ops, scans = Counter(), []
    walk(qe.executedPlan(), ops, scans)
    spark.catalog.clearCache()
    return ops


def test_no_nested_loop_or_cartesian_joins(spark):
    for name in registry.QUERIES:
        ops = _ops(spark, name)
        bad = [k for k in ops if "NestedLoop" in k or "Cartesian" in k]
        assert not bad, (name, bad)


def test_chunker_and_kernel_shapes(spark):
    ops = _ops(spark, "token_count")
    assert not any(k.startswith("ShuffleExchange") for k in ops)        # scan + project
    ops = _ops(spark, "chunk_docs")
    assert sum(v for k, v in ops.items() if k.startswith("ShuffleExchange")) == 1   # conversations only
    ops = _ops(spark, "knn_topk")
    assert ops["MapInArrow"] == 1 and ops["WindowGroupLimit"] >= 1


def _scans(spark, name):
    df = E.queries()[name](spark, SF)
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    ops, scans = Counter(), []
    walk(qe.executedPlan(), ops, scans)
    spark.catalog.clearCache()
    return [s[0] for s in scans]


def test_scans_read_only_needed_columns(spark):
    assert _scans(spark, "path_metadata") == ["struct<page_id:bigint,url:string>"]      # no html column
    assert _scans(spark, "token_count") == ["struct<doc_id:bigint,text:string>"]
    assert all("embedding" in s and "label" not in s for s in _scans(spark, "knn_topk"))


def test_integer_outputs_are_bigint(spark):
    from pyspark.sql import types as T
    for name, fn in E.queries().items():
        if name not in registry.QUERIES:  # the training-data queries fix their own types
            continue
        schema = fn(spark, SF).schema
        small = [f.name for f in schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType))]
        assert not small, (name, small)
        spark.catalog.clearCache()
