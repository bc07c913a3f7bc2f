"""Stored inverted file and threshold join against the exact scan."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomefold.operators import cells as CE
from tomefold.operators import knn as K


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 8))
    rows = [(f"i{k:03d}", [float(x) for x in centers[k % 12] + 0.15 * rng.normal(size=8)], "ab"[k % 2]) for k in range(400)]
    rows += [("copy", rows[0][1], "a")]
    return spark.createDataFrame(rows, "item_id string, vector array<float>, version string")


def asked(spark, vectors):
    return vectors.where("item_id between 'i000' and 'i060'").select(
        F.substring("item_id", 2, 3).cast("long").alias("qid"), F.col("vector").alias("qvec"),
        F.when(F.col("version") == "a", "a").alias("qversion"))


def rows(df):
    return sorted((r["qid"], r["rank"], r["item_id"], r["score"]) for r in df.collect())


def test_search_equals_exact_scan_and_prunes(spark, vectors, tmp_path):
    base = str(tmp_path / "cells")
    bad = spark.createDataFrame([("short", [1.0], "a"), ("none", None, "a"), ("zero", [0.0] * 8, "b")],
                                "item_id string, vector array<float>, version string")
    CE.create_cells(vectors.where("item_id < 'i300' or item_id = 'copy'").unionByName(bad), base, 8, n_cells=12)
    generation = CE._centroids(spark, base)[2]
    CE.append_cells(vectors.where("item_id >= 'i300' and item_id <> 'copy'"), base)
    q = asked(spark, vectors)
    assert rows(CE.search_cells(q, base, 7, first_probes=1)) == rows(K.knn(q, vectors, 7))
    assert rows(CE.search_cells(q, base, 7, default_min_score=0.9, block_rows=5)) == rows(K.knn(q, vectors, 7, default_min_score=0.9))
    errors = {r["item_id"]: r["error"] for r in spark.read.parquet(f"{base}/errors").collect()}
    assert errors == {"short": "wrong vector size", "none": "missing vector", "zero": "vector without direction"}
    # few cells of a clustered table can hold the neighbours of one query: the others are not read
    one = q.where("qid = 3")
    numbers = CE._centroids(spark, base)[0]
    shared = CE._shared(spark, (*CE._centroids(spark, base)[:2], np.array(
        [{r["cell"]: r["radius"] for r in CE.cell_stats(spark, base).collect()}[int(c)] for c in numbers])))
    reached = one.select(CE._next_cells(shared, 0, 99)("qvec", F.lit(0.9)).alias("c")).first()["c"]
    assert 0 < len(reached) < len(numbers)
    plan = CE.read_items(spark, base).where(F.col("cell").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cast(cell" in plan or "PartitionFilters: [cell" in plan

    assert CE.split_cells(spark, base, max_rows=20) > 0
    assert CE._centroids(spark, base)[2] == generation + 1
    assert CE.cell_stats(spark, base).agg(F.sum("n")).first()[0] == 401
    assert rows(CE.search_cells(q, base, 7)) == rows(K.knn(q, vectors, 7))
    with pytest.raises(Exception, match="another size"):
        CE.search_cells(spark.createDataFrame([(1, [1.0, 2.0])], "qid long, qvec array<float>"), base, 3).collect()


def test_ties_and_few_items(spark, tmp_path):
    items = spark.createDataFrame([(f"t{k}", [1.0, 0.0], "v") for k in range(9)] + [("far", [0.0, 1.0], "v")],
                                  "item_id string, vector array<float>, version string")
    base = str(tmp_path / "ties")
    CE.create_cells(items, base, 2)
    q = spark.createDataFrame([(1, [2.0, 0.0])], "qid long, qvec array<float>")
    assert [r["item_id"] for r in CE.search_cells(q, base, 3).orderBy("rank").collect()] == ["t0", "t1", "t2"]
    assert CE.search_cells(q, base, 50).count() == 10


@pytest.mark.parametrize("block", [4096, 16])
def test_pairs_above_a_threshold(spark, vectors, block):
    pairs, members = CE.similar_pairs(vectors, 0.97, 8, n_cells=9, block_rows=block)
    local = [(r["item_id"], np.array(r["vector"])) for r in vectors.where("item_id <> 'i000'").collect()]
    want = set()
    for i, (a, x) in enumerate(local):
        for b, y in local[i + 1:]:
            if K.quantize(x @ y / math.sqrt((x @ x) * (y @ y))) >= 0.97:
                want.add((min(a, b), max(a, b)))
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert {r["item_id"]: r["rep"] for r in members.collect()}["i000"] == "copy"


def test_pairs_do_not_depend_on_the_partitions(spark, vectors):
    # groups of both sides meet in every partition, not only where there is one
    odd = spark.createDataFrame([(None, [9.0] + [0.0] * 7, "a"), ("i001", [0.0, 9.0] + [0.0] * 6, "a"), ("short", [1.0], "b")], vectors.schema)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {}
        for block in (None, 60):
            rows = CE.similar_pairs(vectors.unionByName(odd), 0.5, 8, n_cells=9, block_rows=block)[0].collect()
            got[block] = sorted((r["a"], r["b"], r["score"]) for r in rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    local = [(r["item_id"], np.array(r["vector"])) for r in vectors.where("item_id <> 'i000'").collect()] + [("i001", np.eye(8)[1] * 9)]
    want = []
    for i, (a, x) in enumerate(local):
        for b, y in local[i + 1:]:
            score = K.quantize(x @ y / math.sqrt((x @ x) * (y @ y)))
            if score >= 0.5 and a != b:
                want.append((min(a, b), max(a, b), score))
    assert [g[:2] for g in got[None]] == [w[:2] for w in sorted(want)] and len(want) > 1000
    assert got[60] == got[None] and np.allclose([g[2] for g in got[None]], [w[2] for w in sorted(want)], atol=2e-9)


def test_a_vector_travels_once_to_a_block(spark, vectors, monkeypatch):
    packed = []
    plain = K.pack_cells
    monkeypatch.setattr(K, "pack_cells", lambda sizes, rows: packed.append(plain(sizes, rows)) or packed[-1])
    pairs = CE.similar_pairs(vectors, 0.0, 8, n_cells=30)[0]
    layout = packed[0][0]
    assert len(layout) > 10 and layout[-1][1] + layout[-1][2] == 1  # many cells, one block
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "Generate" not in plan


def test_search_by_stored_cells_equals_exact_search(spark, tmp_path):
    from tomefold.operators import search as SE
    from tomefold.plans import registry as R
    sf, base = "/root/testdata/sf0.001", str(tmp_path / "index-cells")
    index, queries = R.search_index(spark, sf), R.search_queries(spark, sf)
    half = F.xxhash64("chunk_id") % 2 == 0
    SE.store_cells(index.where(half), base, R.DIM)
    SE.store_cells(index.where(~half), base, R.DIM, append=True)
    out = [sorted(tuple(r) for r in R._search_out(SE.search(queries, index, dim=R.DIM, **how)).collect())
           for how in ({"cells": base}, {"plan": "broadcast"})]
    assert out[0] == out[1] and len(out[0]) > 0
    with pytest.raises(ValueError):
        SE.search(queries, index, cells=base, probes=3)
