import numpy as np
from pyspark.sql import functions as F

from tomefold.operators import knn as K
from tomefold.sources.tables import table

SF = "/root/testdata/sf0.001"


def _frames(spark):
    e = table(spark, SF, "embeddings", "vec_id", "embedding")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    it = e.select(F.col("vec_id").cast("string").alias("item_id"), F.col("embedding").alias("vector"))
    return e, q, it


def test_broadcast_equals_grid_equals_bruteforce(spark):
    e, q, it = _frames(spark)
    b = sorted(tuple(r) for r in K.knn(q, it, 5, plan="broadcast").collect())
    g = sorted(tuple(r) for r in K.knn(q, it, 5, plan="grid", block_rows=64).collect())
    assert b == g
    pdf = e.toPandas()
    m = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
    n2 = (m * m).sum(1)
    s = K.quantize((m @ m.T) / np.sqrt(np.outer(n2, n2)))
    ids = pdf.vec_id.astype(str).to_numpy()
    brute = []
    for i, qid in enumerate(pdf.vec_id):
        order = sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:5]
        brute += [(int(qid), ids[j], float(s[i, j]), r + 1) for r, j in enumerate(order)]
    assert b == sorted(brute)


def test_ivf_probing_every_cell_is_exact(spark):
    _, q, it = _frames(spark)
    exact = sorted((r.qid, r.item_id) for r in K.knn(q, it, 5).collect())
    approx = sorted((r.qid, r.item_id) for r in K.knn_ivf(q, it, 5, n_cells=6, n_probe=6, block_rows=16).collect())
    assert approx == exact


def test_version_filter_and_floor(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], None)], "qid long, qvec array<float>, qversion string")
    it = spark.createDataFrame([("x", [1.0, 0.0], "a"), ("y", [1.0, 0.1], "b"), ("z", [0.0, 1.0], "a")],
                               "item_id string, vector array<float>, version string")
    got = sorted((r.qid, r.item_id) for r in K.knn(q, it, 5, default_min_score=0.5).collect())
    assert got == [(1, "x"), (2, "x"), (2, "y")]


def test_ivf_recall_with_few_probes(spark):
    _, q, it = _frames(spark)
    exact = {(r.qid, r.item_id) for r in K.knn(q, it, 10).collect()}
    approx = {(r.qid, r.item_id) for r in
              K.knn_ivf(q, it, 10, n_cells=8, n_probe=4).collect()}
    assert len(approx & exact) / len(exact) > 0.5


def test_ties_at_the_cut_keep_smallest_ids(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<float>")
    rows = [(f"id{i:03d}", [1.0, 0.0]) for i in range(60, 0, -1)] + [("best", [1.0, 0.0]), ("far", [0.0, 1.0])]
    it = spark.createDataFrame(rows, "item_id string, vector array<float>").repartition(3)
    for plan in ("broadcast", "grid"):
        got = [r.item_id for r in K.knn(q, it, 5, plan=plan, block_rows=7).orderBy("rank").collect()]
        assert got == ["best", "id001", "id002", "id003", "id004"], plan


def test_merge_topk_unit():
    s = np.array([[0.5, 0.9, 0.5, 0.5, -np.inf]])
    ids = np.array([["c", "a", "b", "d", "e"]], dtype=object)
    out_s, out_id = K._merge_topk(None, None, s, ids, 3)
    assert sorted(zip(out_s[0], out_id[0])) == [(0.5, "b"), (0.5, "c"), (0.9, "a")]


def test_many_item_partitions_are_coalesced_before_the_kernel(spark):
    _, q, it = _frames(spark)
    many = it.repartition(40)
    a = sorted(tuple(r) for r in K.knn(q, many, 5, plan="broadcast").collect())
    b = sorted(tuple(r) for r in K.knn(q, it, 5, plan="grid", block_rows=100).collect())
    assert a == b
    plan = K.knn(q, many, 5, plan="broadcast")._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" in plan
