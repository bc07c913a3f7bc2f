import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tomefold.operators import cells as CE
from tomefold.operators import knn as K
from tomefold.operators import search as SE


def test_large_sides_are_cut_into_blocks_for_every_core(spark):
    qb, ib = K._block_counts(spark, 100_000, 100_000, 64)
    assert qb * ib >= 2 * spark.sparkContext.defaultParallelism
    assert K._block_counts(spark, 100, 100, 64) == (1, 1)
    assert max(K._block_counts(spark, 600_000, 600_000, 64)) <= 10  # rows are moved no more than ten times


def test_topk_of_batches_with_copies_versions_and_odd_vectors():
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (700, 6)).astype(np.float64)
    x[100:160] = x[100]
    x[200], x[201, 0], x[202, 0] = 0, np.nan, np.inf
    ids = np.array([f"i{n:03d}" for n in rng.permutation(700)], dtype=object)
    iv = rng.integers(0, 2, 700)
    q = rng.integers(-2, 3, (40, 6)).astype(np.float64)
    q[5], q[0] = 0, x[100]
    qver = rng.integers(-1, 2, 40)
    top = K._TopK(np.arange(40), q, qver, np.full(40, 0.2), 7)
    for lo in range(0, 700, 90):
        top.add(x[lo:lo + 90], ids[lo:lo + 90], iv[lo:lo + 90])
    got = sorted(zip(*top.result()))
    s = K._scores(q, np.einsum("ij,ij->i", q, q), x)
    want = []
    for r in range(40):
        able = [j for j in range(700) if s[r, j] >= 0.2 and (qver[r] < 0 or qver[r] == iv[j])]
        want += [(r, ids[j], s[r, j]) for j in sorted(able, key=lambda j: (-s[r, j], ids[j]))[:7]]
    assert got == sorted(want)


def test_a_query_travels_once_to_a_block_of_cells(spark):
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(300, 4)).astype(np.float32).tolist()
    it = spark.createDataFrame([(str(n), v, None, n % 30) for n, v in enumerate(vecs)],
                               "item_id string, vector array<float>, version string, cell int")
    q = spark.createDataFrame([(n, v, None, -1.0) for n, v in enumerate(vecs[:20])],
                              "qid long, qvec array<float>, qversion string, qmin double")
    seen = spark.sparkContext.accumulator(0)

    def probe(batch, held):
        seen.add(batch.num_rows * len(held))
        marked = np.zeros((batch.num_rows, len(held)), bool)
        marked[:, held % 2 == 0] = True
        return marked

    sizes = {c: 10 for c in range(30)}
    got = sorted((r.qid, r.item_id) for r in K._rank(K.probe_blocks(q, it, sizes, probe, 3, 120), 3).collect())
    even = it.where(F.col("cell") % 2 == 0)
    assert got == sorted((r.qid, r.item_id) for r in K.knn(q, even, 3).collect())
    many = K.probe_blocks(q, it, sizes, probe, 3, 4)  # cells larger than a block are cut
    assert got == sorted((r.qid, r.item_id) for r in K._rank(many, 3).collect())


def test_centroids_are_compared_in_bounded_slices():
    assert CE._rows_at_once(np.zeros((16384, 4))) * 16384 <= CE.ROW_CELLS


def test_search_ranks_and_joins_no_more_than_the_limit_needs(spark, monkeypatch):
    asked = []
    plain = K.knn
    monkeypatch.setattr(K, "knn", lambda q, i, k, **kw: asked.append(k) or plain(q, i, k, **kw))
    index = spark.createDataFrame([("1", f"c{n}", f"word{n} same text", "t", "p", "s", "u", ["h"], False, "api", [1.0, float(n)])
                                   for n in range(40)], "version string, chunk_id string, content string, title string, file_path string, "
                                  "section string, doc_url string, heading_path array<string>, has_code boolean, content_type string, vector array<float>")
    for limit, k in ((5, 10), (1, 5), (40, 30)):
        q = spark.createDataFrame([(1, "same text", None, limit, 0.0)], "qid long, query string, version string, limit int, min_score double")
        emb = lambda c: F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")
        rows = SE.search(q, index, dim=2, embedder=emb).collect()
        assert asked[-1] == k and 1 <= len(rows) <= limit


def test_hash_counts_of_slices():
    from tomefold.operators import embed as EM
    got = EM._signed_counts(pa.array([[0, 1, 5], None, [], [6, 6]], pa.list_(pa.int64())), 4)
    assert got.to_pylist() == [[1.0, 0.0, 0.0, 0.0], None, None, [0.0, 0.0, -2.0, 0.0]]


def test_first_floors_keep_every_neighbour():
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (5000, 6)).astype(np.float64)  # few kinds of vectors: many equal scores at the cut
    ids, iv = np.array([f"i{n:04d}" for n in rng.permutation(5000)], dtype=object), rng.integers(0, 2, 5000)
    q = rng.normal(size=(30, 6))
    q[10:] = x[:20]
    qver = rng.integers(-1, 2, 30)
    top = K._TopK(np.arange(30), q, qver, np.full(30, 0.1), 5)
    found = []
    merge = top._merge
    top._merge = lambda rows, *rest: found.append(len(rows)) or merge(rows, *rest)
    for lo in range(0, 5000, 2500):
        top.add(x[lo:lo + 2500], ids[lo:lo + 2500], iv[lo:lo + 2500])
    assert len(found) <= 6  # a merge for each version and batch, not one for each doubling
    s = K._scores(q, np.einsum("ij,ij->i", q, q), x)
    want = []
    for r in range(30):
        able = [j for j in range(5000) if s[r, j] >= 0.1 and (qver[r] < 0 or qver[r] == iv[j])]
        want += [(r, ids[j], s[r, j]) for j in sorted(able, key=lambda j: (-s[r, j], ids[j]))[:5]]
    assert sorted(zip(*top.result())) == sorted(want)


def test_near_pairs_of_uneven_tiles(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(45, 3)).astype(np.float32), rng.normal(size=(83, 3)).astype(np.float32)
    monkeypatch.setattr(K, "TILE", 20)
    floor = np.linspace(-3, 3, 45, dtype=np.float32)
    i, j = map(np.concatenate, zip(*K.near_pairs(a, b, floor)))
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(a @ b.T >= floor[:, None])))


def test_queries_of_a_version_without_items_are_not_moved(spark, monkeypatch):
    asked = []
    plain = K._block_counts
    monkeypatch.setattr(K, "_block_counts", lambda s, n_q, *rest: asked.append(n_q) or plain(s, n_q, *rest))
    it = spark.createDataFrame([(f"i{n}", [1.0, float(n)], "ab"[n % 2] if n else None) for n in range(6)],
                               "item_id string, vector array<float>, version string")
    q = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.0], ""), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], "none")],
                              "qid long, qvec array<float>, qversion string")
    got = sorted((r.qid, r.item_id) for r in K.knn(q, it, 2, plan="grid").collect())
    assert got == [(1, "i0"), (1, "i1"), (2, "i0"), (2, "i1"), (3, "i1"), (3, "i3")] and asked == [3]


def test_a_boost_is_worked_out_once(spark):
    index = spark.createDataFrame([("1", f"c{n}", "text", "t", "p", "s", "u", ["h"], False, "api", [1.0, float(n)]) for n in range(4)],
                                  "version string, chunk_id string, content string, title string, file_path string, section string, "
                                  "doc_url string, heading_path array<string>, has_code boolean, content_type string, vector array<float>")
    q = spark.createDataFrame([(1, "text", None, 2, 0.0)], "qid long, query string, version string, limit int, min_score double")
    emb = lambda c: F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")
    out = SE.search(q, index, dim=2, embedder=emb, rules=SE.RerankRules(title_boost=0.21257))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("0.21257") == 1
    assert [r["stage"] for r in out.collect()] == ["hit", "hit"]


def test_words_are_hashed_as_in_the_plan(spark):
    from tomefold.operators import embed as EM
    words = ["the", "Ärger", "漢字", "the", "x1"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    want = [r.h[0] for r in df.select(EM.token_hashes("t").alias("h")).collect()]
    assert EM._word_hashes(pa.array([w.lower() for w in words])).tolist() == want
