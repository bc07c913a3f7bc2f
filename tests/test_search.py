import itertools
import math

from pyspark.sql import functions as F

from tomefold.operators import search as SE

DIM = 5


def vec_for(base):
    """Integer vector whose cosine with e1 is exactly base (= p / 100)."""
    p = round(base * 100)
    rest = 100 * 100 - p * p
    for a, b, c, d in itertools.product(range(101), repeat=4):
        if a * a + b * b + c * c + d * d == rest:
            return [float(p), float(a), float(b), float(c), float(d)]
        if a * a > rest:
            break
    raise ValueError(base)


CASES = [  # (query, content_type, title, headings, has_code, content, base, stage, score)
    ("how to build menu", "tutorial", "Menu", ["Menu", "Overlay"], True, "an overlay", 0.32, "hit", 0.528),
    ("zebra", "reference", "X", [], False, "text", 0.39, "fallback", 0.39),
    ("zebra", "reference", "X", [], False, "text", 0.40, "hit", 0.4),
    ("menu menu", "reference", "Menu", [], False, "text", 0.32, "hit", 0.416),
    ("sprite", "example", "Sprite", ["Sprite"], False, "text", 0.90, "hit", 1.215),
    ("build", "reference", "X", [], False, "a widget tree", 0.34, "hit", 0.408),
    ("sprite", "example", "Sprite", ["Sprite"], False, "text", 0.28, "fallback", 0.28),
    ("zebra", "reference", "X", [], False, "text", 0.15, "fallback", 0.15),
    ("zebra", "reference", "X", [], False, "text", 0.05, "none", 0.0),
]


def test_hand_worked_rerank_cases(spark):
    idx = spark.createDataFrame(
        [(f"c{i}", f"id{i}", f"f{i}.md", 0, content, "s", ctype, title, heads, code, "/u", vec_for(base))
         for i, (_, ctype, title, heads, code, content, base, _, _) in enumerate(CASES)],
        "version string, chunk_id string, file_path string, chunk_index int, content string, section string, "
        "content_type string, title string, heading_path array<string>, has_code boolean, doc_url string, "
        "vector array<float>")
    qs = spark.createDataFrame([(i, q, f"c{i}", None, None) for i, (q, *_rest) in enumerate(CASES)],
                               "qid long, query string, version string, limit int, min_score double")
    e1 = lambda c: F.array(*[F.lit(1.0 if j == 0 else 0.0) for j in range(DIM)]).cast("array<float>")
    got = {r.qid: r for r in SE.search(qs, idx, dim=DIM, embedder=e1).collect()}
    for i, case in enumerate(CASES):
        stage, score = case[7], case[8]
        assert got[i].stage == stage, (i, got[i])
        assert math.isclose(got[i].similarity_score, score, abs_tol=1e-9), (i, got[i].similarity_score)
    assert got[8].title == "No Results" and got[8].version == "c8"


def test_error_row_for_missing_vector(spark):
    idx = spark.createDataFrame([("v", "id", "f.md", 0, "t", "s", "reference", "X", [], False, "/u", vec_for(0.5))],
                                "version string, chunk_id string, file_path string, chunk_index int, content string, "
                                "section string, content_type string, title string, heading_path array<string>, "
                                "has_code boolean, doc_url string, vector array<float>")
    qs = spark.createDataFrame([(1, "x", None, None, None)],
                               "qid long, query string, version string, limit int, min_score double")
    out = SE.search(qs, idx, dim=DIM, embedder=lambda c: F.lit(None).cast("array<float>")).collect()
    assert len(out) == 1 and out[0].stage == "error" and out[0].version == "unknown"
