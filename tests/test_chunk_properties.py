"""Random markdown through the Spark chunker and its DuckDB twin: same chunks.

Small size parameters make packing, overlap and sentence halving happen on
short generated documents."""

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomefold.operators import chunk as CH
from tomefold.plans import sql_twins as S

PIECES = ["alpha", "beta", "gamma", "delta", "x", "42", "é", "#", "## ", "# Head", "\n", "\n\n", "\n\n\n",
          ". ", ".", " ", "  ", "\t", "```", "`code`", "    indented", "　", "end."]
PARAMS = CH.ChunkParams(target_tokens=12, overlap_tokens=3, min_section_tokens=4, counter="words")

doc = st.lists(st.sampled_from(PIECES), min_size=0, max_size=120).map("".join)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(doc, min_size=1, max_size=25))
def test_spark_chunker_equals_duckdb_twin(spark, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, content string")
    got = {r.id: r.c for r in df.select("id", CH.chunk_texts("content", PARAMS).alias("c")).collect()}
    con = duckdb.connect()
    con.register("d", df.toPandas())
    twin = S.chunk_texts("content", PARAMS.target_tokens, PARAMS.overlap_tokens, PARAMS.min_section_tokens)
    sql = f"SELECT id, {twin} AS c FROM d"
    want = {r[0]: list(r[1]) for r in con.sql(sql).fetchall()}
    assert got == want


WORDS = ["ui", "build", "guide", "menu", "Menu", "how to", "example", "overlay", "screen", "widget", "code",
         "sprite", "tutorial", "api", "x", "zebra", "create", "method", "button", "navigation", "implement"]
text = st.lists(st.sampled_from(WORDS + [" ", "  ", "\t", "\n"]), max_size=12).map("".join)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(text, st.sampled_from(["tutorial", "example", "api", "reference", "guide", ""]),
                          text, st.lists(text, max_size=3), st.booleans(), text), min_size=1, max_size=30))
def test_boost_equals_duckdb_twin(spark, rows):
    from tomefold.operators import search as SE
    from tomefold.plans import registry as R
    schema = ("id long, query string, content_type string, title string, heading_path array<string>, "
              "has_code boolean, content string")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    got = {r.id: r.b for r in df.select("id", SE.boost_factor(
        "query", "content_type", "title", "heading_path", "has_code", "content").alias("b")).collect()}
    con = duckdb.connect()
    con.register("t", df.toPandas())
    twin = R.sql_boost("query", "content_type", "title", "heading_path", "has_code", "content")
    want = {r[0]: r[1] for r in con.sql(f"SELECT id, {twin} FROM t").fetchall()}
    assert got == want


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(doc, st.sampled_from(["a/b.md", "x_y_z.md", "root.md", "t/tutorial_1.md",
                                                "api/ref.x.md", "é_é/ü1a_b.md", ".md"])), min_size=1, max_size=25))
def test_text_functions_equal_duckdb_twins(spark, rows):
    from tomefold.functions import text as T
    df = spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(rows)], "id long, content string, path string")
    got = {r.id: tuple(r)[1:] for r in df.select(
        "id", T.heading_list("content").alias("h"), T.title_of(T.heading_list("content"), "path").alias("t"),
        T.has_code("content").alias("c"), T.token_count("content").alias("n"),
        T.overlap_tail("content", 3).alias("o"), T.content_type_of("path").alias("ct")).collect()}
    con = duckdb.connect()
    con.register("t", df.toPandas())
    sql = (f"SELECT id, {S.heading_list('content')}, {S.title(S.heading_list('content'), 'path')}, "
           f"{S.has_code('content')}, {S.tok('content')}, {S.overlap('content', 3)}, {S.content_type('path')} FROM t")
    want = {r[0]: (list(r[1]), *r[2:]) for r in con.sql(sql).fetchall()}
    assert {k: (list(v[0]), *v[1:]) for k, v in got.items()} == want


vec = st.lists(st.integers(-2, 2), min_size=4, max_size=4)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(vec, st.sampled_from([None, "a", "b"])), min_size=1, max_size=6),
       st.lists(st.tuples(vec, st.sampled_from(["a", "b"])), min_size=1, max_size=40),
       st.integers(1, 6), st.sampled_from(["broadcast", "grid"]))
def test_knn_equals_bruteforce_sql_with_ties(spark, qs, items, k, plan):
    from tomefold.operators import knn as K
    q = spark.createDataFrame([(i, [float(x) for x in v], ver) for i, (v, ver) in enumerate(qs)],
                              "qid long, qvec array<float>, qversion string")
    it = spark.createDataFrame([(f"i{j:02d}", [float(x) for x in v], ver) for j, (v, ver) in enumerate(items)],
                               "item_id string, vector array<float>, version string")
    got = sorted(tuple(r) for r in K.knn(q, it, k, default_min_score=0.1, plan=plan, block_rows=7).collect())
    con = duckdb.connect()
    con.register("q", q.toPandas())
    con.register("it", it.toPandas())
    sql = f"""
    SELECT qid, item_id, score, rank FROM (
      SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank
      FROM (SELECT q.qid, it.item_id,
                   floor(list_dot_product(q.qvec::DOUBLE[], it.vector::DOUBLE[])
                         / sqrt(list_dot_product(q.qvec::DOUBLE[], q.qvec::DOUBLE[])
                                * list_dot_product(it.vector::DOUBLE[], it.vector::DOUBLE[])) * 1e9 + 0.5) / 1e9 AS score
            FROM q, it
            WHERE (q.qversion IS NULL OR q.qversion = it.version)
              AND list_dot_product(q.qvec, q.qvec) > 0 AND list_dot_product(it.vector, it.vector) > 0)
      WHERE score >= 0.1)
    WHERE rank <= {k}"""
    want = sorted(tuple(r) for r in con.sql(sql).fetchall())
    assert got == want


files = st.dictionaries(st.sampled_from([f"f{i}.md" for i in range(8)]), st.sampled_from(["x", "y", "z"]),
                        max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(files, files)
def test_changes_and_upserts_match_set_semantics(spark, old, new):
    from tomefold.operators import index as IX
    from tomefold.operators import ingest as IN
    schema = "version string, file_path string, content string"
    old_df = spark.createDataFrame([("v", p, c) for p, c in old.items()], schema)
    new_df = spark.createDataFrame([("v", p, c) for p, c in new.items()], schema)
    got = {r.file_path: r.status for r in IN.changes(IX.ledger_rows(old_df, None, "r0"), new_df).collect()}
    want = {p: ("new" if p not in old else "changed" if old[p] != new[p] else "same") for p in new}
    want.update({p: "deleted" for p in old if p not in new})
    assert got == want
    # chunk rows: one per character of the content, id = path + char
    rows = lambda d: [("v", p, f"{p}:{ch}", i) for p, c in d.items() for i, ch in enumerate(c)]
    cols = "version string, file_path string, chunk_id string, chunk_index int"
    ex, nw = spark.createDataFrame(rows(old), cols), spark.createDataFrame(rows(new), cols)
    up = sorted(r.chunk_id for r in IX.upsert(ex, nw, mode="upsert").collect())
    rep = sorted(r.chunk_id for r in IX.upsert(ex, nw, mode="replace").collect())
    new_ids = {r[2] for r in rows(new)}
    assert up == sorted({r[2] for r in rows(old)} - new_ids | new_ids)
    assert rep == sorted({r[2] for r in rows(old) if r[1] not in new} | new_ids)
