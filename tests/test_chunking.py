import pytest

from tomefold.functions import text as T
from tomefold.operators import chunk as CH

EDGE_DOCS = [
    ("edge/no_headers.md", "Just a paragraph.\nAnother line."),
    ("edge/blank_first.md", "\n# Title\nbody text here"),
    ("edge/indented.md", "intro\n  # indented is no split\n# Real\nmore"),
    ("edge/fence.md", "# A\n```\n# inside fence\n```\ntext"),
    ("edge/blank_chunks.md", "# A\n\n   \n\n# B\n" + "word " * 50),
    ("edge/huge_sentence.md", "# H\n\n" + "w " * 2000),
    ("root.md", "# Root\n" + "Sentence number one is here. " * 400),
    ("a.md/b.md", "# X\n\n" + ("para " * 300 + "\n\n") * 5),
    ("edge/small_last.md", "# A\n" + "long " * 150 + "\n# B\nshort"),
    ("edge/merge_chain.md", "# A\nx\n# B\ny\n# C\nz\n# D\n" + "w " * 120),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([("1.0", p, c) for p, c in EDGE_DOCS], "version string, file_path string, content string")


def test_split_by_headers(spark):
    df = spark.createDataFrame([(c,) for _, c in EDGE_DOCS[:4]], "c string")
    got = [r.s for r in df.select(CH.split_by_headers("c").alias("s")).collect()]
    assert got[0] == ["Just a paragraph.\nAnother line."]
    assert got[1] == ["", "# Title\nbody text here"]
    assert got[2] == ["intro\n  # indented is no split", "# Real\nmore"]
    assert got[3] == ["# A\n```", "# inside fence\n```\ntext"]


def test_merge_small_sections(spark):
    df = spark.createDataFrame([(EDGE_DOCS[-1][1],), (EDGE_DOCS[-2][1],)], "c string")
    got = [r.m for r in df.select(CH.merge_small_sections(CH.split_by_headers("c")).alias("m")).collect()]
    assert got[0] == ["# A\nx\n\n# B\ny\n\n# C\nz\n\n# D\n" + "w " * 120]
    assert len(got[1]) == 2 and got[1][1] == "# B\nshort"  # a small last section stays alone


def test_large_split_bounds(spark):
    content = "# Big\n\n" + "This is a test sentence. " * 300
    df = spark.createDataFrame([("1.0", "big.md", content)], "version string, file_path string, content string")
    rows = CH.chunk_documents(df).select(T.token_count("raw_chunk").alias("n")).collect()
    assert len(rows) > 1
    assert all(r.n <= 900 + 175 for r in rows)


def test_spark_equals_duckdb_on_edge_rows(spark, edge):
    import duckdb
    sp = sorted((r.file_path, r.chunk_index, r.chunk_id, r.content, r.has_code) for r in
                CH.chunk_documents(edge, CH.ChunkParams(counter="words")).collect())
    con = duckdb.connect()
    con.register("edge_docs", edge.toPandas())
    from tomefold.plans.registry import _sql_chunks
    dk = sorted(tuple(r) for r in con.sql(
        f"SELECT file_path, chunk_index, chunk_id, content, has_code FROM ({_sql_chunks('SELECT * FROM edge_docs')})"
    ).fetchall())
    assert sp == dk


def test_chunk_properties(spark, edge):
    rows = CH.chunk_documents(edge).orderBy("file_path", "chunk_index").collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.file_path, []).append(r)
    for path, content in EDGE_DOCS:
        chunks = by_doc.get(path, [])
        assert [c.chunk_index for c in chunks] == list(range(len(chunks)))  # dense index
        assert all(c.content == c.content.strip() and c.content for c in chunks)
        words = set(content.split())
        assert words <= set(w for c in chunks for w in c.raw_chunk.split() + c.content.split()) | {"."}
    # blank sections never become chunks, and a rerun gives the same ids
    again = CH.chunk_documents(edge).select("chunk_id").collect()
    assert sorted(r.chunk_id for r in again) == sorted(r.chunk_id for r in rows)
