import os
import tempfile

import regex
from pyspark.sql import functions as F

from tomefold import constants as C
from tomefold.functions import text as T
from tomefold.operators import chunk as CH
from tomefold.operators import ingest as IN
from tomefold.operators import search as SE
from tomefold.plans import registry as R
from tomefold.streaming import query_stream as QS

SF = "/root/testdata/sf0.001"


def test_search_grid_plan_equals_broadcast_plan(spark):
    idx = R.search_index(spark, SF)
    q = R.search_queries(spark, SF)
    a = sorted(tuple(r) for r in R._search_out(SE.search(q, idx, plan="broadcast")).collect())
    b = sorted(tuple(r) for r in R._search_out(SE.search(q, idx, plan="grid")).collect())
    assert a == b and len(a) > 0


def test_pretoken_counter_matches_python_regex(spark):
    texts = ["Hello world, it's 2024!\n\n  Indented  code()  here...", "naïve café 12345 x\t\ty", ""]
    pat = regex.compile(C.PRETOKEN_PATTERN.replace("(?U)", ""))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(T.token_count("t", "pretoken").alias("n")).collect()]
    assert got == [len(pat.findall(t)) for t in texts]
    # pieces are lossless, so the overlap of n pieces is a suffix
    tail = df.select(T.overlap_tail("t", 4, "pretoken").alias("x")).first().x
    assert texts[0].endswith(tail) and len(pat.findall(tail)) == 4


def test_chunking_with_pretoken_counter(spark):
    d = R.both_docs(spark, SF)
    params = CH.ChunkParams(counter="pretoken")
    rows = CH.chunk_documents(d, params).groupBy("file_path").agg(
        F.max("chunk_index").alias("mx"), F.count("*").alias("n")).collect()
    assert rows and all(r.mx == r.n - 1 for r in rows)


def test_query_expansion(spark):
    q = spark.createDataFrame([(1, "Build a menu"), (2, "zebra")], "qid long, query string")
    syn = spark.createDataFrame([("menu", "overlay"), ("menu", "screen"), ("build", "create")],
                                "term string, synonym string")
    got = {r.qid: r.expanded_query for r in IN.expand_queries(q, syn).collect()}
    assert got == {1: "build create a menu overlay screen", 2: "zebra"}


def test_query_stream_appends_results(spark):
    src = tempfile.mkdtemp(prefix="tf-q-")
    out = tempfile.mkdtemp(prefix="tf-out-")
    ck = tempfile.mkdtemp(prefix="tf-ck-")
    R.search_queries(spark, SF).limit(6).write.mode("overwrite").parquet(os.path.join(src, "batch1"))
    schema = spark.read.parquet(os.path.join(src, "batch1")).schema
    stream = spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
    QS.start_query_stream(stream, R.search_index(spark, SF), out, ck).awaitTermination()
    res = spark.read.parquet(out)
    assert res.select("qid").distinct().count() == 6
    # the same batch again (a new checkpoint counts from 0): its answers are there once
    before = res.count()
    QS.start_query_stream(stream, R.search_index(spark, SF), out, tempfile.mkdtemp(prefix="tf-ck-")).awaitTermination()
    assert spark.read.parquet(out).count() == before


def test_mixed_batch_one_file_fails_to_embed(spark):
    from tomefold.operators import embed as EM
    from tomefold.operators import index as IX
    docs = spark.createDataFrame([("v", "ok.md", "# Ok\nfine text"), ("v", "bad.md", "# Bad\nFAIL here")],
                                 "version string, file_path string, content string")

    def emb(texts):
        if any("FAIL" in t for t in texts):
            raise ValueError("service said no")
        return [[1.0, 0.0] for _ in texts]
    nxt, led, err = IN.ingest_batch_with_errors(
        docs, spark.createDataFrame([], IX.INDEX_SCHEMA), spark.createDataFrame([], IX.LEDGER_SCHEMA), "r1",
        embed=lambda df: EM.embed_with(df, emb, batch_size=8, sleep=lambda s: None))
    assert [r.file_path for r in led.collect()] == ["ok.md"]
    assert [(r.file_path, r.stage) for r in err.collect()] == [("bad.md", "embed")]
    assert {r.file_path for r in nxt.collect()} == {"ok.md"}


def test_file_sources_and_end_to_end_job(spark):
    from tomefold.plans import jobs
    from tomefold.sources import files
    root = tempfile.mkdtemp(prefix="tf-html-")
    os.makedirs(os.path.join(root, "guide"))
    with open(os.path.join(root, "guide", "intro.html"), "w") as f:
        f.write('<div class="document" role="main"><h1>Intro</h1><p>Hello menu world.</p></div>')
    with open(os.path.join(root, "index.html"), "w") as f:
        f.write("<html><body><h1>Home</h1><p>Start here.</p></body></html>")
    with open(os.path.join(root, "broken.html"), "wb") as f:
        f.write(b"<p>\xff\xfe not utf-8</p>")
    good, bad = files.read_checked(spark, root, "*.html")
    assert sorted(r.file_path for r in good.collect()) == ["guide/intro.html", "index.html"]
    assert [r.file_path for r in bad.collect()] == ["broken.html"]
    pages = files.read_html_tree(spark, root).join(good.select(
        F.regexp_replace("file_path", r"\.html$", ".md").alias("file_path")), "file_path", "left_semi")
    base = tempfile.mkdtemp(prefix="tf-kb-")
    info = jobs.build_index(spark, pages, base)
    assert info["snapshot"].startswith(base)
    q = spark.createDataFrame([(1, "menu", None, None, None)], "qid long, query string, version string, limit int, min_score double")
    res = jobs.answer(spark, q, base).collect()
    assert res and res[0].file_path in ("guide/intro.md", "index.md")
    md = files.read_markdown_tree(spark, root)
    assert md.count() == 0


def test_parity_switches(spark):
    from tomefold.operators import convert as CV
    doc = "# A\nintro\n```\n# not a heading\ncode\n```\n# B\nend"
    df = spark.createDataFrame([("v", "f.md", doc)], "version string, file_path string, content string")
    plain = CH.chunk_documents(df).collect()
    aware = CH.chunk_documents(df, CH.ChunkParams(fence_aware=True)).collect()
    assert plain[0].heading_path == ["A", "not a heading", "B"]
    assert aware[0].heading_path == ["A", "B"]
    assert "# not a heading" in "".join(r.raw_chunk for r in aware) and "\u0000" not in "".join(r.raw_chunk for r in aware)
    with_v = CH.chunk_documents(df, CH.ChunkParams(id_includes_version=True)).collect()
    assert {r.chunk_id for r in with_v}.isdisjoint({r.chunk_id for r in plain})
    md, _ = CV.html_to_markdown("<h1>Title</h1><h2>Sub</h2><h3>Deep</h3><p>x</p>", heading_style="underlined")
    assert md.startswith("Title\n=====\n\nSub\n---\n\n### Deep")


def test_relative_paths_from_uri_roots(spark):
    from tomefold.sources import files
    root = tempfile.mkdtemp(prefix="tf-md-")
    os.makedirs(os.path.join(root, "a"))
    with open(os.path.join(root, "a", "x.md"), "w") as f:
        f.write("# X\nbody")
    for r in (root, "file://" + root, root + "/"):
        assert [row.file_path for row in files.read_markdown_tree(spark, r).collect()] == ["a/x.md"]
