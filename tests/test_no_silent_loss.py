"""Faults that must not lose or misreport rows."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tomefold.operators import convert as CV
from tomefold.operators import embed as EM
from tomefold.operators import index as IX
from tomefold.operators import ingest as IN
from tomefold.operators import knn as KN
from tomefold.operators import search as SE
from tomefold.operators import versions as VS
from tomefold.plans import jobs
from tomefold.sources import files

DOCS = "version string, file_path string, content string"


def test_truncated_index_file_fails_the_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("'v' version", "concat('f', id) file_path").repartition(2).write.parquet(path)
    part = sorted(glob.glob(f"{path}/part-*.parquet"))[0]
    data = open(part, "rb").read()
    open(part, "wb").write(data[:len(data) // 2])
    os.remove(os.path.join(path, "." + os.path.basename(part) + ".crc"))
    with pytest.raises(Exception):
        IX.read_or_empty(spark, path, IX.LEDGER_SCHEMA).collect()
    assert IX.read_or_empty(spark, str(tmp_path / "none"), IX.LEDGER_SCHEMA).count() == 0


@pytest.mark.parametrize("html,words", [
    ("<html><head><title>T</title><body><p>kept text</p>", ["kept text"]),
    ("<head><meta charset=x><p>no body tag</p>", ["no body tag"]),
    ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", ["a | b", "1 | 2"]),
    ("<p>see <img src='x.png' alt='a map'> here</p>", ["![a map](x.png)"]),
    ("<head><script>var x;</script></head><body><noscript>hidden<p>still hidden</noscript><p>shown</p>", ["shown"]),
])
def test_converter_keeps_page_text(html, words):
    md, _ = CV.html_to_markdown(html)
    assert all(w in md for w in words) and "hidden" not in md and "var x" not in md


def test_trees_of_two_versions_stay(spark, tmp_path):
    for v in ("1", "2"):
        files.write_markdown_tree(spark.createDataFrame([(v, "a.md", "text " + v)], DOCS), str(tmp_path / "tree"))
    got = spark.read.parquet(str(tmp_path / "tree")).selectExpr("cast(version as string) v", "content").collect()
    assert sorted(map(tuple, got)) == [("1", "text 1"), ("2", "text 2")]


def test_changes_by_version_with_tombstones(spark):
    ledger = spark.createDataFrame(
        [("1", "a", "h1"), ("2", "a", "h2"), ("2", "gone", None), ("2", "back", None)], "version string, file_path string, content_hash string")
    ledger = ledger.withColumn("ts", F.current_timestamp()).withColumn("n_chunks", F.lit(1)).withColumn("run_id", F.lit("r"))
    docs = spark.createDataFrame([("2", "back", "x"), ("2", "new", "y")], DOCS)
    got = {(r.version, r.file_path): r.status for r in IN.changes(ledger, docs, ["2"]).collect()}
    assert got == {("2", "a"): "deleted", ("2", "back"): "new", ("2", "new"): "new"}
    pending = IN.pending_by_path(docs, ledger)
    assert sorted(r.file_path for r in pending.collect()) == ["back", "new"]


def test_a_vanished_page_is_retired(spark, tmp_path):
    def pages(*names):
        return spark.createDataFrame([(i, f"{n}.md", f"<h1>{n}</h1><p>text about {n}</p>") for i, n in enumerate(names)],
                                     "page_id long, file_path string, html string")
    base = str(tmp_path / "kb")
    jobs.build_index(spark, pages("a", "b"), base, version="1", whole_tree=True)
    jobs.build_index(spark, pages("b", "c"), base, version="1", whole_tree=True)
    live = {r.file_path for r in IX.read_live_index(spark, base).collect()}
    assert live == {"b.md", "c.md"}
    jobs.build_index(spark, pages("a"), base, version="1")           # an addition, not the whole tree
    assert {r.file_path for r in IX.read_live_index(spark, base).collect()} == {"a.md", "b.md", "c.md"}


def test_upsert_keeps_one_row_per_id(spark):
    schema = "version string, file_path string, chunk_id string, chunk_index int"
    old = spark.createDataFrame([("v", "a", "1", 0)], schema)
    new = spark.createDataFrame([("v", "a", "1", 1), ("v", "b", "1", 2)], schema)
    assert IX.upsert(old, new, mode="upsert").count() == 1


def test_embedder_is_called_once_per_text(spark):
    df = EM.embed_with(spark.createDataFrame([("a",), ("b",)], "content string"), lambda t: [[1.0] for _ in t])
    plan = df.filter("embed_error is null").filter("vector is not null")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_sections_pair_by_heading(spark):
    old = spark.createDataFrame([("1", "f", "# A\nx\n# B\ny\n# C\nz\n")], DOCS)
    new = spark.createDataFrame([("2", "f", "# New\nn\n# A\nx\n# B\nyy\n# C\nz\n")], DOCS)
    got = {r.heading: r.status for r in VS.section_diff(old, new).collect()}
    assert got == {"# New": "added", "# A": "same", "# B": "changed", "# C": "same"}


def test_wrong_sized_vectors_in_both_plans(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<float>")
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0]), ("c", None)], "item_id string, vector array<float>")
    for plan in ("broadcast", "grid"):
        assert [r.item_id for r in KN.knn(q, items, 5, plan=plan).collect()] == ["a"]
    assert [r.item_id for r in KN.knn_ivf(q, items, 5).collect()] == ["a"]


def test_approximate_search_filters_versions(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], "v1"), (2, [1.0, 0.0], None)], "qid long, qvec array<float>, qversion string")
    items = spark.createDataFrame([("a", [1.0, 0.0], "v1"), ("b", [1.0, 0.1], "v2"), ("c", [0.0, 1.0], "v1")],
                                  "item_id string, vector array<float>, version string")
    got = KN.knn_ivf(q, items, 5, n_cells=2, n_probe=2, default_min_score=0.5).collect()
    assert sorted((r.qid, r.item_id) for r in got) == [(1, "a"), (2, "a"), (2, "b")]


def test_limit_below_one_is_an_error_row(spark):
    index = spark.createDataFrame([], IX.INDEX_SCHEMA)
    q = spark.createDataFrame([(1, "word", None, 0, None)], "qid long, query string, version string, limit int, min_score double")
    got = SE.search(q, index).collect()
    assert [(r.stage, "limit" in r.content) for r in got] == [("error", True)]


def _index(spark, *texts):
    docs = spark.createDataFrame([("1", f"f{i}.md", t) for i, t in enumerate(texts)], DOCS)
    from tomefold.operators import chunk as CH
    return EM.embed_hashed(CH.chunk_documents(docs), "content")


def test_search_with_probes_and_synonyms(spark):
    index = _index(spark, "# Soup\nonion soup with toast", "# Bread\nflour water salt", "# Roses\nprune roses in spring")
    q = spark.createDataFrame([(1, "potage", None, 1, 0.2), (2, "flour water salt", "1", 2, 0.2)],
                              "qid long, query string, version string, limit int, min_score double")
    syn = spark.createDataFrame([("potage", "onion"), ("potage", "soup"), ("potage", "toast")], "term string, synonym string")
    exact = sorted(map(str, SE.search(q, index, synonyms=syn).collect()))
    assert any("Soup" in r and "stage='hit'" in r and "qid=1," in r for r in exact)
    assert sorted(map(str, SE.search(q, index, synonyms=syn, probes=1 << 20).collect())) == exact
