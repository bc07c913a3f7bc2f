import os
import tempfile

import __spark_entry__ as E
from tomefold.streaming import ingest_stream as XS


def test_stream_ingest_picks_up_only_new_files(spark):
    root = tempfile.mkdtemp(prefix="tf-src-")
    base = tempfile.mkdtemp(prefix="tf-idx-")
    ck = tempfile.mkdtemp(prefix="tf-ck-")
    for name, text in [("a.md", "# A\nalpha"), ("sub/b.md", "# B\nbeta")]:
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "w") as f:
            f.write(text)
    XS.start_ingest(spark, root, base, ck).awaitTermination()
    assert sorted(r.file_path for r in spark.read.parquet(base + "/ledger").collect()) == ["a.md", "sub/b.md"]
    with open(os.path.join(root, "c.md"), "w") as f:
        f.write("# C\ngamma")
    XS.start_ingest(spark, root, base, ck).awaitTermination()
    led = sorted(r.file_path for r in spark.read.parquet(base + "/ledger").collect())
    assert led == ["a.md", "c.md", "sub/b.md"]
    idx = XS.latest_index(spark, base)
    assert sorted(r.file_path for r in idx.collect()) == ["a.md", "c.md", "sub/b.md"]


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracle_matches_on_small_sf(spark, duck):
    names = ["path_metadata", "headings", "chunk_docs", "embed_hashed", "knn_topk", "search_full",
             "incremental_changes", "exact_dups", "version_diff"]
    qs, sqls = E.queries(), E.oracle_sql()
    for n in names:
        sp = qs[n](spark, "/root/testdata/sf0.001").toPandas()
        dk = duck.sql(sqls[n]).df()
        cols = sorted(sp.columns)
        assert cols == sorted(dk.columns), n
        norm = lambda pdf: sorted(tuple(str(v) for v in r) for r in pdf[cols].itertuples(index=False))
        assert norm(sp) == norm(dk), n
