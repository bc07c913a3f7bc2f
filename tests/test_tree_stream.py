"""The tree stream: added, edited, deleted, emptied, undecodable and failing files."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tomefold.operators import embed as EM
from tomefold.operators import index as IX
from tomefold.streaming import tree_stream as TS


def _put(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def _live(spark, base):
    return {r.file_path: r.content for r in IX.read_live_index(spark, base).select("file_path", "content").collect()}


@pytest.fixture
def tree(tmp_path):
    return str(tmp_path / "tree"), str(tmp_path / "index"), str(tmp_path / "ck")


def test_edits_and_deletions_reach_the_index(spark, tree):
    root, base, ck = tree
    for name in ("a.md", "sub/b.md", "c.md", "e.md"):
        _put(root, name, f"# {name}\nalpha")
    TS.sync_tree(spark, root, base, ck).awaitTermination()
    assert set(_live(spark, base)) == {"a.md", "sub/b.md", "c.md", "e.md"}
    n_rows = spark.read.parquet(base + "/chunks").count()

    time.sleep(0.05)
    _put(root, "a.md", "# a.md\nbeta!")          # edited
    _put(root, "d.md", "# d.md\nnew")            # added
    _put(root, "e.md", "")                       # emptied
    os.utime(os.path.join(root, "c.md"))         # touched, same text
    os.remove(os.path.join(root, "sub/b.md"))    # deleted
    TS.sync_tree(spark, root, base, ck).awaitTermination()
    live = _live(spark, base)
    assert set(live) == {"a.md", "c.md", "d.md"} and "beta!" in live["a.md"]
    assert spark.read.parquet(base + "/chunks").count() == n_rows + 2  # c.md was not written again
    gone = spark.read.parquet(base + "/ledger").filter(F.col("content_hash").isNull())
    assert sorted(r.file_path for r in gone.collect()) == ["e.md", "sub/b.md"]

    _put(root, "sub/b.md", "# back\nagain")      # a deleted file returns
    for name in ("a.md", "c.md"):
        os.remove(os.path.join(root, name))
    TS.sync_tree(spark, root, base, ck).awaitTermination()
    assert set(_live(spark, base)) == {"d.md", "sub/b.md"}

    for name in ("d.md", "e.md", "sub/b.md"):    # an empty tree is a tree
        os.remove(os.path.join(root, name))
    TS.sync_tree(spark, root, base, ck).awaitTermination()
    assert _live(spark, base) == {}


def test_undecodable_file_fails_alone_and_keeps_its_earlier_chunks(spark, tree):
    root, base, ck = tree
    _put(root, "a.md", "# a\nalpha")
    _put(root, "bad.md", b"# bad\n\xff\xfe\xff")
    TS.sync_tree(spark, root, base, ck).awaitTermination()
    assert set(_live(spark, base)) == {"a.md"}
    err = spark.read.parquet(base + "/errors").collect()
    assert [(r.file_path, r.stage) for r in err] == [("bad.md", "read")]
    time.sleep(0.05)
    _put(root, "a.md", b"\xff\xff")
    _put(root, "bad.md", "# bad\nmended")
    TS.sync_tree(spark, root, base, ck).awaitTermination()
    live = _live(spark, base)
    assert set(live) == {"a.md", "bad.md"} and "alpha" in live["a.md"]


def test_failed_embedding_is_tried_again_without_an_edit(spark, tree):
    root, base, ck = tree
    _put(root, "a.md", "# a\nalpha")
    _put(root, "b.md", "# b\nbeta")

    def failing(df):
        out = EM.embed_hashed(df, "content")
        return out.withColumn("embed_error", F.when(F.col("file_path") == "b.md", F.lit("down")))

    TS.sync_tree(spark, root, base, ck, embed=failing).awaitTermination()
    assert set(_live(spark, base)) == {"a.md"}
    TS.sync_tree(spark, root, base, ck).awaitTermination()
    assert set(_live(spark, base)) == {"a.md", "b.md"}
    TS.sync_tree(spark, root, base, ck).awaitTermination()
    assert spark.read.parquet(base + "/chunks").count() == 2


def test_missing_root_fails(spark, tree):
    root, base, ck = tree
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        TS.sync_tree(spark, root, base, ck)


def test_waiting_listings_are_taken_together(spark, tree):
    """A run that stopped after its listing: the next run sees both, the later one counts."""
    root, base, ck = tree
    _put(root, "a.md", "# a\nalpha")
    _put(root, "b.md", "# b\nbeta")
    TS.write_listing(spark, root, base)
    os.remove(os.path.join(root, "b.md"))
    TS.sync_tree(spark, root, base, ck).awaitTermination()
    assert set(_live(spark, base)) == {"a.md"}
