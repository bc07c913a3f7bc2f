"""Document collections derived from the given tables.

``docs`` frames always have the shape ``(version, file_path, content)``, the
shape of a markdown tree read from disk (see ``sources.files``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .tables import table

# fixed values: versions used for the two-version collection
OLD_VERSION = "1.28.0"
NEW_VERSION = C.DEFAULT_VERSION
NEXT_VERSION = "1.30.0"
REVISION_NOTE = "\n\nRevised: this text was reviewed and updated."

_URL_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"


def document_docs(spark: SparkSession, sf_dir: str, version: str = C.DEFAULT_VERSION) -> DataFrame:
    """``documents`` as markdown files ``{lang}/{source}/{doc_id}.md``."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return d.select(
        F.lit(version).alias("version"),
        F.format_string("%s/%s/%d.md", "lang", "source", "doc_id").alias("file_path"),
        F.col("text").alias("content"))


def conversation_docs(spark: SparkSession, sf_dir: str, version: str = C.DEFAULT_VERSION) -> DataFrame:
    """One markdown file per conversation: ``# Conversation N`` then one
    ``## Turn t (role)`` section per turn, in turn order."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    turns = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    body = F.array_join(F.transform("turns", lambda t: F.format_string(
        "## Turn %d (%s)\n\n%s\n", t["turn"], t["role"], t["text"])), "\n")
    return turns.select(
        F.lit(version).alias("version"),
        F.format_string("conversations/%d.md", "conv_id").alias("file_path"),
        F.concat(F.format_string("# Conversation %d\n\n", "conv_id"), body).alias("content"))


def page_file_path(url, page_id) -> F.Column:
    """``scheme://host/a/b.html?x#y`` of page 7 -> ``host/a/b/7.md``.

    URLs that differ only in query or fragment map to the same path, so the page
    id names the file (``index`` stands for an empty path)."""
    u = F.col(url) if isinstance(url, str) else url
    pid = F.col(page_id) if isinstance(page_id, str) else page_id
    host = F.regexp_extract(u, _URL_RE, 1)
    path = F.regexp_replace(F.regexp_extract(u, _URL_RE, 2), r"^/+|/+$", "")
    path = F.regexp_replace(path, r"\.html?$", "")
    path = F.when(path == "", F.lit("index")).otherwise(path)
    return F.concat(host, F.lit("/"), path, F.lit("/"), pid.cast("string"), F.lit(".md"))


def two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old and new version of the document tree, derived from the tables.

    New = old without documents labelled quality 0 (deleted), with a revision
    note appended to documents labelled toxic 1 (changed), plus every
    ``benchmark`` item as a new file ``bench/{item_id}.md``.
    """
    old = document_docs(spark, sf_dir, OLD_VERSION)
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    kept = (d.join(lab, "doc_id", "left")
            .filter(F.coalesce(F.col("quality"), F.lit(1)) != 0)
            .select(
                F.lit(NEW_VERSION).alias("version"),
                F.format_string("%s/%s/%d.md", "lang", "source", "doc_id").alias("file_path"),
                F.when(F.col("toxic") == 1, F.concat("text", F.lit(REVISION_NOTE)))
                .otherwise(F.col("text")).alias("content")))
    bench = table(spark, sf_dir, "benchmark", "item_id", "text").select(
        F.lit(NEW_VERSION).alias("version"),
        F.format_string("bench/%d.md", "item_id").alias("file_path"),
        F.col("text").alias("content"))
    return old, kept.unionByName(bench)


def three_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``two_versions`` and a third: the old tree without documents labelled toxic 1, so
    files deleted before return, added ones go and the others have their old text."""
    old, new = two_versions(spark, sf_dir)
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    toxic = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(F.col("toxic") == 1).select("doc_id")
    third = d.join(toxic, "doc_id", "left_anti").select(
        F.lit(NEXT_VERSION).alias("version"),
        F.format_string("%s/%s/%d.md", "lang", "source", "doc_id").alias("file_path"), F.col("text").alias("content"))
    return old.unionByName(new).unionByName(third)
