"""File-tree sources (S1-S4): HTML and markdown trees as DataFrames.

``wholetext`` gives one row per file; ``_metadata.file_path`` the absolute
path, turned into a path relative to the tree root (P1).  Undecodable files
are split off by reading bytes and checking UTF-8 validity natively.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C


def _norm_root(root: str) -> str:
    """``file:///a/b``, ``file:/a/b`` and ``/a/b`` name the same local root."""
    import re
    return re.sub(r"^file:(//)?", "", root).rstrip("/") + "/"


def _rel(path_col, root: str):
    """Path relative to ``root``; local ``file:`` URIs and plain paths compare equal,
    other schemes (``s3a://``, ``hdfs://``) are compared as given."""
    prefix = _norm_root(root)
    p = F.regexp_replace(path_col, "^file:(//)?", "")
    return F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 1 << 30)).otherwise(p)


def read_tree(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``(file_path, content)`` for every file under ``root`` matching ``glob``."""
    df = (spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", glob).load(root))
    return df.select(_rel(F.col("_metadata.file_path"), root).alias("file_path"), F.col("value").alias("content"))


def read_html_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(page_id, file_path, html)``; ``file_path`` keeps the tree, suffix ``.md``."""
    t = read_tree(spark, root, "*.html")
    return t.select(F.xxhash64("file_path").alias("page_id"),
                    F.regexp_replace("file_path", r"\.html$", ".md").alias("file_path"),
                    F.col("content").alias("html"))


def read_markdown_tree(spark: SparkSession, root: str, version: str = C.DEFAULT_VERSION) -> DataFrame:
    """A docs frame ``(version, file_path, content)``."""
    return read_tree(spark, root, "*.md").select(F.lit(version).alias("version"), "file_path", "content")


def read_checked(spark: SparkSession, root: str, glob: str) -> tuple[DataFrame, DataFrame]:
    """S3: (good rows, error rows): a file that is not valid UTF-8 fails alone."""
    b = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
         .option("pathGlobFilter", glob).load(root))
    b = b.select(_rel(F.col("path"), root).alias("file_path"), "content")
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    good = b.filter(ok).select("file_path", F.col("content").cast("string").alias("content"))
    bad = b.filter(~ok).select("file_path", F.lit("read").alias("stage"),
                               F.lit("content is not valid UTF-8").alias("error"))
    return good, bad


def write_markdown_tree(docs: DataFrame, out_dir: str) -> None:
    """S4 as a table: converted docs partitioned by version (the path is a column).

    Only the versions in ``docs`` are replaced; the others in ``out_dir`` stay."""
    (docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("version").parquet(out_dir))
