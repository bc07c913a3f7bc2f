"""Compare versions of the document tree section by section (roadmap D5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunk as CH


def _with_heading(sections: DataFrame) -> DataFrame:
    first = F.substring_index("section", "\n", 1)
    return sections.withColumn("heading", F.when(first.startswith("#"), T.py_strip(first)).otherwise(F.lit("")))


def section_diff(old_docs: DataFrame, new_docs: DataFrame,
                 params: CH.ChunkParams = CH.ChunkParams()) -> DataFrame:
    """Full outer join of the sections of two versions by file, heading and occurrence.

    ``heading`` is a section's first line when it is a heading, else empty;
    ``occurrence`` numbers equal headings within a file, so a section that only
    moved is ``same``.  status = added | removed | changed | same."""
    def secs(d, tag):
        s = _with_heading(CH.sections_of(d, merged=False, params=params))
        w = Window.partitionBy("file_path", "heading").orderBy("sec_idx")
        return s.select("file_path", "heading", F.row_number().over(w).alias("occurrence"),
                        F.sha2("section", 256).alias(f"{tag}_hash"), F.col("n_tokens").alias(f"{tag}_tokens"))
    keys = ["file_path", "heading", "occurrence"]
    j = secs(old_docs, "old").join(secs(new_docs, "new"), keys, "full_outer")
    status = (F.when(F.col("old_hash").isNull(), F.lit("added"))
              .when(F.col("new_hash").isNull(), F.lit("removed"))
              .when(F.col("old_hash") != F.col("new_hash"), F.lit("changed"))
              .otherwise(F.lit("same")))
    return j.select(*keys, status.alias("status"),
                    F.coalesce("old_tokens", F.lit(0)).alias("old_tokens"),
                    F.coalesce("new_tokens", F.lit(0)).alias("new_tokens"))


def section_timeline(docs: DataFrame, versions: list[str], params: CH.ChunkParams = CH.ChunkParams()) -> DataFrame:
    """When each section was there: one row per stretch of consecutive versions that hold it.

    ``versions`` lists the versions of ``docs`` in their order; others are left out.  A
    section is named by file, heading and occurrence, as in ``section_diff``.  ``valid_from``
    and ``valid_to`` are the stretch's first and last version, ``n_versions`` its length,
    ``n_edits`` the versions in it whose text differs from the one before.  status =
    deprecated (gone after ``valid_to``) | returned (back after a gap) | added (not in the first
    version) | original; the last three reach the last version.  A file given twice
    in a version has its sections numbered on."""
    keys = ["file_path", "heading", "occurrence"]
    names = F.array(*[F.lit(v) for v in versions])
    s = _with_heading(CH.sections_of(docs.filter(F.col("version").isin(versions)), merged=False, params=params))
    # only the hash of a section's text is shuffled
    s = s.select("file_path", "heading", "sec_idx", F.sha2("section", 256).alias("text_hash"),
                 F.array_position(names, F.col("version")).alias("pos"))
    nth = Window.partitionBy("pos", "file_path", "heading").orderBy("sec_idx", "text_hash")
    s = s.withColumn("occurrence", F.row_number().over(nth))
    # a section has one row a version, so a window holds as many rows as there are versions
    w = Window.partitionBy(*keys).orderBy("pos")
    s = s.withColumn("island", F.col("pos") - F.row_number().over(w))
    edited = (F.lag("pos").over(w) == F.col("pos") - 1) & (F.lag("text_hash").over(w) != F.col("text_hash"))
    s = s.withColumn("edited", F.coalesce(edited, F.lit(False)).cast("int"))
    s = s.withColumn("first_pos", F.min("pos").over(Window.partitionBy(*keys)))
    g = s.groupBy(*keys, "island").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min("first_pos").alias("first_pos"),
                                       F.count("*").alias("n_versions"), F.sum("edited").alias("n_edits"))
    status = (F.when(F.col("hi") < len(versions), "deprecated").when(F.col("lo") > F.col("first_pos"), "returned")
              .when(F.col("lo") > 1, "added").otherwise("original"))
    return g.select(*keys, F.element_at(names, F.col("lo").cast("int")).alias("valid_from"),
                    F.element_at(names, F.col("hi").cast("int")).alias("valid_to"), "n_versions", "n_edits",
                    status.alias("status"))
