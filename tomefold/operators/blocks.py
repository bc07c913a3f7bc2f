"""Repeated blocks (D3): runs of consecutive lines that stand in many documents (navigation, footers).

Lines are compared stripped; blank ones are left out, so blocks run over them.  For each line,
``L`` is the most lines from there on that at least ``cut`` documents hold in this order.  A run is
maximal if the line before it does not reach as far; the blocks are the maximal runs of ``min_lines``
or more.  Every such run is found, whatever its length.

Method: runs of 1, 2, 4, ... lines are named by hashes, each name made from two names of half the
length, and only those of ``cut`` documents go on, so that most lines drop out at once.  A run of
any other length is two overlapping named runs, as far as its last line; lengths between the
powers are found bit by bit.  A length is asked once per name, not per place.  Everything is joins and
counts on hashed keys; the rounds grow with the logarithm of the longest block.  Names are 64-bit hashes.

Defined cases: ids are unique; null texts have no lines; an empty table has no blocks; a block within a longer one is one of
its own only where it also stands outside it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

_KEY = ["level", "name", "length", "tail"]


def _lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), T.py_strip), lambda x: x != "")


def _frequent(places: DataFrame, keys: list[str], cut: int) -> DataFrame:
    counts = places.groupBy(*keys).agg(F.countDistinct("id").alias("n_docs"))
    return counts.where(F.col("n_docs") >= cut)


def _places(lines: DataFrame, cut: int) -> list[DataFrame]:
    """For each level, (id, pos, name) of the runs of 2^level lines that ``cut`` documents hold."""
    runs, levels, step = lines, [], 1
    while True:
        runs = written(runs.join(_frequent(runs, ["name"], cut).select("name"), "name", "left_semi"), "block-runs")
        if runs.isEmpty():
            return levels
        levels.append(runs)
        second = runs.select("id", (F.col("pos") - step).alias("pos"), F.col("name").alias("second"))
        runs = runs.join(second, ["id", "pos"]).select("id", "pos", F.xxhash64("name", "second").alias("name"))
        step *= 2


def _with_tail(places: DataFrame, runs: DataFrame) -> DataFrame:
    """``places`` with ``tail``, the name of the run of 2^level lines that ends where they end.

    Places whose last lines are in no frequent run drop out."""
    tails = runs.select("level", "id", F.col("pos").alias("at"), F.col("name").alias("tail"))
    at = (F.col("pos") + F.col("length") - F.expr("shiftleft(1, level)")).cast("int")
    return places.withColumn("at", at).join(tails, ["level", "id", "at"]).drop("at")


def _counted(asked: DataFrame, runs: DataFrame, cut: int) -> DataFrame:
    """(level, name, length, tail, n_docs) of the lengths ``asked`` (level, name, length) that ``cut`` documents hold."""
    return _frequent(_with_tail(runs.join(asked.distinct(), ["level", "name"]), runs), _KEY, cut)


def _all_levels(levels: list[DataFrame]) -> DataFrame:
    runs = levels[0].withColumn("level", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        runs = runs.unionByName(level.withColumn("level", F.lit(k)))
    return runs


def _longest(levels: list[DataFrame], cut: int) -> DataFrame:
    """(id, pos, level, name, length): the longest run of ``cut`` documents at every place."""
    runs = _all_levels(levels)
    best = runs.groupBy("id", "pos").agg(F.max(F.struct("level", "name")).alias("b")).select(
        "id", "pos", "b.level", "b.name", F.expr("shiftleft(1, b.level)").alias("length"))
    for bit in range(len(levels) - 2, -1, -1):
        best = written(best, "block-lengths")
        longer = best.where(F.col("level") > bit).withColumn("length", F.col("length") + (1 << bit))
        longer = written(_with_tail(longer, runs), "block-asked")
        held = _counted(longer.select("level", "name", "length"), runs, cut).select(*_KEY)
        grown = longer.join(held, _KEY, "left_semi").select("id", "pos", F.col("length").alias("longer"))
        best = best.join(grown, ["id", "pos"], "left").withColumn("length", F.coalesce("longer", "length")).drop("longer")
    return best


def block_places(docs: DataFrame, min_docs: int = 3, share: float = 0.0, min_lines: int = 2, id_col: str = "doc_id",
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Places and blocks: (id, pos, length, level, name, tail) of every maximal run of at least
    ``min_lines`` lines in at least ``max(min_docs, share * N)`` documents, and its counts
    (level, name, length, tail, n_docs).

    ``pos`` counts the non-blank lines from 0."""
    cut = max(min_docs, int(np.ceil(share * docs.count()))) if share else min_docs
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    levels = _places(lines.select("id", "pos", F.xxhash64("line").alias("name")), cut)
    if not levels:
        levels = [written(lines.where(F.lit(False)).select("id", "pos", F.xxhash64("line").alias("name")), "block-runs")]
    before = Window.partitionBy("id").orderBy("pos")
    reach = F.when(F.lag("pos").over(before) == F.col("pos") - 1, F.lag("length").over(before)).otherwise(F.lit(0))
    tops = _longest(levels, cut).withColumn("reach", reach).where(
        (F.col("reach") <= F.col("length")) & (F.col("length") >= min_lines)).drop("reach")
    runs = _all_levels(levels)
    places = written(_with_tail(tops, runs), "block-places")
    return places, _counted(places.select("level", "name", "length"), runs, cut)


def repeated_blocks(docs: DataFrame, min_docs: int = 3, share: float = 0.0, min_lines: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, n_lines, n_docs, n_places): the blocks' lines, the documents that hold them anywhere
    and the places where they are a maximal run."""
    places, counts = block_places(docs, min_docs, share, min_lines, id_col, text_col)
    blocks = places.groupBy(*_KEY).agg(F.count("*").alias("n_places"), F.min(F.struct("id", "pos")).alias("first"))
    first = blocks.join(counts, _KEY).select(F.col("first.id").alias("id"), F.col("first.pos").alias("pos"),
                                             "length", "n_docs", "n_places")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    block = F.array_join(F.slice(_lines(F.col("_text")), F.col("pos") + 1, F.col("length")), "\n")
    return first.join(texts, "id").select(block.alias("block"), F.col("length").alias("n_lines"), "n_docs", "n_places")


def strip_blocks(docs: DataFrame, places: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_removed, clean_text): the documents without the lines of ``places``.

    Blank lines within a block go with it; a null text stays null.  One join by id, then one projection."""
    spans = places.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "length"))).alias("_spans"))
    lines = F.split(F.col(text_col), "\n", -1)
    full = F.filter(F.transform("_lines", lambda x, i: F.when(T.py_strip(x) != "", i)), lambda i: i.isNotNull())

    def step(acc, span):
        begin, end = F.get("_full", span["pos"]), F.get("_full", span["pos"] + span["length"] - 1)
        kept = F.slice("_lines", acc["pos"] + 1, F.greatest(begin - acc["pos"], F.lit(0)))
        return F.struct(F.greatest(acc["pos"], end + 1).alias("pos"), F.concat(acc["out"], F.array(kept)).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<array<string>>").alias("out"))
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col)).join(spans, "_id", "left")
    cut = joined.withColumn("_lines", lines).withColumn("_full", full).withColumn(
        "_acc", F.aggregate("_spans", start, step))
    kept = F.flatten(F.concat("_acc.out", F.array(F.slice("_lines", F.col("_acc.pos") + 1, F.size("_lines")))))
    cut = cut.withColumn("_kept", F.when(F.col("_spans").isNotNull(), kept))
    return cut.select(F.col("_id").alias(id_col),
                      F.when(F.col("_kept").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept")).alias("n_removed"),
                      F.when(F.col("_kept").isNull(), F.col(text_col)).otherwise(F.array_join("_kept", "\n")).alias("clean_text"))
