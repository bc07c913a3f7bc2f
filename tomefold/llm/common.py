"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomefold.session import ensure_checkpoint_dir, ship_package

# What separates words (space, tab, newline, vertical tab, form feed, return).
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def prepare(spark: SparkSession) -> str:
    """Make the package importable in the workers; the shared folder for written tables."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint but computes the rows only once, keeps
    them columnar (later reads prune columns) and tells the planner their true size.
    """
    spark = df.sparkSession
    path = f"{prepare(spark)}/tomefold-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of ``text`` as an array; empty for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (a lambda variable, not a copied expression)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_hash(*cols: Column) -> Column:
    """A repeatable number strictly between 0 and 1 from the hash of ``cols``."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 3 is 1 (null ids count as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


SPAN_BLOCK = 256


def matches(text: Column, pattern: str, group: int | None = None, keep=None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` in ``text`` as structs (start, end, m[, g]).

    Places are in code points, ``end`` exclusive; ``g`` is the text of ``group``;
    only matches with ``keep(m)`` are returned, if given.  The gaps
    between matches are the pieces of a split by the same pattern.  Running sums go in
    blocks, so a text with very many matches costs no quadratic copying.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    extra = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def parts(pieces, groups):
        return F.transform(found, lambda m, i: F.struct(
            F.length(F.get(pieces, i)).cast("long").alias("gap"), F.length(m).cast("long").alias("len"),
            m.alias("m"), F.get(groups, i).alias("g")))

    def placed(block, begin):
        def step(acc, x):
            at = acc["pos"] + x["gap"]
            item = F.struct(at.alias("start"), (at + x["len"]).alias("end"), x["m"].alias("m"), x["g"].alias("g"))
            out = F.concat(acc["out"], F.array(item))
            out = F.when(keep(x["m"]), out).otherwise(acc["out"]) if keep else out
            return F.struct((at + x["len"]).alias("pos"), out.alias("out"))
        none = F.array().cast("array<struct<start: bigint, end: bigint, m: string, g: string>>")
        return F.aggregate(block, F.struct(begin.alias("pos"), none.alias("out")), step)["out"]

    def located(all_parts):
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(all_parts) / SPAN_BLOCK).cast("int") - 1),
                             lambda b: F.slice(all_parts, b * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK)))
        return let(blocks, lambda bs: let(
            F.aggregate(F.transform(bs, lambda block: F.aggregate(block, F.lit(0).cast("long"),
                                                                  lambda a, x: a + x["gap"] + x["len"])),
                        F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))),
            lambda begins: F.flatten(F.transform(bs, lambda block, b: placed(block, F.get(begins, b))))))

    none = F.array().cast("array<struct<start: bigint, end: bigint, m: string, g: string>>")
    spans = let(F.split(text, pattern), lambda pieces: let(extra, lambda groups: let(parts(pieces, groups), located)))
    return F.when(F.size(found) == 0, none).otherwise(spans)


def labelled(found: Column, order: int, kind: str) -> Column:
    """Spans as structs (start, order, end, kind), which sort by start, then kind as listed."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"),
                                                 x["end"].alias("end"), F.lit(kind).alias("kind")))


SPAN_TYPE = "array<struct<start: bigint, order: int, end: bigint, kind: string>>"


def spelled(spans: Column) -> Column:
    """``kind:start:end`` items of sorted spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
