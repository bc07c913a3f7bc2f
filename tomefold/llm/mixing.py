"""Operator 1: mixing sources to target weights.

Method: Efraimidis-Spirakis sampling.  Every document draws the exponential key
``-ln(u) / weight`` with a repeatable ``u`` and a quality weight from its text; inside a
source, documents with the smallest keys come first.  A source's target is a number of
words: each complete epoch takes all its documents, and the rest of the target is filled
by the prefix of documents in key order whose running sum stays inside it; the document at
the end of the prefix gives just the words that are missing.

Scale: DataFrame functions only.  A source is never gathered: its key range is cut into
buckets of about ``BUCKET_DOCS`` documents, the running sum over bucket totals finds the
bucket in which the target ends, and only that bucket is sorted.  The outcome per source is
one row (epochs, the key at which the prefix ends and the words taken there); joined to the
documents it decides each row by itself.  Sources are ranked by a range-partitioned running
count, so their number is not bound to one task either.

Defined cases: null text has size 0 and takes nothing; a null source is a source, ranked
last; null doc_ids order last among equal keys; repeated rows have equal keys, and share
evenly what is left when the prefix ends among them; an empty table gives an empty result;
other columns of ``docs`` pass through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomefold.llm.common import SPACE, let, stored, unit_hash, words

SHARES = (5, 2, 1)
TOTAL = 1.5
MOST_EPOCHS = 2
BUCKET_DOCS = 2048
SEED = 20240229


def drawn(doc_id: Column, source: Column, text: Column) -> Column:
    """Struct (size, weight, source_key, place) of a document; ``place`` is its order in the source.

    The weight prefers varied words: twice the share of distinct words, between 0.05 and 1.
    """
    source_key = F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source.cast("string"), F.lit("")))
    key = -F.log(unit_hash(doc_id, source, F.coalesce(text, F.lit("")), F.lit(SEED)))
    measured = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("size"), F.least(F.lit(1.0), F.greatest(
        F.lit(0.05), 2.0 * F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)))).alias("weight")))
    return let(measured, lambda m: F.struct(
        m["size"].alias("size"), m["weight"].alias("weight"), source_key.alias("source_key"),
        F.struct((key / m["weight"]).alias("key"), doc_id.isNull().alias("no_id"),
                 F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), m["size"].alias("size")).alias("place")))


def targets(sources: DataFrame) -> DataFrame:
    """Add ``target`` to (source_key, source_size): shares by rank, held at the most epochs."""
    spread = stored(sources.repartitionByRange("source_key").withColumn("_part", F.spark_partition_id()), "mix-sources")
    per_part = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = per_part.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("source_key")) - 1 + F.col("_before")
    share = F.element_at(F.array(*[F.lit(float(x)) for x in SHARES]), (rank % len(SHARES) + 1).cast("int"))
    ranked = stored(spread.join(F.broadcast(starts), "_part").withColumn("_share", share), "mix-ranked")

    held, level = F.lit(False), 0.0
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    while True:  # reshare what held sources cannot take until none is above its most
        sums = ranked.agg(F.sum(F.when(held, F.col("source_size")).otherwise(0)).alias("full"),
                          F.sum(F.when(held, 0.0).otherwise(F.col("_share"))).alias("shares")).first()
        if not sums["shares"]:
            break
        level = max(level, (TOTAL * total - MOST_EPOCHS * sums["full"]) / sums["shares"])
        above = F.lit(level) * F.col("_share") > MOST_EPOCHS * F.col("source_size")
        if not ranked.where(above & ~held).limit(1).count():
            break
        held = above
    most = (MOST_EPOCHS * F.col("source_size")).cast("double")
    return ranked.withColumn("target", F.when(held, most).otherwise(F.least(most, F.lit(level) * F.col("_share")))) \
        .select("source_key", "source_size", "target")


def plan(rows: DataFrame) -> DataFrame:
    """One row per source: source_size, target, epochs and where the last prefix ends.

    ``rows`` has the fields of ``_mix`` as columns and is read more than once.
    """
    sources = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"),
                                             F.avg("weight").alias("_mean"))
    aimed = targets(sources.select("source_key", "source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aimed = aimed.withColumn("epochs", epochs).withColumn(
        "rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    aimed = stored(aimed.join(sources.select("source_key", "_docs", "_mean"), "source_key"), "mix-targets")

    n_buckets = F.greatest(F.lit(1), F.floor(F.col("_docs") / BUCKET_DOCS))
    bucket = F.least(n_buckets - 1, F.floor(n_buckets * (1 - F.exp(-F.col("place.key") * F.col("_mean")))))
    dealt = rows.join(aimed, "source_key").withColumn("bucket", bucket.cast("long"))
    totals = dealt.groupBy("source_key", "bucket").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    before = F.sum("n").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("n")
    ends = (totals.withColumn("before", before)
            .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
            .select("source_key", "bucket", "before"))  # the bucket in which the prefix ends

    last = dealt.join(ends, ["source_key", "bucket"]).groupBy("source_key", "place").agg(
        F.sum("size").alias("n"), F.count("*").alias("copies"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    run = F.col("before") + F.sum("n").over(Window.partitionBy("source_key").orderBy("place")) - F.col("n")
    cut = (last.withColumn("run", run)
           .where((F.col("run") <= F.col("rest")) & (F.col("rest") < F.col("run") + F.col("n")))
           .select("source_key", F.col("place").alias("cut"),
                   F.floor((F.col("rest") - F.col("run")) / F.col("copies")).cast("long").alias("cut_words")))
    return stored(aimed.select("source_key", "source_size", "target", "epochs").join(cut, "source_key", "left"), "mix-plan")


def _prefix_words(mix: Column) -> Column:
    """Words that the fractional epoch takes of a document."""
    place = mix["place"]
    return (F.when(F.col("cut").isNull(), 0).when(place < F.col("cut"), mix["size"])
            .when(place == F.col("cut"), F.col("cut_words")).otherwise(0)).cast("long")


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, epochs) of every document."""
    mix_ = drawn(F.col("doc_id"), F.col("source"), F.col("text")).alias("m")
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), mix_).select("doc_id", "m.*"), "mix-rows")
    row = F.struct("size", "place")
    return rows.join(plan(rows), "source_key").select(
        "doc_id", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + _prefix_words(row)).alias("taken"), "epochs")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with the columns of ``docs``.

    The one document at which a source's prefix ends is cut after its last word taken.
    """
    names = {c: f"_{i}_{c}" for i, c in enumerate(docs.columns)}  # no clash with the columns of the plan
    wide = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    text = F.col(names["text"])
    wide = wide.withColumn("m", drawn(F.col(names["doc_id"]), F.col(names["source"]), text))
    planned = plan(stored(wide.select("m.*"), "mix-rows"))
    joined = (wide.withColumn("source_key", F.col("m.source_key")).join(planned, "source_key")
              .withColumn("prefix", _prefix_words(F.col("m"))))
    pieces = F.split(text, f"(?<=[^{SPACE}])(?=[{SPACE}])")  # a word with the space before it
    part = F.when(F.col("prefix") < F.col("m.size"),
                  F.array_join(F.slice(pieces, F.lit(1), F.col("prefix").cast("int")), "")).otherwise(text)
    copies = F.array_repeat(text, F.col("epochs").cast("int"))
    copies = F.when(F.col("prefix") > 0, F.concat(copies, F.array(part))).otherwise(copies)
    taken = joined.where((F.col("epochs") > 0) & (F.col("m.size") > 0) | (F.col("prefix") > 0))
    out = taken.withColumn("taken_text", F.explode(copies))
    new = {"text": F.col("taken_text")} | ({"n_chars": F.length("taken_text").cast("long")} if "n_chars" in names else {})
    return out.select(*[new.get(c, F.col(f"`{n}`")).alias(c) for c, n in names.items()])
