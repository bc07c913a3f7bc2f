"""Exact set-similarity join by prefixes of globally ordered tokens.

Tokens are ordered by the number of sets that hold them, rarest first.  Two sets of sizes m and n with a
Jaccard similarity of at least t share one of the first ``n - ceil(t * n) + 1`` tokens of each, so
only sets that share such a token are compared; sizes (``least >= t * greatest``) and the
places of the shared token rule out more of them before the sets themselves are joined.

``labels`` names sets that are known to be connected (say, by a hashing pass): pairs with one
label are not compared, and a token all of whose sets have one label is left out before pairs are formed.
A family of thousands of alike sets thus costs no pairs, and the result still misses no link
between two labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, token, pos) of the prefix tokens that another set holds too; ``sets`` is (id, sh: distinct tokens)."""
    tokens = sets.select("id", F.size("sh").alias("n"), F.explode("sh").alias("token"))
    # one exchange of all tokens; those of a single set come first in its order, so only their number counts
    shared = tokens.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    ordered = shared.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    # the margin keeps a product such as 0.7 * 10 from being rounded up to 8
    length = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    alone = F.col("n") - F.size("tokens")
    return (ordered.select("id", "n", alone.alias("alone"), F.posexplode(
                F.slice("tokens", F.lit(1), F.greatest(length - alone, F.lit(0)))).alias("pos", "t"))
            .select("id", "n", F.col("t.token").alias("token"), (F.col("pos") + F.col("alone")).alias("pos")))


def named_in(sets: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The sets of written ``pairs``; most are in none and need not be moved."""
    ids = pairs.select(F.explode(F.array(a, b)).alias("id")).distinct()
    return sets.join(written(ids, "pair-ids"), "id", "left_semi")


def similar_across(sets: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of all pairs with different labels and a Jaccard similarity of at least ``threshold``.

    ``sets``: (id, sh: array of distinct tokens, not empty); ``labels``: (id, label) of the sets
    that have one, the others are a label of their own (their id).
    """
    rows = (prefixes(sets, threshold).join(labels, "id", "left")
            .select("id", "n", "token", "pos", F.coalesce("label", "id").alias("label")))
    rows = written(rows, "prefix-rows")
    mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    rows = written(rows.join(mixed, "token", "left_semi"), "prefix-mixed")
    a, b = (rows.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "pos", "label")]) for side in "ab")
    overlap = F.ceil((F.col("a_n") + F.col("b_n")) * (threshold / (1 + threshold)) - 1e-9)
    at_most = F.least("a_pos", "b_pos") + F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    pairs = (a.join(b, "token").where(F.col("a_label") < F.col("b_label"))
             .where(F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * threshold - 1e-9)
             .where(at_most >= overlap).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct())
    pairs = written(pairs, "prefix-pairs")  # the planner sees how few they are before it moves the sets
    some = named_in(sets, pairs, "a", "b")
    left, right = (some.select(F.col("id").alias(side), F.col("sh").alias(f"{side}_sh")) for side in "ab")
    shared, every = F.size(F.array_intersect("a_sh", "b_sh")), F.size(F.array_union("a_sh", "b_sh"))
    return pairs.join(left, "a").join(right, "b").where(shared / every >= threshold).select("a", "b")
