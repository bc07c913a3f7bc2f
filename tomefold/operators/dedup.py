"""Duplicates and repeated blocks (roadmap D1-D3).

Skew: one text may be copied into a third of the corpus.  Group sizes and
representatives come from partial (map-side) aggregation, never from
collecting a group; near-duplicate candidates are star edges to the smallest
member of an LSH bucket, never all pairs of the bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from .. import constants as C
from ..functions import text as T
from ..session import ensure_checkpoint_dir, written
from .prefix_join import named_in, similar_across


def normalise(text) -> Column:
    """Lower-case, whitespace runs -> one space, stripped."""
    return F.lower(T.py_strip(F.regexp_replace(T._c(text), "(?U)" + C.JAVA_WS_CLASS + "+", " ")))


# --------------------------------------------------------------------------- D1
def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its duplicate group: size, kept id (smallest id)."""
    d = docs.select(id_col, F.sha2(normalise(text_col), 256).alias("text_hash"))
    groups = d.groupBy("text_hash").agg(F.min(id_col).alias("keep_id"), F.count("*").alias("group_size"))
    j = d.join(groups, "text_hash")
    return j.select(id_col, "text_hash", "group_size", "keep_id",
                    (F.col(id_col) == F.col("keep_id")).alias("keep"))


# --------------------------------------------------------------------------- D2
MINHASH_PRIME = (1 << 31) - 1  # keeps a * x + b inside uint64
FEW_ROWS = 1_000_000           # rows of one number that may be broadcast (8 MB)
MINHASH_CELLS = 1 << 24        # hash values x permutations held at once (128 MB)


_SHINGLE_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(1))


def _signature_udf(num_perm: int, seed: int, k: int):
    """Word hashes -> (distinct shingle hashes, MinHash signature), per row.

    A shingle hash combines ``k`` consecutive word hashes (uint64 arithmetic);
    a text with fewer than ``k`` words is one shingle.  Vectorised over the
    Arrow batch in slices of about ``MINHASH_CELLS`` values x permutations.
    """
    rng = np.random.default_rng(seed)
    a = rng.integers(1, MINHASH_PRIME, size=num_perm, dtype=np.uint64)
    b = rng.integers(0, MINHASH_PRIME, size=num_perm, dtype=np.uint64)
    p = np.uint64(MINHASH_PRIME)
    mult = [np.uint64(int(_SHINGLE_MULT[j % 3]) * (j + 1) % (1 << 64)) for j in range(k)]
    schema = TY.StructType([TY.StructField("sh", TY.ArrayType(TY.LongType())),
                            TY.StructField("mh", TY.ArrayType(TY.LongType()))])

    @F.pandas_udf(schema)
    def signature(word_hashes: pd.Series) -> pd.DataFrame:
        arr = pa.array(word_hashes, type=pa.list_(pa.int64()))
        offs = arr.offsets.to_numpy()
        words = arr.values.to_numpy(zero_copy_only=False).view(np.uint64)
        shingles = []
        with np.errstate(over="ignore"):
            for r in range(len(offs) - 1):
                w = words[offs[r]:offs[r + 1]]
                if len(w) == 0:
                    shingles.append(np.empty(0, np.uint64))
                    continue
                m = max(1, len(w) - k + 1)
                h = np.zeros(m, np.uint64)
                for j in range(min(k, len(w))):
                    h = h + w[j:j + m] * mult[j]
                shingles.append(np.unique(h))
        lengths = np.array([len(x) for x in shingles], dtype=np.int64)
        mh = np.zeros((len(shingles), num_perm), dtype=np.int64)
        start = 0
        while start < len(shingles):
            stop, cells = start, 0
            while stop < len(shingles) and (stop == start or cells + lengths[stop] * num_perm <= MINHASH_CELLS):
                cells += lengths[stop] * num_perm
                stop += 1
            rows = np.arange(start, stop)
            rows = rows[lengths[rows] > 0]
            if len(rows):
                vals = np.concatenate([shingles[r] for r in rows]) % p
                starts = np.concatenate([[0], np.cumsum(lengths[rows])[:-1]])
                hv = (np.multiply.outer(a, vals) + b[:, None]) % p
                mh[rows] = np.minimum.reduceat(hv, starts, axis=1).T.astype(np.int64)
            start = stop
        return pd.DataFrame({
            "sh": [x.view(np.int64) if len(x) else None for x in shingles],
            "mh": [row if n else None for row, n in zip(mh, lengths)]})
    return signature.asNondeterministic()  # never duplicated into pushed-down filters


def word_hashes(text) -> Column:
    """xxhash64 of each lower-cased letter/digit word, in text order."""
    return F.transform(F.regexp_extract_all(F.lower(T._c(text)), F.lit(r"[\p{L}\p{N}]+"), 0),
                       lambda w: F.xxhash64(w))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    bands: int = 16, rows: int = 4, threshold: float = 0.7, k: int = 3,
                    seed: int = 7, max_iter: int = 200) -> DataFrame:
    """Near-duplicate components: the connected components of all pairs of documents whose sets
    of ``k``-word shingles have a Jaccard similarity of at least ``threshold``.

    Documents with equal sets are one set.  A MinHash pass connects families cheaply (star edges
    to the smallest member of a bucket, checked exactly); a prefix join then finds every pair left
    between different families, so no link is lost whatever the hashing missed.

    Returns ``(id, component, component_size)`` for documents in a component
    of size >= 2.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda bi: F.xxhash64(F.slice("mh", bi * rows + 1, rows)))
    sig = written(docs.select(F.col(id_col).alias("id"), _signature_udf(bands * rows, seed, k)(word_hashes(text_col)).alias("s"))
                  .select("id", "s.sh", "s.mh").filter(F.col("mh").isNotNull())
                  .select("id", "sh", keys.alias("keys"), F.xxhash64("sh").alias("name"),  # shingles come in ascending order
                          F.monotonically_increasing_id().alias("place")), "near-sets")
    first = sig.groupBy("name").agg(F.min("id").alias("rep"))
    copies = sig.select("id", "name").join(first, "name").filter(F.col("id") != F.col("rep")).select("id", "rep")
    # one row per rep, chosen among narrow rows: the sets themselves move once
    chosen = (sig.select("id", "name", "place").join(first.select(F.col("name").alias("_name"), "rep"),
                                                     (F.col("id") == F.col("rep")) & (F.col("name") == F.col("_name")))
              .groupBy("id").agg(F.min("place").alias("place")).select("place"))
    others = written(sig.select("place").join(chosen, "place", "left_anti"), "near-others")
    few = others.count() <= FEW_ROWS
    sets = sig.join(F.broadcast(others) if few else others, "place", "left_anti").select("id", "sh", "keys")
    sets = sets if few else written(sets, "near-reps")
    bucket = sets.select("id", F.posexplode("keys").alias("band", "bkey"))
    # star edges: every bucket member to the bucket's smallest id (partial aggregation)
    reps = bucket.groupBy("band", "bkey").agg(F.min("id").alias("rep"))
    edges = written(bucket.join(reps, ["band", "bkey"]).filter(F.col("id") != F.col("rep"))
                    .select("id", "rep").distinct(), "near-candidates")
    # exact Jaccard on the candidate edges only
    some = named_in(sets, edges, "id", "rep")
    s1 = some.select(F.col("id"), F.col("sh").alias("sh1"))
    s2 = some.select(F.col("id").alias("rep"), F.col("sh").alias("sh2"))
    ver = written(edges.join(s1, "id").join(s2, "rep")
                  .filter(F.size(F.array_intersect("sh1", "sh2")) / F.size(F.array_union("sh1", "sh2")) >= threshold)
                  .select("id", "rep"), "near-edges")
    families = written(connected_components(_both_ways(ver), max_iter), "near-families")
    more = similar_across(sets.select("id", "sh"), families, threshold).select(F.col("a").alias("id"), F.col("b").alias("rep"))
    every = written(ver.unionByName(more).unionByName(copies), "near-edges")
    labels = connected_components(_both_ways(every), max_iter)
    sizes = labels.groupBy("label").agg(F.count("*").alias("component_size"))
    return (labels.join(sizes, "label")
            .select(F.col("id").alias(id_col), F.col("label").alias("component"), "component_size"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("id").alias("src"), F.col("rep").alias("dst")).union(edges.select("rep", "id"))


def connected_components(edges: DataFrame, max_iter: int = 200) -> DataFrame:
    """``edges(src, dst)`` (both directions present) -> ``(id, label)`` with the
    smallest id of each connected component as label."""
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.checkpoint()  # read by every round
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    # min-label propagation with pointer jumping (a node takes its label's label),
    # run to convergence: rounds grow with log(diameter), never stopped early
    for _round in range(max_iter):
        nbr = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(
            F.min("label").alias("nl"))
        step = (labels.join(nbr.withColumnRenamed("src", "id"), "id", "left")
                .select("id", F.least("label", F.coalesce("nl", "label")).alias("label")))
        parent = step.select(F.col("id").alias("label"), F.col("label").alias("pl"))
        new = (step.join(parent, "label", "left")
               .select("id", F.least("label", F.coalesce("pl", "label")).alias("label")))
        new = new.checkpoint()  # reliable storage: cuts the growing lineage
        changed = new.join(labels.withColumnRenamed("label", "old"), "id").filter(
            F.col("label") != F.col("old")).limit(1).count()
        labels = new
        if changed == 0:
            break
    else:
        raise RuntimeError(f"connected components did not converge in {max_iter} rounds")
    return labels


# --------------------------------------------------------------------------- D3
def line_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stripped non-blank line -> number of documents it occurs in."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("norm", T.py_strip("line")).filter(F.col("norm") != "")
    return lines.groupBy("norm").agg(F.countDistinct(id_col).alias("n_docs"))


def boilerplate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      share: float = 0.01, min_docs: int = 3) -> DataFrame:
    """Lines (stripped) that occur in at least ``max(min_docs, share * N)`` documents.

    At most ``total_lines / (share * N)`` lines can qualify, i.e. the average
    line count per document divided by ``share``: a bounded set.
    """
    n = docs.count()
    cut = max(min_docs, int(np.ceil(share * n)))
    return line_frequencies(docs, id_col, text_col).filter(F.col("n_docs") >= cut)


def strip_boilerplate(docs: DataFrame, bp: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Remove boilerplate lines and rebuild each document in line order.

    Blank lines, the most frequent of all, never take part in the join; the engine
    chooses it by the measured size of the boilerplate set."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("_norm", T.py_strip(F.col("line")))
    bp_lines = bp.select(F.col("norm").alias("_bp"))
    kept = lines.filter(F.col("_norm") == "").unionByName(
        lines.filter(F.col("_norm") != "").join(bp_lines, F.col("_norm") == F.col("_bp"), "left_anti")).drop("_norm")
    rebuilt = kept.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]),
                     "\n").alias("clean_text"),
        F.count("*").alias("n_kept"))
    base = docs.select(id_col, F.size(F.split(text_col, "\n", -1)).alias("n_lines"))
    return (base.join(rebuilt, id_col, "left")
            .select(id_col, "n_lines", F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
                    F.coalesce("clean_text", F.lit("")).alias("clean_text")))
