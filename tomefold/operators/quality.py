"""Quality and retrieval metrics (roadmap D6, D12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import knn as K


def chunk_quality(index: DataFrame, dim: int) -> DataFrame:
    """Per version: chunk count, token size distribution, code share, type
    counts and vector checks (D6).  Exact percentiles (linear interpolation)."""
    c = index.withColumn("n_tokens", T.token_count("content"))
    return c.groupBy("version").agg(
        F.count("*").alias("n_chunks"),
        F.avg("n_tokens").alias("avg_tokens"),
        F.percentile("n_tokens", 0.5).alias("p50_tokens"),
        F.percentile("n_tokens", 0.9).alias("p90_tokens"),
        F.max("n_tokens").alias("max_tokens"),
        F.sum(F.col("has_code").cast("int")).alias("n_code"),
        F.sum((F.col("content_type") == "tutorial").cast("int")).alias("n_tutorial"),
        F.sum((F.col("content_type") == "example").cast("int")).alias("n_example"),
        F.sum((F.col("content_type") == "api").cast("int")).alias("n_api"),
        F.sum((F.col("content_type") == "reference").cast("int")).alias("n_reference"),
        F.sum(F.when(F.col("vector").isNull(), 1).otherwise(0)).alias("n_no_vector"),
        F.sum(F.when(F.size("vector") != dim, 1).otherwise(0)).alias("n_bad_dim"),
        F.sum(F.when(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x) == 0, 1).otherwise(0))
        .alias("n_zero_vector"))


def retrieval_accuracy(vectors: DataFrame, k: int = 10, plan: str = "auto") -> DataFrame:
    """Leave-one-out retrieval over labelled vectors (D12): every vector queries
    all others; relevant = same label.  Per label: queries, precision@k, MRR@k."""
    q = vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    it = vectors.select(F.col("vec_id").cast("string").alias("item_id"), F.col("embedding").alias("vector"))
    hits = K.knn(q, it, k + 1, plan=plan).filter(F.col("item_id") != F.col("qid").cast("string"))
    w = Window.partitionBy("qid").orderBy("rank")
    hits = hits.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
    lab = vectors.select("vec_id", "label")
    j = (hits.join(lab.select(F.col("vec_id").alias("qid"), F.col("label").alias("qlabel")), "qid")
         .join(lab.select(F.col("vec_id").cast("string").alias("item_id"), F.col("label").alias("ilabel")),
               "item_id"))
    per_q = j.groupBy("qid", "qlabel").agg(
        F.sum((F.col("qlabel") == F.col("ilabel")).cast("int")).alias("rel"),
        F.min(F.when(F.col("qlabel") == F.col("ilabel"), F.col("pos"))).alias("first_rel"))
    per_q = per_q.select("qlabel", (F.col("rel") / k).alias("p_at_k"),
                         F.coalesce(1.0 / F.col("first_rel"), F.lit(0.0)).alias("rr"))
    return per_q.groupBy(F.col("qlabel").alias("label")).agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg("p_at_k"), 9).alias("precision_at_k"),
        F.round(F.avg("rr"), 9).alias("mrr"))
