"""Document classification from text and structure (roadmap D8) with pyspark.ml.

Training and scoring are distributed pyspark.ml stages; the training set is the
labelled subset, every document is scored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _structure(df: DataFrame, text_col: str) -> DataFrame:
    t = F.col(text_col)
    return df.select("*",
                     F.log1p(T.token_count(t)).alias("f_tokens"),
                     F.log1p(F.size(F.split(t, "\n", -1))).alias("f_lines"),
                     T.has_code(t).cast("double").alias("f_code"),
                     F.size(T.heading_list(t)).cast("double").alias("f_headings"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", num_features: int = 1 << 16, seed: int = 1) -> DataFrame:
    """``(id, prediction, p_positive)`` for every document."""
    feats = _structure(docs, text_col)
    train = feats.join(labels.select(id_col, F.col(label_col).cast("double").alias("label")), id_col)
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="tfidf"),
        VectorAssembler(inputCols=["tfidf", "f_tokens", "f_lines", "f_code", "f_headings"], outputCol="features"),
        LogisticRegression(maxIter=50, regParam=0.01, featuresCol="features", labelCol="label"),
    ])
    model = pipe.fit(train)
    scored = model.transform(feats)
    return scored.select(id_col, F.col("prediction").cast("int").alias("prediction"),
                         F.round(vector_to_array("probability")[1], 6).alias("p_positive"))
