"""Embedding.

Default embedder: a deterministic hashed bag of words (there is no network).
Tokens are found natively in the JVM; over slices of the Arrow batch each different
token is hashed once and the per-row bucket counting is a vectorised ``np.bincount``.
The vector holds signed integer counts (not normalised): cosine similarity
divides by the norms, and integer inputs make every engine agree bit for bit.

Any other embedder (a remote service) plugs in through ``embed_with``: texts
go out in fixed-size batches from an iterator pandas UDF, with retry and
backoff on rate limits; a batch that fails otherwise is retried text by text,
and a text that still fails yields a NULL vector plus an error text instead of
failing the job.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from .. import constants as C

# fixed value: token pattern of the hashed embedder
HASH_TOKEN_PATTERN = r"[\p{L}\p{N}]+"
HASHES_AT_ONCE = 1 << 18  # hashes counted in one go


def tokens(text) -> Column:
    """The lower-cased letter/digit tokens."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(HASH_TOKEN_PATTERN), 0)


def token_hashes(text) -> Column:
    """First 32 bits of md5 of each lower-cased letter/digit token, as BIGINT."""
    return F.transform(tokens(text), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"))


def _bincount_factory(dim: int):
    @F.arrow_udf(TY.ArrayType(TY.FloatType()))
    def signed_counts(words: pa.Array) -> pa.Array:
        return _sliced_counts(words, dim)
    # marked non-deterministic only so that Catalyst never copies the call into a
    # pushed-down filter (which would run the Python worker twice per row)
    return signed_counts.asNondeterministic()


def _sliced_counts(hashes: pa.Array, dim: int) -> pa.Array:
    """The vectors of an Arrow batch of tokens or their hashes, made of rows with about ``HASHES_AT_ONCE`` at a time (one row at least)."""
    parts, lo = [], 0
    ends = np.cumsum(pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False))
    while lo < len(hashes):
        begin = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, begin + HASHES_AT_ONCE, side="right")))
        parts.append(_signed_counts(hashes.slice(lo, hi - lo), dim))
        lo = hi
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))


def _signed_counts(hashes: pa.Array, dim: int) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(hashes)
    values = values.to_numpy(zero_copy_only=False) if pa.types.is_integer(values.type) else _word_hashes(values)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    sign = np.where((values // dim) % 2 == 0, 1.0, -1.0)
    counts = np.bincount(rows * dim + values % dim, weights=sign, minlength=len(lengths) * dim).astype(np.float32)
    offsets = np.arange(len(lengths) + 1, dtype=np.int32) * dim
    return pa.ListArray.from_arrays(offsets, pa.array(counts), mask=pa.array(lengths == 0))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """``token_hashes`` of an Arrow array of tokens; each different one is hashed once."""
    coded = words.cast(pa.binary()).dictionary_encode()
    digests = b"".join(hashlib.md5(w, usedforsecurity=False).digest()[:4] for w in coded.dictionary.to_pylist())
    return np.frombuffer(digests, ">u4").astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]


_UDFS: dict[int, object] = {}


def hashed_vector(text, dim: int = C.EMBED_DIM) -> Column:
    """Signed hashed bag-of-words vector; NULL when the text has no token."""
    if dim not in _UDFS:
        _UDFS[dim] = _bincount_factory(dim)
    return _UDFS[dim](tokens(text))


def embed_hashed(df: DataFrame, text_col: str = "content", out_col: str = "vector",
                 dim: int = C.EMBED_DIM) -> DataFrame:
    return df.withColumn(out_col, hashed_vector(text_col, dim))


# --------------------------------------------------------------------------- pluggable embedders
def _is_retryable(err: Exception) -> bool:
    msg = str(err).lower()
    return any(m in msg for m in C.RETRYABLE_MARKERS)


def call_with_retry(fn: Callable[[list[str]], list[list[float]]], texts: list[str],
                    max_retries: int = C.MAX_RETRIES, base_delay: float = C.BASE_DELAY_S,
                    batch_delay: float = C.BATCH_DELAY_S, sleep=time.sleep):
    """Retry only on rate limits, with exponential backoff and jitter."""
    waits = iter([base_delay * 2 ** k for k in range(max_retries - 1)])  # one before each repeat
    if len(texts) > 1:
        sleep(batch_delay)  # keeps a stream of batches under the service's rate (E3)
    while True:
        try:
            return fn(texts)
        except Exception as err:
            wait = next(waits, None) if _is_retryable(err) else None
            if wait is None:
                raise
        sleep(wait + random.uniform(0, 1))


def _checked(got, part):
    """Vectors of one request as floats; a reply of another length belongs to no text."""
    if len(got) != len(part):
        raise ValueError(f"the embedder returned {len(got)} vectors for {len(part)} texts")
    return [list(map(float, g)) for g in got]


def embed_with(df: DataFrame, embedder: Callable[[list[str]], list[list[float]]],
               text_col: str = "content", out_col: str = "vector", batch_size: int = 64,
               **retry) -> DataFrame:
    """Embed ``text_col`` with any batch embedder.

    Adds ``out_col`` (ARRAY<FLOAT>, NULL on failure) and ``embed_error``.
    The request rate is bounded by ``batch_size`` times the number of
    concurrently running partitions; ``coalesce`` before this to lower it.
    A batch that fails for another reason than a rate limit is retried text by
    text, so only the texts that really fail become error rows.
    """
    schema = TY.StructType([TY.StructField("v", TY.ArrayType(TY.FloatType())),
                            TY.StructField("err", TY.StringType())])

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            vecs, errs = [], []
            for i in range(0, len(texts), batch_size):
                part = [("" if t is None else t) for t in texts.iloc[i:i + batch_size]]
                try:
                    got = _checked(call_with_retry(embedder, part, **retry), part)
                    vecs.extend(got)
                    errs.extend([None] * len(part))
                except Exception as err:  # isolate the failing texts, one request each
                    if len(part) == 1:
                        vecs.append(None)
                        errs.append(str(err))
                        continue
                    for t in part:
                        try:
                            vecs.extend(_checked(call_with_retry(embedder, [t], **retry), [t]))
                            errs.append(None)
                        except Exception as one_err:  # this text becomes an error row
                            vecs.append(None)
                            errs.append(str(one_err))
            yield pd.DataFrame({"v": vecs, "err": errs})

    # non-deterministic: a filter on the result must not send every text twice
    out = df.withColumn("_emb", run.asNondeterministic()(F.col(text_col)))
    return out.withColumn(out_col, F.col("_emb.v")).withColumn("embed_error", F.col("_emb.err")).drop("_emb")
