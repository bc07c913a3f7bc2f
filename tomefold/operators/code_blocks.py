"""Code examples as their own rows, linked to their chunk (roadmap D4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: fenced block and inline span patterns (Java regex)
FENCE_PATTERN = r"(?s)```([^\n`]*)\n(.*?)```"
INLINE_PATTERN = r"`([^`\n]+)`"


def code_blocks(chunks: DataFrame) -> DataFrame:
    """One row per fenced block: chunk key, block index, language tag, code."""
    langs = F.regexp_extract_all("raw_chunk", F.lit(FENCE_PATTERN), 1)
    codes = F.regexp_extract_all("raw_chunk", F.lit(FENCE_PATTERN), 2)
    z = chunks.select("version", "chunk_id", "file_path",
                      F.posexplode(F.arrays_zip(langs.alias("lang"), codes.alias("code"))).alias("block_idx", "b"))
    return z.select("version", "chunk_id", "file_path", "block_idx",
                    F.lower(F.trim("b.lang")).alias("lang"), F.col("b.code").alias("code"))


def inline_code(chunks: DataFrame) -> DataFrame:
    """One row per inline code span."""
    spans = F.regexp_extract_all("raw_chunk", F.lit(INLINE_PATTERN), 1)
    return chunks.select("version", "chunk_id", F.posexplode(spans).alias("span_idx", "code"))
