"""Operator 10: token ids in a directly addressable file format.

Method: directly addressable variable-length codes.  Every id is split into 8-bit chunks,
the lowest first.  Level 0 holds the lowest chunk of every id; a bitmap beside it says
which ids go on, and level 1 holds the second chunk of just those, and so on.  A rank
directory counts the set bits before each block of 512, so the place of an id's next chunk
is one directory entry plus at most 64 bytes of popcount: ``token_at`` reads any token
without decoding its neighbours.

A store is a Parquet folder; each row is a shard of consecutive documents of one writing
task: ``part`` (ordinal of the task, in document order), ``seq``, ``first`` (ids of the
part before the shard), ``n_tokens``, ``doc_ids``, ``doc_lengths`` and ``levels`` (an array
of ``chunks``, ``more`` and ``ranks`` blobs).  Documents are never split, so a shard is
bounded by ``shard_tokens`` plus one document.

Scale: one range shuffle of (doc_id, text); encoding, writing and reading back are narrow.
The only broadcast is the table of part offsets, one row per writing task.

Defined cases: null text encodes as the empty text (only the end id); null doc_ids come
last; rows with equal doc_id are ordered by text; repeated rows are all stored; an empty
table gives an empty store; other columns of ``docs`` are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomefold.llm.common import prepare
from tomefold.llm.tokens import encoder

CHUNK_BITS = 8
RANK_BLOCK = 512
SHARD_TOKENS = 1 << 18

_LEVEL = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
_SHARD = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())),
                    ("levels", pa.list_(_LEVEL))])
_SHARD_DDL = ("part long, seq long, first long, n_tokens long, doc_ids array<long>, doc_lengths array<long>, "
              "levels array<struct<chunks: binary, more: binary, ranks: binary>>")


def encode_levels(ids: np.ndarray) -> list[dict]:
    """The chunk levels of an array of ids."""
    rest, levels = ids.astype(np.uint32), []
    while len(rest):
        high = rest >> CHUNK_BITS
        more = high > 0
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.int64)
        ranks = np.concatenate(([0], np.cumsum(counts)[:-1]))
        levels.append({"chunks": (rest & 0xFF).astype(np.uint8).tobytes(),
                       "more": np.packbits(more, bitorder="little").tobytes(),
                       "ranks": ranks.astype("<u4").tobytes()})
        rest = high[more]
    return levels


def decode_levels(levels: list[dict], n: int) -> np.ndarray:
    """All ``n`` ids of a shard."""
    ids, at = np.zeros(n, dtype="<u4"), np.arange(n)
    for k, level in enumerate(levels):
        ids[at] |= np.frombuffer(level["chunks"], np.uint8).astype(np.uint32) << np.uint32(CHUNK_BITS * k)
        more = np.unpackbits(np.frombuffer(level["more"], np.uint8), bitorder="little", count=len(at))
        at = at[more.astype(bool)]
    return ids


def token_at(levels: list[dict], i: int) -> int:
    """The ``i``-th id of a shard, reading one chunk, one bit and one rank per level."""
    value = 0
    for k, level in enumerate(levels):
        value |= level["chunks"][i] << (CHUNK_BITS * k)
        if not level["more"][i >> 3] >> (i & 7) & 1:
            break
        block = i // RANK_BLOCK
        lead = int.from_bytes(level["more"][block * RANK_BLOCK // 8:(i >> 3) + 1], "little")
        below = lead & ((1 << (i - block * RANK_BLOCK)) - 1)
        i = int(np.frombuffer(level["ranks"], "<u4", 1, 4 * block)[0]) + below.bit_count()
    return value


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, blanks: bool,
                shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and write a store at ``path``."""
    prepare(docs.sparkSession)
    end = np.asarray([end_id], "<u4").tobytes()

    def encode(batches):
        enc, part = encoder(tokenizer, blanks), TaskContext.get().partitionId()
        seq = first = tokens = 0
        doc_ids, lengths, data = [], [], []

        def shard():
            ids = np.frombuffer(b"".join(data), "<u4")
            row = {"part": part, "seq": seq, "first": first, "n_tokens": tokens, "doc_ids": doc_ids,
                   "doc_lengths": lengths, "levels": encode_levels(ids)}
            return pa.RecordBatch.from_pylist([row], schema=_SHARD)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.ids(batch.column(1).to_pylist())):
                ids += end
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                data.append(ids)
                tokens += lengths[-1]
                if tokens >= shard_tokens:
                    yield shard()
                    seq, first, tokens = seq + 1, first + tokens, 0
                    doc_ids, lengths, data = [], [], []
        if doc_ids:
            yield shard()

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange(F.col("doc_id").asc_nulls_last())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text"))
    ordered.mapInArrow(encode, _SHARD_DDL).write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Shards with ``start``, the ids of the whole store before each."""
    shards = spark.read.schema(_SHARD_DDL).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per writing task
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return (shards.join(F.broadcast(offsets), "part")
            .withColumn("start", F.col("part_start") + F.col("first")).drop("part_start"))


def document_digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_levels(row["levels"], row["n_tokens"]).tobytes()
                ends = np.cumsum([0] + row["doc_lengths"])
                crcs = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(ends[:-1] + row["start"], pa.int64()),
                     pa.array(row["doc_lengths"], pa.int64()), pa.array(crcs, pa.int64())], schema=out)

    cols = ["n_tokens", "doc_ids", "doc_lengths", "levels", "start"]
    return shards.select(*cols).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
