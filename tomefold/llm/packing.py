"""Operator 9: best-fit packing of documents into fixed-length token sequences.

Method: bound-certified repacking.  A document's ids are cut only when longer than a
sequence (the first piece then holds the remainder).  Pieces of full length are sequences
of their own.  All others are dealt by hash into partitions of about ``PART_ITEMS`` pieces
and packed by best-fit decreasing.  Dual feasible functions give a lower bound on each
partition's sequences: a partition that meets its bound is certified and final.  From the
others, full sequences are final too; the documents of their open sequences are exchanged
(pooled, dealt anew by another hash into partitions twice as large) and packed again.  A
repacking that saves no sequence is dropped and ends the rounds.

Scale: texts never move, only one narrow row per piece does; every group has about
``PART_ITEMS`` rows, at most twice as many after each of ``ROUNDS`` exchanges, whatever the
source or length they come from.

Defined cases: null text is the empty text (one piece, the end id); null doc_ids and
repeated rows are packed like any other, one piece set per row; equal lengths are ordered
by doc_id and piece; an empty table gives an empty result; other columns of ``docs`` are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomefold.llm.common import prepare, stored
from tomefold.llm.tokens import encoder

PART_ITEMS = 2048
MIN_PARTS = 4  # unless all rows are fewer than SMALL
SMALL = 256
ROUNDS = 3

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED_DDL = _PIECES_DDL + ", sequence_id long, offset long, opens int, fill long, bins long, bound long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, blanks: bool, capacity: int) -> DataFrame:
    """One row per piece of every document: its place in the document, length and digest."""
    prepare(docs.sparkSession)
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches):
        enc = encoder(tokenizer, blanks)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.ids(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]))
                         for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES_DDL)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence number of each length.  ``lengths`` must be in descending order."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by free places
    free_sizes = 0  # bit f: some sequence has exactly f free places
    out, used = np.empty(len(lengths), dtype=np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        fits = free_sizes >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            at = room[free].pop()
            if not room[free]:
                free_sizes ^= 1 << free
        else:
            free, at, used = capacity, used, used + 1
        out[i] = at
        if free > n:
            room[free - n].append(at)
            free_sizes |= 1 << (free - n)
    return out


def lower_bound(lengths: np.ndarray, capacity: int, max_k: int = 32) -> int:
    """Sequences that any packing needs, the best of two families of dual feasible functions.

    With a threshold t, lengths above ``capacity - t`` count as a whole sequence and those
    below t as nothing; with a whole k, a length x counts ``floor((k+1)x/capacity)/k``, or
    x itself where ``(k+1)x/capacity`` is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    from_top = np.cumsum(count[::-1])[::-1]                 # pieces of at least x
    words = np.concatenate(([0], np.cumsum(count * size)))  # sum of all lengths below x
    t = np.arange(0, capacity // 2 + 1)
    whole = np.where(t > 0, from_top[np.minimum(capacity - t + 1, capacity)], 0)
    best = int((whole + -(-(words[capacity - t + 1] - words[t]) // capacity)).max())
    for k in range(1, max_k + 1):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _packer(capacity: int, base: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        at = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(at, weights=lengths).astype(np.int64)
        order = np.argsort(at, kind="stable")
        run = np.cumsum(lengths[order]) - lengths[order]
        opens = np.r_[True, np.diff(at[order]) > 0]
        offset, first = np.empty(len(at), np.int64), np.empty(len(at), np.int32)
        offset[order] = run - np.maximum.accumulate(np.where(opens, run, 0))
        first[order] = opens
        return pdf.drop(columns="part").assign(
            sequence_id=base + part * (1 << 24) + at, offset=offset, opens=first, fill=fill[at],
            bins=len(fill), bound=lower_bound(lengths, capacity))
    return pack


def pack(items: DataFrame, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces; reads ``items`` more than once."""
    full = (items.filter(F.col("length") >= capacity)
            .withColumn("sequence_id", -1 - F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")))
    open_items, settled, before = items.filter(F.col("length") < capacity), [full], None
    columns = [*items.columns, "sequence_id", "offset"]
    for k in range(rounds + 1):
        n = open_items.count()
        if not n:
            break
        parts = max(MIN_PARTS if n >= SMALL else 1, n // (PART_ITEMS << k))  # a round's partitions are twice as large
        key = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.lit(k))
        dealt = open_items.select(*items.columns, F.pmod(key, F.lit(parts)).alias("part"))
        packed = stored(dealt.groupBy("part").applyInPandas(_packer(capacity, k << 56), _PACKED_DDL), f"packed{k}")
        is_open = (F.col("fill") < capacity) & (F.col("bins") > F.col("bound"))
        now = packed.agg(F.sum("opens").alias("all"), F.sum(F.when(is_open, F.col("opens"))).alias("open")).first()
        if before is not None and now["all"] >= before[1]:
            break  # nothing saved: the round before stands
        if before is not None:
            settled.append(before[0].filter(~before[2]).select(*columns))
        before = (packed, now["open"] or 0, is_open)
        open_items = packed.filter(is_open).select(*items.columns)
    if before is not None:
        settled.append(before[0].select(*columns))
    out = settled[0].select(*columns)
    for df in settled[1:]:
        out = out.unionByName(df)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, blanks: bool, capacity: int = 1024,
                   rounds: int = ROUNDS) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return pack(stored(pieces(docs, tokenizer, end_id, blanks, capacity), "pieces"), capacity, rounds)
