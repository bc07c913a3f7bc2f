"""Operator 13: removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every suffix of every text is of interest only through its first ``LENGTH`` bytes.  Suffixes
are ordered through that depth by most-significant-digit passes; groups that are still equal
after the last digit are exactly the repeated windows, and every window outside the document
with the smallest id of its group is removed.

* **First digit.**  The digit of the first pass is the gram of ``GRAM`` bytes with the smallest
  hash inside the window (the leftmost of equals), which equal windows have in common.
  Neighbouring windows mostly share it, so a pass over all suffixes handles one row for some 17
  of them.  Suffixes whose digit occurs in one text only are ordered already and drop out.
* **Second pass.**  The rest, neighbours still together as segments, go to the bucket of their
  digit.  Windows of a digit that more than ``HOT`` texts hold go one by one to the bucket of
  their own bytes, equal ones of a block once, so that no digit fills a task.
* **Further digits.**  Inside a bucket, windows are ordered by 8 bytes a pass; those alone in
  their group drop out after each pass.  What is left after ``LENGTH`` bytes is equal.

Texts are read once into blocks (compressed, equal texts once); a block answers to its own
number, so that what comes back is one bit per digit and one per window, not rows of positions.
Blocks are written to the shared folder: each pass computes the same digits from them again.

Scale: a block and a bucket hold a bounded number of bytes (blocks grow with the root of the
corpus, so that blocks times buckets stays small).  Windows are compared by their bytes.  Texts
are named by 64-bit hashes inside a block, distinct segments inside a bucket as well.

Defined cases: a null text is empty; a null doc_id counts as larger than all others; documents
with one id do not remove each other's strings; texts below ``LENGTH`` bytes stay; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomefold.llm.common import prepare, stored

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 8_000_000
MOST_BLOCK_BYTES = 32_000_000
BUCKET_BYTES = 8_000_000
HOT = 4096
_AT_ONCE = 1 << 18  # windows; places inside a slice need 20 bits
_PLACE = np.uint64((1 << 20) - 1)
_NO_ID = np.iinfo(np.int64).max
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F,
                 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[2]
    return h ^ (h >> np.uint64(29))


_CODEC = pa.Codec("zstd", compression_level=4)


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _spans(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


# --------------------------------------------------------------------------- blocks
_BLOCKS = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("names", pa.binary()), ("rows", pa.binary()),
                     ("ids", pa.binary()), ("ends", pa.binary()), ("data", pa.binary())])
_BLOCKS_DDL = "block long, size long, names binary, rows binary, ids binary, ends binary, data binary"


def _blocks(most: int):
    """(doc_id, null, name, text) -> blocks: ``rows`` are (id, has an id, text) of every document, ``ids`` the
    smallest id of every distinct text, ``ends`` where it ends in ``data``."""
    def emit(batches):
        part, number = TaskContext.get().partitionId(), 0
        texts, known, rows, size = [], {}, [], 0

        def block():
            ids = np.full(len(texts), _NO_ID, np.int64)
            of = np.array(rows, np.int64).reshape(-1, 3)
            np.minimum.at(ids, of[:, 2], of[:, 0])
            ends = np.cumsum([len(t) for t in texts]).astype("<i8")
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                (part << 24 | number, size, np.array(list(known), "<i8").tobytes(), of.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), ends.tobytes(),
                 _packed(b"".join(texts))), _BLOCKS)], schema=_BLOCKS)

        for batch in batches:
            for doc_id, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if name not in known:
                    known[name] = len(texts)
                    texts.append(text)
                    size += len(text)
                rows.append((_NO_ID if doc_id is None else doc_id, doc_id is not None, known[name]))
                if size >= most:
                    yield block()
                    texts, known, rows, size, number = [], {}, [], 0, number + 1
        if rows:
            yield block()
    return emit


class Block:
    """The digits of a block: segments of neighbouring windows that share one, by first window."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.rows = np.frombuffer(row["rows"], "<i8").reshape(-1, 3)
        self.ids, self.ends = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ends"], "<i8")
        self.raw = _unpacked(row["data"])
        self.data = np.frombuffer(self.raw, np.uint8)
        self.begins = np.r_[0, self.ends[:-1]].astype(np.int64)
        #: Texts that a document with a smaller id has in another block: they go whole, unless short.
        self.copy = np.zeros(len(self.ends), bool)
        self.copy[row.get("copies") or []] = True
        self.start, self.windows, name = self._segments()
        self.text = np.searchsorted(self.ends, self.start, side="right")
        #: Distinct digits in order, and each segment's.
        self.names, self.digit = np.unique(name, return_inverse=True)

    def _segments(self):
        n = len(self.data)
        crossing = np.zeros(n + 1, np.int8)  # windows that would leave their text
        np.add.at(crossing, np.maximum(self.begins, self.ends - LENGTH + 1), 1)
        np.add.at(crossing, self.ends, -1)
        inside = np.cumsum(crossing[:-1], dtype=np.int8) == 0
        starts, counts, names = [], [], []
        for begin in range(0, n - LENGTH + 1, _AT_ONCE):
            some = self.data[begin:begin + _AT_ONCE + LENGTH - 1]
            gram = some.astype(np.uint64) + np.uint64(1)
            size = 1
            while size < GRAM:  # grams of twice the bytes; GRAM is a power of two
                gram = _mixed(gram[:-size] * _ODD[0] + gram[size:])
                size *= 2
            least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
            width, size = LENGTH - GRAM + 1, 1
            while 2 * size <= width:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            count = len(some) - LENGTH + 1
            least = np.minimum(least[:count], least[width - size:width - size + count])
            at = np.flatnonzero(inside[begin:begin + count])
            if not len(at):
                continue
            place = (least[at] & _PLACE).astype(np.int64)
            new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
            starts.append(begin + at[new])
            counts.append(np.diff(np.r_[new, len(at)]))
            names.append(_mixed(gram[place[new]] ^ _ODD[1]) >> np.uint64(16))
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.concatenate(starts), np.concatenate(counts), np.concatenate(names)

    def several(self) -> np.ndarray:
        """Whether two texts of the block hold each digit."""
        low, high = np.full(len(self.names), len(self.ends)), np.full(len(self.names), -1)
        np.minimum.at(low, self.digit, self.text)
        np.maximum.at(high, self.digit, self.text)
        return low < high

    def open(self, masks, n_buckets: int):
        """What goes to the second pass: distinct segments with their holders, by bucket."""
        shared, hot = np.zeros(len(self.names), bool), np.zeros(len(self.names), bool)
        order, bounds = by_bucket(self.names, n_buckets)
        for mask in masks:
            at = order[bounds[mask["bucket"]]:bounds[mask["bucket"] + 1]]
            for flags, bits in ((shared, mask["shared"]), (hot, mask["hot"])):
                flags[at] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)
        held = np.flatnonzero(shared[self.digit] & ~self.copy[self.text])
        one = held[~hot[self.digit[held]]]
        many = held[hot[self.digit[held]]]
        times = self.windows[many]
        alone = np.repeat(self.start[many], times) + _spans(times)  # the windows of hot digits, one by one
        start = np.r_[self.start[one], alone]
        windows = np.r_[self.windows[one], np.ones(len(alone), np.int64)]
        text = np.r_[self.text[one], np.repeat(self.text[many], times)]
        raw = memoryview(self.raw)
        content = np.fromiter((xxhash.xxh64_intdigest(raw[i:j]) for i, j in zip(
            start.tolist(), (start + windows + LENGTH - 1).tolist())), np.uint64, len(start))
        key = np.r_[self.names[self.digit[one]], content[len(one):]]
        distinct, first, of = np.unique(content, return_index=True, return_inverse=True)
        least = np.full(len(distinct), _NO_ID, np.int64)
        np.minimum.at(least, of, self.ids[text])
        return Segments(start, windows, text, of, first, key[first], least)


class Segments:
    """Segments (or single windows) of a block: ``of`` is each one's distinct segment, ``first`` its first place."""

    def __init__(self, start, windows, text, of, first, key, least):
        self.start, self.windows, self.text, self.of = start, windows, text, of
        self.first, self.key, self.least = first, key, least


def by_bucket(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket, where each bucket begins in it); inside a bucket the given order stays."""
    bucket = (keys % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def _rows_of(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


# --------------------------------------------------------------------------- first digit
def _first_digits(n_buckets: int):
    def emit(batches):
        for row in _rows_of(batches):
            block = Block(row)
            several = block.several()
            order, bounds = by_bucket(block.names, n_buckets)
            out = []
            for bucket in np.flatnonzero(np.diff(bounds)).tolist():
                at = order[bounds[bucket]:bounds[bucket + 1]]
                names = block.names[at] // np.uint64(n_buckets)
                step = np.diff(names, prepend=np.uint64(0)) << np.uint64(1) | several[at].astype(np.uint64)
                kind = "<u4" if int(step.max()) < 1 << 32 else "<u8"
                out.append((bucket, block.number, len(at), _packed(step.astype(kind).tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["bucket", "block", "n", "data"])
    return emit


def shared_digits(hot: int):
    """Which digits of a bucket two texts hold, and which more than ``hot``: bits in each block's own order."""
    def shared(rows: pd.DataFrame) -> pd.DataFrame:
        names, several = [], []
        for n, data in zip(rows["n"], rows["data"]):
            raw = _unpacked(data)
            step = np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u8").astype(np.uint64)
            names.append(np.cumsum(step >> np.uint64(1), dtype=np.uint64))
            several.append((step & np.uint64(1)) == 1)
        sizes = [len(x) for x in names]
        names, several = np.concatenate(names), np.concatenate(several)
        _, of = np.unique(names, return_inverse=True)
        held = np.bincount(of, weights=1 + several).astype(np.int64)[of]
        out, begin = [], 0
        for block, size in zip(rows["block"], sizes):
            some = held[begin:begin + size]
            begin += size
            if (some > 1).any():
                out.append((block, rows["bucket"].iloc[0], np.packbits(some > 1).tobytes(), np.packbits(some > hot).tobytes()))
        return pd.DataFrame(out, columns=["block", "bucket", "shared", "hot"])
    return shared


# --------------------------------------------------------------------------- second pass
def _open_segments(n_buckets: int):
    def emit(batches):
        for row in _rows_of(batches):
            block = Block(row)
            found = block.open(row["masks"], n_buckets)
            order, bounds = by_bucket(found.key, n_buckets)
            out = []
            for bucket in np.flatnonzero(np.diff(bounds)).tolist():
                at = order[bounds[bucket]:bounds[bucket + 1]]
                begin, size = found.start[found.first[at]], found.windows[found.first[at]] + LENGTH - 1
                raw = block.data[np.repeat(begin, size) + _spans(size)].tobytes()
                head = found.key[at].astype("<u8").tobytes() + found.least[at].astype("<i8").tobytes() + size.astype("<u2").tobytes()
                out.append((bucket, block.number, len(at), _packed(head + raw)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["bucket", "block", "n", "data"])
    return emit


def smallest_ids(data: np.ndarray, start: np.ndarray, group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id among equal windows of ``LENGTH`` bytes of each group, for the window at each ``start``.

    Most significant digits first, 8 bytes a pass; a window alone in its group drops out.
    """
    least = ids.copy()
    at = np.arange(len(start))
    group = group.copy()
    for depth in range(0, LENGTH, 8):
        size = min(8, LENGTH - depth)
        digit = np.zeros(len(at), np.uint64)
        for k in range(size):
            digit = digit << np.uint64(8) | data[start[at] + depth + k]
        by = np.lexsort((digit, group))
        at, group, digit = at[by], group[by], digit[by]
        new = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])] if len(at) else np.empty(0, bool)
        stays = ~(new & np.r_[new[1:], True]) if len(at) else new
        group = np.cumsum(new)[stays]
        at = at[stays]
    if len(at):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        least[at] = np.repeat(np.minimum.reduceat(ids[at], first), np.diff(np.r_[first, len(at)]))
    return least


def _sorted_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """For each segment of each block of a bucket one bit per window: whether a smaller id has its string."""
    parts = []
    for n, data in zip(rows["n"], rows["data"]):
        raw = _unpacked(data)
        parts.append((np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<u2", n, 16 * n),
                      raw[18 * n:]))
    key, ids, size = (np.concatenate([p[k] for p in parts]) for k in range(3))
    size = size.astype(np.int64)
    raw = b"".join(p[3] for p in parts)
    data = np.frombuffer(raw, np.uint8)
    end = np.cumsum(size)
    begin = end - size
    view = memoryview(raw)
    content = np.fromiter((xxhash.xxh64_intdigest(view[i:j]) for i, j in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))
    distinct, first, of = np.unique(content, return_index=True, return_inverse=True)
    least = np.full(len(distinct), _NO_ID, np.int64)
    np.minimum.at(least, of, ids)
    windows = size[first] - LENGTH + 1
    place = np.cumsum(windows) - windows
    smallest = np.repeat(least, windows)
    _, digit, kinds = np.unique(key[first], return_inverse=True, return_counts=True)
    several = np.flatnonzero(kinds[digit] > 1)  # digits with one segment only need no order
    times = windows[several]
    at = np.repeat(place[several], times) + _spans(times)
    start = np.repeat(begin[first[several]], times) + _spans(times)
    smallest[at] = smallest_ids(data, start, np.repeat(digit[several], times), smallest[at])
    times = windows[of]
    bit = (smallest[np.repeat(place[of], times) + _spans(times)] < np.repeat(ids, times)).astype(np.uint64)
    answer = np.add.reduceat(bit << _spans(times).astype(np.uint64), np.cumsum(times) - times)
    out, done = [], 0
    for block, (own, *_) in zip(rows["block"], parts):
        out.append((block, rows["bucket"].iloc[0], _packed(answer[done:done + len(own)].astype("<u8").tobytes())))
        done += len(own)
    return pd.DataFrame(out, columns=["block", "bucket", "answers"])


# --------------------------------------------------------------------------- removal
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                   ("kept", pa.string())])


def _covered(block: Block, row: dict, n_buckets: int) -> np.ndarray:
    """Bytes of the block's texts (as of the document with each text's smallest id) that go."""
    gone = np.zeros(len(block.data) + 1, np.int32)
    if row["masks"]:
        found = block.open(row["masks"], n_buckets)
        answer = np.zeros(len(found.key), np.uint64)
        order, bounds = by_bucket(found.key, n_buckets)
        for part in row["answers"] or ():
            answer[order[bounds[part["bucket"]]:bounds[part["bucket"] + 1]]] = np.frombuffer(_unpacked(part["answers"]), "<u8")
        later = block.ids[found.text] > found.least[found.of]  # a smaller id of this block has the whole segment
        bits = np.where(later, ~np.uint64(0), answer[found.of])
        of = np.repeat(np.arange(len(bits)), found.windows)
        offset = _spans(found.windows)
        hit = (bits[of] >> offset.astype(np.uint64)) & np.uint64(1) == 1
        start = found.start[of[hit]] + offset[hit]
        np.add.at(gone, start, 1)
        np.add.at(gone, start + LENGTH, -1)
    return np.cumsum(gone[:-1], dtype=np.int32) > 0


def _remove(n_buckets: int, digest, last: str):
    def emit(batches):
        for row in _rows_of(batches):
            block = Block(row)
            gone = _covered(block, row, n_buckets)
            first = np.zeros(len(gone), bool)
            first[block.begins[block.ends > block.begins]] = True
            opens = gone & np.r_[True, ~gone[:-1]] | gone & first if len(gone) else gone
            sums = [np.r_[np.int32(0), np.cumsum(x, dtype=np.int32)] for x in (gone, opens)]
            removed, spans = (s[block.ends] - s[block.begins] for s in sums)
            size = block.ends - block.begins
            kept = {}
            out = []
            for doc_id, known, text in block.rows.tolist():
                n = int(size[text])
                i, j = int(block.begins[text]), int(block.ends[text])
                if (block.copy[text] or doc_id > block.ids[text]) and n >= LENGTH:  # a smaller id has the same text
                    out.append((doc_id if known else None, n, n, 1, digest(b"")))
                    continue
                if text not in kept:
                    kept[text] = digest(block.data[i:j][~gone[i:j]].tobytes() if removed[text] else block.raw[i:j])
                out.append((doc_id if known else None, n, int(removed[text]), int(spans[text]), kept[text]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _KEPT)], [*_KEPT.names[:-1], last])
    return emit


def _sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _passes(docs: DataFrame) -> tuple[DataFrame, int]:
    """(blocks with their digits' masks and their windows' answers, number of buckets)."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("name"), text.cast("binary").alias("text"))
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    most = int(min(max(BLOCK_BYTES, 32 * math.sqrt(total)), MOST_BLOCK_BYTES))
    n_buckets = max(-(-total // BUCKET_BYTES), 16)
    blocks = stored(texts.mapInArrow(_blocks(most), _BLOCKS_DDL), "radix-blocks")
    digits = blocks.mapInArrow(_first_digits(n_buckets), "bucket long, block long, n long, data binary")
    masks = stored(digits.groupBy("bucket").applyInPandas(
        shared_digits(HOT), "block long, bucket long, shared binary, hot binary"), "radix-masks")
    masks = masks.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("masks"))  # a row per bucket
    notes = stored(blocks.select("block").join(_copies(blocks), "block", "left").join(masks, "block", "left"), "radix-notes")
    opened = blocks.join(notes, "block").select(*blocks.columns, "copies", "masks")
    segments = opened.where(F.col("masks").isNotNull()).mapInArrow(
        _open_segments(n_buckets), "bucket long, block long, n long, data binary")
    answers = segments.groupBy("bucket").applyInPandas(_sorted_bucket, "block long, bucket long, answers binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "answers")).alias("answers"))
    # one plan: the exchange of the blocks is made once and read for the segments and for the removal
    return opened.join(answers, "block", "left"), n_buckets


def _copies(blocks: DataFrame) -> DataFrame:
    """(block, copies): texts of a block that a document of another block with a smaller id has."""
    texts = stored(blocks.select("block", "names", "ids").mapInArrow(_named, "block long, text int, name long, id long"), "radix-names")
    least = texts.groupBy("name").agg(F.min("id").alias("least"))
    copies = texts.join(least, "name").where(F.col("id") > F.col("least"))
    return stored(copies.groupBy("block").agg(F.collect_list("text").alias("copies")), "radix-copies")


def _named(batches):
    for row in _rows_of(batches):
        names, ids = np.frombuffer(row["names"], "<i8"), np.frombuffer(row["ids"], "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"])), pa.array(np.arange(len(ids), dtype=np.int32)),
                                          pa.array(names), pa.array(ids)], ["block", "text", "name", "id"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what stays of each text; a character cut in two is replaced."""
    blocks, n_buckets = _passes(docs)
    return blocks.mapInArrow(_remove(n_buckets, _text, "kept"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept string")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    blocks, n_buckets = _passes(docs)
    return blocks.mapInArrow(_remove(n_buckets, _sha256, "kept_sha256"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
