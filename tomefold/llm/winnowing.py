"""Operator 2: document fingerprints by winnowing.

Method: a rolling hash of every k-gram of code points; from each window of ``WINDOW``
consecutive grams the smallest hash is kept, the rightmost one on ties, with its position.
Any passage of at least ``K + WINDOW - 1`` code points that two texts share therefore
leaves a common hash in both fingerprints (the match guarantee): 31 code points, so a text of
62 or more always shares a hash with an edit that keeps its first half.  A fingerprint is written
as ``position:hash`` items, comma-joined, in text order; the likeness of two fingerprints is
the Jaccard similarity of their hashes.

Scale: fingerprints are made row by row, in blocks, so memory does not grow with a text.
The edited text needs the next document in descending doc_id order: documents are dealt
into ranges of doc_id (bounds from one approximate percentile) and sorted inside them, so
whole texts are shuffled once; the first document of each range is also sent to the range
before it.  Only one (id, hash) pair per range reaches the driver.

Defined cases: null text is the empty text; the empty fingerprint is the empty string; two
empty fingerprints have likeness 1, an empty and another 0; a text shorter than a gram is
one gram; null doc_ids come last; rows with equal doc_id follow one another by text hash; a
single document is its own next; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomefold.llm.common import prepare

K = 16
WINDOW = 16
BLOCK = 1 << 20
RANGES_PER_PARTITION = 4

_BASE = 0x9E3779B97F4A7C15
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                  ("near_edited", pa.float64()), ("near_next", pa.float64())])
_OUT_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-gram: polynomials of 1, 2, 4, ... codes, joined, then mixed."""
    piece, length = codes.astype(np.uint64) + np.uint64(1), 1
    whole, covered = None, 0
    while True:
        if k & length:
            if whole is None:
                whole = piece
            else:
                n = len(piece) - covered
                whole = whole[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + piece[covered:]
            covered += length
        if covered == k:
            break
        piece = piece[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + piece[length:]
        length *= 2
    h = whole[:len(codes) - k + 1].copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def rightmost_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost smallest value of each window of ``w``, without repeats."""
    value, at, width = h, np.arange(len(h), dtype=np.int64), 1
    while width < w:
        step = min(width, w - width)
        later = value[step:] <= value[:-step]
        at = np.where(later, at[step:], at[:-step])
        value = np.where(later, value[step:], value[:-step])
        width += step
    return at[np.r_[True, at[1:] != at[:-1]]]


def winnow(text: str, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the fingerprint of ``text``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    k = min(k, len(codes))
    w = min(w, len(codes) - k + 1)
    windows = len(codes) - k - w + 2
    positions, hashes = [], []
    for begin in range(0, windows, BLOCK):
        h = gram_hashes(codes[begin:min(begin + BLOCK, windows) + w - 1 + k - 1], k)
        at = rightmost_minima(h, w)
        if positions and at[0] + begin == positions[-1][-1]:
            at = at[1:]
        if len(at):
            positions.append(at + begin)
            hashes.append(h[at].astype(np.uint32))  # the low half: minima are small
    return np.concatenate(positions), np.concatenate(hashes)


def spell(mark: tuple[np.ndarray, np.ndarray]) -> str:
    return ",".join([f"{p}:{h:08x}" for p, h in zip(mark[0].tolist(), mark[1].tolist())])


def likeness(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the next document."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(batches):
    """Rows sorted by range, guests last: each row of its own with the one after it."""
    last = None  # (range, doc_id, text, mark, hash set) of the row that waits for its next

    def finish(row, after):
        _, doc_id, text, mark, own = row
        edited = edited_text(text, after[2])
        edited_mark = winnow(edited)
        return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), spell(mark),
                spell(edited_mark), likeness(own, set(edited_mark[1].tolist())), likeness(own, after[4]))

    for batch in batches:
        rows = []
        for span, guest, doc_id, text in zip(*(batch.column(k) for k in range(4))):
            span, guest, text = span.as_py(), guest.as_py(), text.as_py()
            if guest and (last is None or last[0] != span):
                continue  # a repeat of the guest that was used
            mark = winnow(text)
            row = (span, doc_id.as_py(), text, mark, set(mark[1].tolist()))
            if last is not None:
                rows.append(finish(last, row))
            last = None if guest else row
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    spark = docs.sparkSession
    prepare(spark)
    n_ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n_ranges for i in range(1, n_ranges)], 100 * n_ranges)).first()[0]
    bounds = np.unique(np.asarray(cuts or [], dtype=np.int64))

    @F.pandas_udf("long")
    def range_of(ids: pd.Series) -> pd.Series:  # 0 is the last range: null ids
        found = np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="right") + 1
        return pd.Series(np.where(ids.isna(), 0, found))

    keyed = docs.withColumn("h", F.xxhash64("text"))
    firsts = (keyed.select("doc_id", "h").withColumn("span", range_of("doc_id"))
              .groupBy("span").agg(F.max(F.struct(F.col("doc_id"), F.col("h"))).alias("top")).collect())
    firsts.sort(key=lambda r: -r["span"])  # one row per range, in document order
    guests = [(firsts[i - 1]["span"], r["top"]["doc_id"], r["top"]["h"]) for i, r in enumerate(firsts)]
    guest_rows = spark.createDataFrame(guests, "to long, guest_id long, guest_h long")

    own = keyed.withColumn("span", range_of("doc_id"))
    joined = own.join(F.broadcast(guest_rows), F.col("doc_id").eqNullSafe(F.col("guest_id"))
                      & (F.col("h") == F.col("guest_h")), "left")
    places = F.filter(F.array(F.struct(F.col("span").alias("span"), F.lit(False).alias("guest")),
                              F.struct(F.col("to").alias("span"), F.lit(True).alias("guest"))),
                      lambda x: x["span"].isNotNull())
    dealt = joined.select("doc_id", "text", "h", F.explode(places).alias("p"))
    ordered = (dealt.select("p.span", "p.guest", "doc_id", "text", "h").repartition("span")
               .sortWithinPartitions("span", "guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc()))
    return ordered.mapInArrow(_compare, _OUT_DDL)
