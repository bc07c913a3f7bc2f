"""Operator 11: periodic runs of words by an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q (words q apart are equal),
at least ``max(MIN_LENGTH, 2 * q)`` words long, that no neighbouring word extends.

Method, per block of whole texts (each closed by a mark of its own, so nothing crosses
texts): words are coded as integers, suffixes are ordered by doubling (only the positions
that are still tied are sorted again), and the LCP of neighbours is read from the names
that the doubling rounds gave to blocks of 2^l words.  Every LCP interval of depth D is cut
at its boundaries; for each suffix i of the smaller side the branching-tandem test looks up
whether ISA[i + D] or ISA[i - D] lies in the other side, which holds exactly where a square
of period D cannot be moved one word to the right.  A square found is rotated to the left as
far as it goes, by the same names, which gives the run; runs of one stretch are merged into
the one with the smallest period.  Arrays only: no tree nodes, O(n log n) words of work.

Scale: one narrow pass, no shuffle; a block holds at most ``BLOCK_WORDS`` words or one text,
so a task's memory grows with its longest text alone (about 25 integers a word).

Defined cases: a null, empty or blank text has no words and no run (four nulls, the sha256
of nothing); a null doc_id is kept, and counts as the empty text where ids are hashed; each
of several rows with one doc_id is a text of its own; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomefold.llm.common import let, prepare, words

MIN_LENGTH = 12
BLOCK_WORDS = 1 << 17
PAIRS_AT_ONCE = 1 << 21

_NONE = hashlib.sha256(b"").hexdigest()


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(suffixes in order, their ranks, names of the blocks of 2^l codes, LCP of each rank with the one before).

    The last code must be unique.  Two blocks of 2^l codes are equal where their names of
    level l are; the LCP array has one entry more than codes, -1 at both ends.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    found_in = np.zeros(n, np.int8)  # the round in which a rank was told from the one before
    levels = [rank.copy()]
    tied = order[~(new & np.r_[new[1:], True])]
    step = 1
    while len(tied):
        group = rank[tied].astype(np.int64)
        key = group * n + rank[tied + step]
        by = np.argsort(key, kind="stable")
        tied, group, key = tied[by], group[by], key[by]
        new_group = np.r_[True, group[1:] != group[:-1]]
        new = np.r_[True, key[1:] != key[:-1]]
        at = np.arange(len(tied))
        moved = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        rank[tied] = group + moved
        found_in[(group + moved)[new & ~new_group]] = len(levels)
        levels.append(rank.copy())
        tied = tied[~(new & np.r_[new[1:], True])]
        step *= 2
    suffixes = np.empty(n, np.int32)
    suffixes[rank] = np.arange(n, dtype=np.int32)
    lcp = np.zeros(n + 1, np.int32)
    lcp[:n] = np.where(found_in > 0, np.int32(1) << np.maximum(found_in.astype(np.int32) - 1, 0), 0)
    for level in range(len(levels) - 3, -1, -1):
        at = np.flatnonzero(found_in > level + 1)
        name = levels[level]
        same = name[suffixes[at - 1] + lcp[at]] == name[suffixes[at] + lcp[at]]
        lcp[at[same]] += 1 << level
    lcp[0] = lcp[n] = -1
    return suffixes, rank, levels, lcp


def _sides(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, low, high): the LCP interval of each boundary k holds ranks low..k-1 before it and k..high after it.

    Before a boundary stand ranks up to the last boundary of no greater depth, after it up
    to the next of a smaller one, so the boundaries of one interval cut it child by child.
    """
    least = [lcp]
    while len(least[-1]) > 1 << (len(least) - 1):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    k = np.flatnonzero(lcp > 0)
    depth = lcp[k]
    low, high = k.copy(), k + 1
    for level in range(len(least) - 1, -1, -1):
        size, table = 1 << level, least[level]
        begin = low - size
        move = (begin >= 0) & (table[np.maximum(begin, 0)] > depth)
        low[move] -= size
        move = (high < len(table)) & (table[np.minimum(high, len(table) - 1)] >= depth)
        high[move] += size
    return k, low - 1, high - 1


def runs_of(codes: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run, by start, then period; ``codes`` ends with a unique code."""
    suffixes, rank, levels, lcp = suffix_order(codes)
    k, low, high = _sides(lcp)
    depth = lcp[k].astype(np.int64)
    left_smaller = k - low <= high - k + 1
    base, size = np.where(left_smaller, low, k), np.where(left_smaller, k - low, high - k + 1)
    other_low, other_high = np.where(left_smaller, k, low), np.where(left_smaller, high, k - 1)
    total = np.cumsum(size)
    starts, periods = [], []
    begin = 0
    while begin < len(k):
        done = int(total[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE)))
        of = np.repeat(np.arange(begin, end), size[begin:end])
        suffix = suffixes[base[of] + np.arange(len(of)) - (total[of] - size[of] - done)].astype(np.int64)
        for sign in (1, -1):
            partner = suffix + sign * depth[of]
            at = rank[np.maximum(partner, 0)]
            hit = (partner >= 0) & (at >= other_low[of]) & (at <= other_high[of])
            starts.append(np.minimum(suffix, partner)[hit])
            periods.append(depth[of[hit]])
        begin = end
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    period = np.concatenate(periods) if periods else np.empty(0, np.int64)
    end = start + 2 * period
    for level in range(len(levels) - 1, -1, -1):  # rotate to the left
        before, name = start - (1 << level), levels[level]
        same = (before >= 0) & (name[np.maximum(before, 0)] == name[np.maximum(before, 0) + period])
        start = np.where(same, before, start)
    long = end - start >= np.maximum(min_length, 2 * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    least = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.empty(0, bool)
    start, end, period = start[least], end[least], period[least]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FOUND = pa.schema([("doc_id", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])


def _block_runs(values: pa.Array, ends: np.ndarray, min_length: int):
    """Runs of the texts whose words are ``values`` up to ``ends``: (text, start, length, period)."""
    begins = np.r_[0, ends[:-1]]
    coded = values.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), ends - begins)
    codes = np.empty(len(code) + len(ends), np.int64)
    codes[np.arange(len(code)) + text] = code
    codes[ends + np.arange(len(ends))] = len(coded.dictionary) + np.arange(len(ends))
    start, end, period = runs_of(codes, min_length)
    of = np.searchsorted(ends + np.arange(len(ends)), start)
    return of, start - of - begins[of], end - start, period


def _find(min_length: int):
    def find(batches):
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten()
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            found, begin = [], 0
            while begin < len(size):
                done = int(ends[begin - 1]) if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, done + BLOCK_WORDS, side="right")))
                of, start, length, period = _block_runs(values.slice(done, int(ends[stop - 1]) - done),
                                                        ends[begin:stop] - done, min_length)
                found.append((of + begin, start, length, period))
                begin = stop
            of, start, length, period = (np.concatenate(c) for c in zip(*found)) if found else [np.empty(0, np.int64)] * 4
            first = np.r_[0, ends[:-1]]
            change = np.zeros(len(values) + 1, np.int64)
            np.add.at(change, first[of] + start + period, 1)
            np.add.at(change, first[of] + start + length, -1)
            keep = np.cumsum(change[:-1]) == 0
            kept = np.r_[0, np.cumsum(keep)][np.r_[0, ends]].astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept), values.filter(pa.array(keep))), " ")
            of_text = np.searchsorted(of, np.arange(len(size) + 1)).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(of_text), pa.StructArray.from_arrays(
                [pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), runs, texts], schema=_FOUND)
    return find


def find_runs(texts: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, runs, collapsed) of ``texts`` (doc_id, words: array of strings).

    ``runs`` are (start, length, period) by start, then period; ``collapsed`` is the text
    without the words that stand in a run after its first period, joined by one space.
    """
    prepare(texts.sparkSession)
    none = F.array().cast("array<string>")
    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("words", none).alias("words")).mapInArrow(
        _find(min_length), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_period(doc_id: Column, of: Column) -> Column:
    """The words of a text; of every tenth document (by the crc32 of its id) all from one word on repeat."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    n = F.greatest(F.size(of), F.lit(1))
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))

    def repeated(x):
        return F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(
            F.get(x["w"], (x["a"] + (i - x["a"]) % x["p"]).cast("int"))))

    return F.when(h % 10 == 0, let(F.struct(of.alias("w"), a.alias("a"), p.alias("p")), repeated)).otherwise(of)


def run_digests(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Per document of (doc_id, text), with its periodic tenth: its longest run and digests of all."""
    texts = docs.select("doc_id", words(F.col("text")).alias("words"))
    found = find_runs(texts.select("doc_id", with_period(F.col("doc_id"), F.col("words")).alias("words")), min_length)
    spelled = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    has = F.size("runs") > 0
    found = found.select("doc_id", "runs", F.when(has, best).alias("best"), F.sha2(spelled, 256).alias("runs_sha256"),
                         F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.short")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-F.col("best.short") * 1000 / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
