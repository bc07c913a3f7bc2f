"""Operator 12: alignment of two tokenizers' tokens by minimal perfect hashing.

Tokenizer A encodes a space and the text, tokenizer B (which adds the space itself) the
text.  Byte offsets where tokens of both end cut the text into groups; every A-B pair of
token occurrences in a group is a link, and the count of an id pair is the number of
documents that hold it linked.

Method, in passes over all documents:

0. every text is encoded once by both; the ids are written;
1. every task aligns its documents and emits their distinct id pairs; Spark makes them distinct;
2. the pairs are dealt into shards of about ``SHARD_PAIRS``, one task builds a shard's minimal
   perfect hash function and keeps its keys in index order;
3. every task aligns its documents again and adds one per document and pair to a dense count
   vector indexed by the hash; the vectors of all tasks are summed in a tree of ``FAN_IN``;
4. every task re-aligns its documents and looks up the counts of their links; a key that
   differs from the one kept at its index is no member.

Steps 3 and 4 run in rounds of at most ``ROUND_SHARDS`` shards: what a round broadcasts is
bounded by that constant (some 13 bytes a pair, 50 MB), however many pairs there are; the
counts of different rounds add up.  Besides, one number per id of A is broadcast.

Texts are cut at single blanks and newlines, which neither kind of file joins characters
across, and the ids of such a unit are remembered (a bounded memo that only saves time).  A
text with other or repeated white space, or with a unit that is not rendered byte by byte,
is encoded in one piece.  A group of many tokens is linked by its distinct ids with their
numbers, not occurrence by occurrence.

Defined cases: a text that is null, empty, or not rendered byte by byte by both has no
tokens (zeros, an empty digest); rows with equal or null doc_ids are documents of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomefold.llm.common import prepare, stored
from tomefold.llm.perfect_hash import PerfectHash

SHARD_PAIRS = 1 << 18
ROUND_SHARDS = 16
BLOCK = 1 << 14
FAN_IN = 16
MEMO_UNITS = 400_000
UNITS_AT_ONCE = 256
CHARS_AT_ONCE = 1_000_000
BYTES_AT_ONCE = 1_000_000
LARGE_GROUP = 4096

_OTHER_SPACE = re.compile(r"[^\S \n]")
_RUN = re.compile(r"[ \n][ \n]|\A[ \n]|[ \n]\Z")


def _byte_symbols() -> dict[str, int]:
    """Byte-level files spell a byte as a character: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """The two tokenizers, the bytes that their ids render, and the ids of frequent units of texts."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        symbols = _byte_symbols()
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.types = ["<u2" if size <= 1 << 16 else "<u4" for size in (self.size_a, self.size_b)]
        spelled = [self.a.id_to_token(i) or "" for i in range(self.size_a)]
        self.bytes_a = [bytes(symbols[c] for c in s) if all(c in symbols for c in s) else s.encode() for s in spelled]
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size_b)]
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        #: Decimal ids with what follows them: a comma, the bar between A and B, or the mark between groups.
        self.spelled = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(max(self.size_a, self.size_b))])
        #: Code of a unit: one that begins with a newline keeps it, others stand for a space and themselves.
        self.codes: dict[str, int] = {}
        #: Per side the ids of all units and where each unit's end; a unit that is not rendered byte by byte has none.
        self.known = [(np.empty(0, kind), np.zeros(1, np.int64)) for kind in self.types]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a space and ``text`` in one piece; None if they do not render its bytes."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
        raw = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, self.types[0]), np.array(b, self.types[1])

    def _new(self, names: list[str]):
        """Ids of new units side by side, told apart by the bytes they render: per side (ids, ends)."""
        spaced = [u if u[0] == "\n" else " " + u for u in names]
        line = "x" + "".join(spaced)
        raw = (" " + line).encode()
        a = self.a.encode_batch_fast([" " + line], add_special_tokens=False)[0].ids
        b = self.b.encode(line, num_threads=1)
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            if len(names) == 1:
                return [(np.empty(0, kind), np.zeros(1, np.int64)) for kind in self.types]
            half = len(names) // 2  # some unit is not rendered byte by byte: find it
            return [_joined(x, y) for x, y in zip(self._new(names[:half]), self._new(names[half:]))]
        ends = 2 + np.r_[0, np.cumsum([len(u.encode()) for u in spaced])]
        out = []
        for ids, length, kind in zip((a, b), (self.length_a, self.length_b), self.types):
            ids = np.array(ids, kind)
            cuts = np.searchsorted(np.cumsum(length[ids]), ends) + 1
            out.append((ids[cuts[0]:], cuts[1:] - cuts[0]))
        return out

    def _learn(self, names: list[str]) -> None:
        for begin in range(0, len(names), UNITS_AT_ONCE):
            some = names[begin:begin + UNITS_AT_ONCE]
            for name in some:
                self.codes[name] = len(self.codes)
            self.fresh.append(self._new(some))

    def ids(self, texts: list[str | None]):
        """Per side (ids of all texts, number of each text's); texts without tokens have none."""
        if len(self.codes) > MEMO_UNITS:  # frequent units were met first: they stay
            kept = MEMO_UNITS // 2
            self.codes = dict(itertools.islice(self.codes.items(), kept))
            self.known = [(ids[:ends[kept]].copy(), ends[:kept + 1].copy()) for ids, ends in self.known]
        known, self.fresh = self.codes.get, []
        named = [() if not t or _OTHER_SPACE.search(t) or _RUN.search(t) else t.replace("\n", " \n").split(" ") for t in texts]
        found = [list(map(known, names)) for names in named]
        new: dict[str, None] = {}
        for names, got in zip(named, found):
            if None in got:
                new.update(dict.fromkeys([u for u, code in zip(names, got) if code is None]))
        if new:
            self._learn(list(new))
            known = self.codes.get
            found = [list(map(known, names)) if None in got else got for names, got in zip(named, found)]
            self.known = [_joined(*x) for x in zip(self.known, *self.fresh)]
        ends = self.known[0][1]
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, sum(map(len, found)))
        of = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        whole = {k for k, (t, names) in enumerate(zip(texts, named)) if t and not names}
        whole |= set(np.unique(of[ends[flat + 1] == ends[flat]]).tolist())
        tables = self.known
        if whole:  # in one piece: units of this call alone
            got = {k: self.encode(texts[k]) for k in sorted(whole)}
            extra = {k: len(ends) - 1 + n for n, k in enumerate(x for x in got if got[x])}
            found = [([extra[k]] if k in extra else []) if k in whole else x for k, x in enumerate(found)]
            flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, sum(map(len, found)))
            of = np.repeat(np.arange(len(texts)), [len(x) for x in found])
            tables = [_joined(table, *((got[k][side], np.array([len(got[k][side])])) for k in extra))
                      for side, table in enumerate(self.known)]
        out = []
        for ids, ends in tables:
            counts = (ends[1:] - ends[:-1])[flat]
            out.append((ids[np.repeat(ends[flat], counts) + _spans(counts)],
                        np.bincount(of, weights=counts, minlength=len(texts)).astype(np.int64)))
        return out


def _joined(*parts):
    """(ids, ends) of lists of lists, one after another; the first has a leading zero among its ends or none has."""
    shift = np.cumsum([0] + [len(ids) for ids, _ in parts])
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([ends + n for (_, ends), n in zip(parts, shift)])


_PAIRS: dict[tuple, Pair] = {}


def tokenizers(path_a: str, path_b: str) -> Pair:
    """The worker's tokenizers (loaded once per Python worker)."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


_IDS = pa.schema([("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def _parts(batches, size_of, most: int):
    """Slices of batches of at most about ``most`` (by ``size_of`` its last column), or one row."""
    for batch in batches:
        total = np.cumsum(size_of(batch.column(batch.num_columns - 1)))
        begin = 0
        while begin < batch.num_rows:
            done = int(total[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _bytes_of(column) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _tokenise(path_a: str, path_b: str):
    def emit(batches):
        pair = tokenizers(path_a, path_b)
        for part in _parts(batches, _bytes_of, CHARS_AT_ONCE):
            sides = []
            for ids, counts in pair.ids(part.column(1).to_pylist()):
                ends = (ids.itemsize * np.r_[0, np.cumsum(counts)]).astype(np.int32)
                sides.append(pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)]))
            yield pa.RecordBatch.from_arrays([part.column(0), *sides], schema=_IDS)
    return emit


def _spans(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def _merged(group: np.ndarray, ids: np.ndarray, large: np.ndarray, size: int):
    """(group, id, times): the equal ids of a large group as one row."""
    times = np.ones(len(ids), np.int64)
    if not large.any():
        return group, ids, times
    some = large[group]
    key, again = np.unique(group[some] * size + ids[some], return_counts=True)
    group, ids, times = (np.r_[x[~some], y] for x, y in ((group, key // size), (ids, key % size), (times, again)))
    by = np.argsort(group, kind="stable")
    return group[by], ids[by], times[by]


class Aligned:
    """The alignment of a batch of (doc_id, a, b): groups and links of every document."""

    def __init__(self, pair: Pair, batch):
        (self.a, size_a), (self.b, size_b) = (self._ids(batch.column(k + 1), kind) for k, kind in enumerate(pair.types))
        self.pair, self.n_a, self.n_b = pair, size_a, size_b
        ends_a, ends_b = np.cumsum(pair.length_a[self.a]), np.cumsum(pair.length_b[self.b])
        at = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, np.int8)
        at[ends_a] = 1
        self.last_b = at[ends_b] == 1
        at[ends_b] += 1
        self.last_a = at[ends_a] == 2
        self.group_a, self.group_b = (np.cumsum(last) - last for last in (self.last_a, self.last_b))
        self.n_all = int(self.last_a.sum())
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=self.n_all), np.bincount(self.group_b, minlength=self.n_all)
        self.doc_ends = np.r_[0, np.cumsum(self.last_a)][np.r_[0, np.cumsum(size_a)]]  # groups of the documents so far

    @staticmethod
    def _ids(column, kind: str):
        ids = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)
        return ids, pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize

    def links(self):
        """(pair, times, where the links of each document begin and the last end)."""
        large = self.in_a * self.in_b > LARGE_GROUP
        group_a, a, times_a = _merged(self.group_a, self.a, large, self.pair.size_a)
        group_b, b, times_b = _merged(self.group_b, self.b, large, self.pair.size_b)
        in_b = np.bincount(group_b, minlength=self.n_all)
        first_b = np.cumsum(in_b) - in_b
        partners = in_b[group_a]
        partner = np.repeat(first_b[group_a], partners) + _spans(partners)
        pairs = np.repeat(a * self.pair.size_b, partners) + b[partner]
        times = np.repeat(times_a, partners) * times_b[partner] if large.any() else np.ones(len(pairs), np.int64)
        ends = np.r_[0, np.cumsum(partners)][np.searchsorted(group_a, self.doc_ends)]
        return pairs, times, ends

    def spelled(self) -> list[str]:
        """The sha256 of every document's groups; the empty text without tokens."""
        size = max(self.pair.size_a, self.pair.size_b)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        before_b, before_a = np.cumsum(self.in_b) - self.in_b, np.cumsum(self.in_a)
        order[np.arange(len(self.a)) + before_b[self.group_a]] = self.a + size * self.last_a
        order[np.arange(len(self.b)) + before_a[self.group_b]] = self.b + 2 * size * self.last_b
        text = self.pair.spelled.take(pa.array(order))
        starts = np.r_[0, np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))]
        ends = starts[np.r_[0, np.cumsum(self.n_a + self.n_b)]].tolist()
        raw = memoryview(text.buffers()[2] or b"")
        return [hashlib.sha256(raw[i:j - 1]).hexdigest() if j > i else "" for i, j in zip(ends[:-1], ends[1:])]


def _aligned(batches, pair: Pair):
    for part in _parts(batches, _bytes_of, BYTES_AT_ONCE):
        yield part, Aligned(pair, part)


def _distinct_pairs(path_a: str, path_b: str):
    def emit(batches):
        found = np.empty(0, np.int64)
        for _, aligned in _aligned(batches, tokenizers(path_a, path_b)):
            found = pd.unique(np.r_[found, pd.unique(aligned.links()[0])])
        for begin in range(0, len(found), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(found[begin:begin + (1 << 16)])], ["pair"])
    return emit


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    keys = np.sort(rows["pair"].to_numpy())
    made = PerfectHash.of(keys)
    in_order = np.empty(len(keys), "<i8")
    in_order[made.index(keys)] = keys
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "sizes": [made.sizes.astype("<i8").tobytes()],
                         "bits": [made.bits.astype("<u8").tobytes()], "keys": [in_order.tobytes()]})


class Shards:
    """Some shards' functions side by side: one index over all their pairs."""

    def __init__(self, rows, n_shards: int):
        self.n_shards, self.shards, self.total = n_shards, [], 0
        keys = []
        for row in rows:
            own = np.frombuffer(row["keys"], "<i8")
            made = PerfectHash(np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["bits"], "<u8"))
            self.shards.append((row["shard"], self.total, made))
            keys.append(own)
            self.total += len(own)
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.counts = self.best = None

    def index(self, pairs: np.ndarray) -> np.ndarray:
        """Index of each pair; -1 for pairs of other shards."""
        code, pairs = pd.factorize(pairs)
        out = np.full(len(pairs), -1, np.int64)
        shard = pairs % self.n_shards
        for number, base, made in self.shards:
            at = np.flatnonzero(shard == number)
            found = base + made.index(pairs[at])
            found[self.keys[found] != pairs[at]] = -1
            out[at] = found
        return out[code]


def _count(path_a: str, path_b: str, shared):
    def emit(batches):
        shards = shared.value
        counts = np.zeros(shards.total + 1, np.int64)  # the last place takes pairs of other shards
        for _, aligned in _aligned(batches, tokenizers(path_a, path_b)):
            pairs, _, ends = aligned.links()
            index = shards.index(pairs)
            for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                at = index[begin:end]
                counts[at] = counts[at] + 1  # once per document, however often it is linked
        part = TaskContext.get().partitionId()
        for block, begin in enumerate(range(0, shards.total, BLOCK)):
            some = counts[begin:min(begin + BLOCK, shards.total)]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part], pa.int64()), pa.array([_packed(some)])],
                                                 ["block", "part", "counts"])
    return emit


def _packed(counts: np.ndarray) -> bytes:
    raw = counts.astype("<i8").tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True), "<i8")


def _sum_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    total = _unpacked(rows["counts"].iloc[0]).copy()
    for data in rows["counts"].iloc[1:]:
        total += _unpacked(data)
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "part": [rows["part"].iloc[0]], "counts": [_packed(total)]})


def tree_sum(vectors: DataFrame) -> DataFrame:
    """Sum the vectors of all parts block by block, at most ``FAN_IN`` of them in one task's hands."""
    ddl = "block long, part long, counts binary"
    most = vectors.agg(F.max("part")).first()[0]
    while most is not None:
        vectors = (vectors.withColumn("part", F.floor(F.col("part") / FAN_IN))
                   .groupBy("block", "part").applyInPandas(_sum_blocks, ddl))
        if most < FAN_IN:
            break
        most //= FAN_IN
        vectors = stored(vectors, "align-sums")
    return vectors


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                   ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _look_up(path_a: str, path_b: str, shared):
    def emit(batches):
        pair, shards = tokenizers(path_a, path_b), shared.value
        counts = np.r_[shards.counts, 0]  # the last place is that of pairs of other shards
        best = np.r_[shards.counts == shards.best[shards.keys // pair.size_b], False]
        for part, aligned in _aligned(batches, pair):
            pairs, times, ends = aligned.links()
            index = shards.index(pairs)

            def per_text(values, ends):
                return pa.array(np.diff(np.r_[0, np.cumsum(values)][ends]).astype(np.int64))

            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(aligned.n_a), pa.array(aligned.n_b), pa.array(np.diff(aligned.doc_ends)),
                 per_text(times, ends), per_text(times * best[index], ends), per_text(times * counts[index], ends),
                 pa.array(aligned.spelled(), pa.string())], schema=_ROWS)
    return emit


def pair_shards(ids: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, list[list[int]], int]:
    """(shards with their functions and keys, shard numbers by round, number of shards)."""
    pairs = stored(ids.mapInArrow(_distinct_pairs(path_a, path_b), "pair long").distinct(), "align-pairs")
    n_shards = -(-pairs.count() // SHARD_PAIRS) | 1
    built = (pairs.withColumn("shard", F.pmod("pair", F.lit(n_shards))).groupBy("shard")
             .applyInPandas(_build_shard, "shard long, sizes binary, bits binary, keys binary"))
    rounds = math.ceil(n_shards / ROUND_SHARDS)
    return stored(built, "align-shards"), [list(range(k, n_shards, rounds)) for k in range(rounds)], n_shards


def _of_round(built: DataFrame, numbers: list[int], n_shards: int) -> Shards:
    """The functions of one round: as many pairs as ``ROUND_SHARDS`` shards hold."""
    return Shards(sorted(built.where(F.col("shard").isin(numbers)).collect(), key=lambda r: r["shard"]), n_shards)


def _vector(summed: DataFrame, total: int) -> np.ndarray:
    """One round's counts by index: bounded as its shards are."""
    counts = np.zeros(total, np.int64)
    for row in summed.collect():
        some = _unpacked(row["counts"])
        counts[row["block"] * BLOCK:row["block"] * BLOCK + len(some)] = some
    return counts


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document of (doc_id, text): tokens, groups, links, links to the A id's most frequent partners, and the
    sum of the links' counts."""
    spark = docs.sparkSession
    prepare(spark)
    ids = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                 .mapInArrow(_tokenise(path_a, path_b), "doc_id long, a binary, b binary"), "align-ids")
    built, rounds, n_shards = pair_shards(ids, path_a, path_b)
    size_a, size_b = tokenizers(path_a, path_b).size_a, tokenizers(path_a, path_b).size_b
    counted, best = [], np.zeros(size_a, np.int64)
    for numbers in rounds:
        shards = _of_round(built, numbers, n_shards)
        shared = spark.sparkContext.broadcast(shards)
        vectors = stored(ids.mapInArrow(_count(path_a, path_b, shared), "block long, part long, counts binary"), "align-counts")
        summed = stored(tree_sum(vectors).select("block", "counts"), "align-counts")
        np.maximum.at(best, shards.keys // size_b, _vector(summed, shards.total))
        counted.append((numbers, summed))
        shared.unpersist()
    ddl = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    rows = None
    for numbers, summed in counted:
        shards = _of_round(built, numbers, n_shards)
        shards.counts, shards.best = _vector(summed, shards.total), best
        found = ids.mapInArrow(_look_up(path_a, path_b, spark.sparkContext.broadcast(shards)), ddl)
        rows = found if rows is None else rows.unionAll(found)
    if len(rounds) == 1:
        return rows
    # equal rows of a round stay equal in all rounds: add the rounds up and give each of the copies its share
    same = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    summed = rows.groupBy(*same).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.count("*").alias("n"))
    copies = (F.col("n") / len(rounds)).cast("long")
    return (summed.select(*same, F.floor(F.col("n_best") / copies).alias("n_best"), F.floor(F.col("count_sum") / copies).alias("count_sum"),
                          F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
