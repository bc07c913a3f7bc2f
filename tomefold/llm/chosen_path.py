"""Operator 4: n-gram Jaccard join by chosen paths.

Method: a text is the set of its shingles (five consecutive words; a shorter text with any
word is one shingle).  Sets are embedded by ``COORDINATES`` minhashes: token i of a set is
its i-th minhash, and two sets share it with the probability of their Jaccard similarity.
A run sends every set down a path of sampled tokens: all sets of a bucket that agree on
the sampled token share the next bucket.  Buckets of at most ``SMALL`` sets are compared
by brute force.  Larger ones are first compared with a pivot, their smallest set: sets that
look similar get an edge to it, and those that look ``SAME`` drop out, since by the
triangle inequality of the Jaccard distance whatever is at least ``THRESHOLD`` similar to
such a set looks similar to the pivot too and has that edge.  The rest and the pivot are
split further, each by a sampled token of its own; a bucket whose sets all look similar to
the pivot is connected and done.  What is still large after ``LEVELS``
splits is compared in its task without copying a row (up to ``MEDIUM`` sets), or in pairs of
blocks beyond, so no size is left out.  Runs start from different coordinates and repeat until
the target recall: a pair at the threshold is missed by one run with probability
``1 - threshold**PATH`` at most when its path is ``PATH`` tokens long.

Brute force inside buckets compares 8-bit sketches of the minhashes and connects sets that
look similar (``LOOKS``, about five standard deviations below the threshold).  An exact
check follows: the sets of each connected group are compared by their whole shingle sets,
in blocks, which yields every link inside the group, its number per document, and the
classes.  No pair is ever emitted: tasks emit link counts and one edge to a root per set.

Exact copies (equal shingle sets) are one set with a number of copies throughout.

Scale: sketches are a narrow table, texts are shuffled once (for the exact check), buckets
and groups are bounded or split into blocks.

Defined cases: texts without a word (null, empty, blank) are copies of one another; null
doc_ids are allowed, and the class id of a class is its smallest doc_id (null if it has
none); repeated rows are copies; an empty table gives an empty result; other columns are
ignored.  Sets are named by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomefold.llm.common import prepare, stored
from tomefold.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.99999
COORDINATES = 128
LOOKS = 0.62
SAME = 0.95
PATH = 3
SMALL = 4096
MEDIUM = 8192
LEVELS = 4
BLOCK = 128
MEMO = 300_000
TOKENS_AT_ONCE = 4096

_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_MULTIPLIERS = np.random.default_rng(5).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_word_hashes: dict[str, int] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = _WORD.findall(text or "")
    if not words:
        return np.empty(0, np.uint64)
    known = _word_hashes
    if len(known) > MEMO:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    h = np.array([known[w] for w in words], dtype=np.uint64)
    size = min(size, len(words))
    total = h[:len(h) - size + 1].copy()
    for j in range(1, size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - size + 1 + j]
    return np.unique(_mixed(total))


def minhashes(tokens: np.ndarray) -> np.ndarray:
    """The smallest value of each coordinate, its upper 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(tokens), TOKENS_AT_ONCE):
        least = np.minimum(least, np.multiply.outer(_MULTIPLIERS, tokens[k:k + TOKENS_AT_ONCE]).min(axis=1))
    return (least >> np.uint64(32)).astype("<u4")


def runs_for(recall: float, threshold: float) -> int:
    """Runs until a pair at the threshold is met with probability ``recall`` on paths of ``PATH`` tokens."""
    return min(COORDINATES, math.ceil(math.log(1 - recall) / math.log(1 - threshold ** PATH)))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("set_id", pa.int64()), ("size", pa.int32()),
                       ("mins", pa.binary()), ("sketch", pa.binary())])


def _sketch(batches):
    for batch in batches:
        rows = []
        for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            tokens = shingle_set(text.as_py())
            mins = minhashes(tokens)
            rows.append((doc_id, text_hash, _signed(xxhash.xxh64_intdigest(tokens.tobytes())), len(tokens),
                         mins.tobytes(), mins.astype(np.uint8).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SKETCHED)], schema=_SKETCHED)


def _bytes_matrix(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


_MEMBERS = pa.schema([("bucket", pa.int64()), ("set_id", pa.int64())])


def _first_buckets(runs: int):
    """Buckets of all runs after the first sampled token."""
    first = np.random.default_rng(17).permutation(COORDINATES)

    def spread(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            mins = _bytes_matrix(batch.column(1), "<u4", COORDINATES)
            for run in range(runs):
                start = _mixed(np.array([run + 1], np.uint64))
                at = int(first[run])
                bucket = _mixed((mins[:, at].astype(np.uint64) << np.uint64(8)) ^ start)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(ids)], schema=_MEMBERS)
    return spread


_SPLIT = pa.schema([("bucket", pa.int64()), ("set_id", pa.int64()), ("child", pa.int64()), ("pivot", pa.int64()),
                    ("near", pa.bool_()), ("same", pa.bool_())])


def _split(batches):
    """(bucket, set_id, mins, sketch, pivot, pivot_sketch): compare with the pivot and sample the next token."""
    for batch in batches:
        bucket = batch.column(0).to_numpy().view(np.uint64)
        mins = _bytes_matrix(batch.column(2), "<u4", COORDINATES)
        same = (_bytes_matrix(batch.column(3), np.uint8, COORDINATES)
                == _bytes_matrix(batch.column(5), np.uint8, COORDINATES)).mean(axis=1)
        sampled = _mixed(bucket + np.uint64(1))
        token = mins[np.arange(len(bucket)), (sampled % np.uint64(COORDINATES)).astype(np.int64)].astype(np.uint64)
        child = _mixed((token << np.uint64(8)) ^ sampled)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(child.view(np.int64)),
                                          batch.column(4), pa.array(same >= LOOKS), pa.array(same >= SAME)], schema=_SPLIT)


def _groups(batches, columns: int):
    """Whole groups of consecutive rows with an equal first column, several at a time."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = part.column(0).to_numpy()
        last = int(np.searchsorted(-(keys == keys[-1]).astype(np.int8)[::-1], 0)) if len(keys) else 0
        cut = len(keys) - last
        if cut:
            yield part.slice(0, cut).combine_chunks()
        held = part.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _smallest_reachable(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index connected with each of ``n`` nodes."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _similar_in_buckets(batches):
    """(bucket, set_id, sketch) sorted by bucket: an edge to the group's root for each similar set."""
    for part in _groups(batches, 3):
        bucket, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
        sketch = _bytes_matrix(part.column(2), np.uint8, COORDINATES)
        lefts, rights, apart = [], [], 1
        at = np.arange(len(bucket))
        while True:
            at = at[at + apart < len(bucket)]
            at = at[bucket[at] == bucket[at + apart]]
            if not len(at):
                break
            for k in range(0, len(at), 1 << 16):
                some = at[k:k + (1 << 16)]
                hit = some[(sketch[some] == sketch[some + apart]).mean(axis=1) >= LOOKS]
                lefts.append(hit)
                rights.append(hit + apart)
            apart += 1
        if lefts:
            root = _smallest_reachable(len(ids), np.concatenate(lefts), np.concatenate(rights))
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], schema=_EDGES)


def _in_blocks(big: DataFrame) -> DataFrame:
    """Buckets too large for one task as pairs of blocks, each a bucket of its own."""
    n_blocks = F.ceil(F.col("n") / SMALL).cast("int")
    own = F.pmod(F.xxhash64("set_id"), n_blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda j: F.xxhash64(
        F.col("bucket"), F.least(own, j), F.greatest(own, j)))
    return big.select(F.explode(pairs).alias("bucket"), "set_id")


def similar_groups(sets: DataFrame, runs: int) -> DataFrame:
    """(node, root): sets connected by looking similar in some bucket of some run."""
    sizes_of = lambda rows: rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rows = stored(sets.select("set_id", "mins").mapInArrow(_first_buckets(runs), "bucket long, set_id long"), "path-rows")
    edges, small = [], []
    for level in range(LEVELS + 1):
        members = stored(rows.join(sizes_of(rows), "bucket"), "path-members")
        if level == LEVELS:
            small.append(members.where(F.col("n") <= MEDIUM).select("bucket", "set_id"))
            small.append(_in_blocks(members.where(F.col("n") > MEDIUM)))
            break
        small.append(members.where(F.col("n") <= SMALL).select("bucket", "set_id"))
        large = members.where(F.col("n") > SMALL)
        if not large.limit(1).count():
            break
        wide = large.select("bucket", "set_id").join(sets.select("set_id", "mins", "sketch"), "set_id")
        pivots = (large.groupBy("bucket").agg(F.min("set_id").alias("pivot"))
                  .join(sets.select(F.col("set_id").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot"))
        split = stored(wide.join(pivots, "bucket").select("bucket", "set_id", "mins", "sketch", "pivot", "pivot_sketch")
                       .mapInArrow(_split, "bucket long, set_id long, child long, pivot long, near boolean, same boolean"), "path-split")
        edges.append(split.where("near").select(F.col("set_id").alias("a"), F.col("pivot").alias("b")))
        # the pivot stands for those that look the same; a bucket whose sets are all near it is connected and done
        rest = split.where(~F.col("same") | (F.col("set_id") == F.col("pivot")))
        unlike = split.where(~F.col("near")).select("bucket").distinct()
        rows = rest.join(unlike, "bucket", "left_semi").select(F.col("child").alias("bucket"), "set_id")
    todo = small[0]
    for more in small[1:]:
        todo = todo.union(more)
    compared = (todo.join(sets.select("set_id", "sketch"), "set_id").select("bucket", "set_id", "sketch")
                .repartition("bucket").sortWithinPartitions("bucket", "set_id"))
    edges.append(compared.mapInArrow(_similar_in_buckets, "a long, b long"))
    every = edges[0]
    for more in edges[1:]:
        every = every.union(more)
    return components(every)


_DEALT = pa.schema([("group", pa.int64()), ("cross", pa.int32()), ("set_id", pa.int64()), ("copies", pa.int64()),
                    ("tokens", pa.binary())])


def _deal(batches):
    """(set_id, root, copies, members, text): the set's tokens, once per pair of blocks of its group."""
    for batch in batches:
        rows = []
        for set_id, root, copies, members, text in zip(*(c.to_pylist() for c in batch.columns)):
            block = max(BLOCK, 2 * math.isqrt(members))
            n_blocks = -(-members // block)
            tokens = shingle_set(text)
            own = int(_mixed(np.array([set_id & (1 << 64) - 1], np.uint64))[0] % n_blocks)
            for other in range(n_blocks):
                low, high = min(own, other), max(own, other)
                group = xxhash.xxh64_intdigest(b"%d %d %d" % (root, low, high))
                rows.append((_signed(group), 0 if low == high else 1 + (own == high), set_id, copies, tokens.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DEALT)], schema=_DEALT)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; tokens of one set only are left out first."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[code] > 1
    owner, code = owner[keep], np.cumsum(times > 1)[code[keep]] - 1
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, TOKENS_AT_ONCE):
        a, b = np.searchsorted(code, [first, first + TOKENS_AT_ONCE])
        held = np.zeros((len(sets), TOKENS_AT_ONCE), np.float32)
        held[owner[a:b], code[a:b] - first] = 1
        held = held[:, :int(code[b - 1]) - first + 1]
        shared += held @ held.T
    return shared.astype(np.int64)


_LINKS = pa.schema([("set_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _verify(threshold: float):
    per_mille = round(threshold * 1000)

    def verify(batches):
        for part in _groups(batches, 5):
            keys = part.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            cross, ids, copies = (part.column(k).to_numpy() for k in (1, 2, 3))
            tokens = part.column(4)
            out = []
            for begin, end in zip(edges[:-1], edges[1:]):
                own, at = np.unique(ids[begin:end], return_index=True)  # a repeated row comes twice
                if len(own) < 2:
                    continue
                side, weight = cross[begin:end][at], copies[begin:end][at]
                sets = [np.frombuffer(tokens[begin + int(k)].as_py(), np.uint64) for k in at]
                size = np.array([len(s) for s in sets])
                shared = shared_counts(sets)
                like = 1000 * shared >= per_mille * (size[:, None] + size[None, :] - shared)
                np.fill_diagonal(like, False)
                if side[0]:
                    like &= side[:, None] != side[None, :]
                left, right = np.nonzero(like)
                if len(left):
                    root = _smallest_reachable(len(own), left, right)
                    links = like @ weight
                    out += [(int(own[k]), int(links[k]), int(own[root[k]])) for k in np.unique(left)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _LINKS)], schema=_LINKS)
    return verify


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_hash, class_id, n_links, rep_hash) of every document.

    ``class_id`` is the smallest doc_id of the connected class, ``n_links`` the number of
    other documents at least ``threshold`` similar (copies count each), ``rep_hash`` the
    text hash of the class's first document.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
                       "text")
    ddl = "doc_id long, text_hash long, set_id long, size int, mins binary, sketch binary"
    sketched = stored(docs.mapInArrow(_sketch, ddl), "path-sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("hash"))
    sets = stored(sketched.groupBy("set_id").agg(
        F.count("*").alias("copies"), F.min(first).alias("rep"), F.first("size").alias("size"),
        F.first("mins").alias("mins"), F.first("sketch").alias("sketch")), "path-sets")
    groups = similar_groups(sets.where(F.col("size") > 0), runs_for(recall, threshold))
    groups = stored(groups.select(F.col("node").alias("set_id"), "root"), "path-groups")
    members = groups.groupBy("root").agg(F.count("*").alias("members"))
    wanted = (groups.join(members, "root").join(sets.select("set_id", "copies", "rep"), "set_id")
              .select("set_id", "root", "copies", "members", F.col("rep.doc_id").alias("rep_id"), F.col("rep.hash").alias("rep_hash")))
    texts = docs.join(wanted, (F.col("text_hash") == F.col("rep_hash")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    dealt = (texts.select("set_id", "root", "copies", "members", "text")
             .mapInArrow(_deal, "group long, cross int, set_id long, copies long, tokens binary")
             .repartition("group").sortWithinPartitions("group", "set_id"))
    links = stored(dealt.mapInArrow(_verify(threshold), "set_id long, links long, root long"), "path-links")

    classes = stored(components(links.select(F.col("set_id").alias("a"), F.col("root").alias("b"))), "path-classes")
    counted = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    of_sets = (sets.select("set_id", "copies", "rep").join(classes.withColumnRenamed("node", "set_id"), "set_id", "left")
               .join(counted, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    of_sets = stored(of_sets, "path-of-sets")
    reps = of_sets.where(F.col("root") != F.col("set_id")).select("root", "rep").union(
        of_sets.join(classes.select(F.col("root").alias("set_id")).distinct(), "set_id", "left_semi").select(
            F.col("set_id").alias("root"), "rep"))
    reps = reps.groupBy("root").agg(F.min("rep").alias("class_rep"))
    result = stored(of_sets.join(reps, "root", "left").select(
        "set_id", F.coalesce("class_rep", "rep").alias("rep"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "path-result")
    return sketched.select("doc_id", "text_hash", "set_id").join(result, "set_id").select(
        "doc_id", "text_hash", F.col("rep.doc_id").alias("class_id"), "n_links", F.col("rep.hash").alias("rep_hash"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class: the one whose id names it; a repeated row stays once."""
    names = {c: f"_{i}_{c}" for i, c in enumerate(docs.columns)}
    classes = jaccard_classes(docs, threshold)
    firsts = classes.select(F.col("class_id").alias("_class"), F.col("rep_hash").alias("_rep")).distinct()
    wide = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn(
        "_hash", F.xxhash64(F.coalesce(F.col(names["text"]), F.lit("")))).withColumn(
        "_id", F.col(names["doc_id"]).cast("long"))
    kept = wide.join(firsts, (F.col("_hash") == F.col("_rep")) & F.col("_id").eqNullSafe(F.col("_class")), "left_semi")
    turn = F.row_number().over(Window.partitionBy("_hash", "_id").orderBy("_hash"))  # equal id and text: few rows
    return kept.withColumn("_turn", turn).where(F.col("_turn") == 1).select(
        *[F.col(f"`{n}`").alias(c) for c, n in names.items()])
