"""Exact k-nearest-neighbour join by cosine similarity (J2) and an IVF
approximation (A7).

Scores are ``dot(q, x) / sqrt(|q|^2 |x|^2)`` computed in float64 and quantised
to 1e-9 (``floor(s * 1e9 + 0.5) / 1e9``) so that the ranking, ties broken by
item id, is the same on every engine and BLAS kernel.

Physical plans
--------------
* ``broadcast`` (query side within a checked size): the query matrix is
  shipped once to every executor; the item table is scanned in place by
  ``mapInArrow`` (no shuffle of items; the vector column becomes one numpy
  matrix per Arrow batch) and each partition keeps a running
  top-k per query.  A window ``row_number`` (planned as a partial + final
  ``WindowGroupLimit``) merges the per-partition lists.
* ``grid`` (both sides large): queries and items are hashed into blocks; every
  (query block, item block) pair is one cogroup task holding at most one block
  of each side, so no task ever needs a whole side.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

SCALE = 1e9
ANY_VERSION = -1
NO_MATCH = -2

# size bound for the broadcast plan (query rows x dims x 8 bytes)
MAX_BROADCAST_BYTES = 8 << 20
GRID_BLOCK_ROWS = 16384        # items screened in one go
GRID_BLOCK_BYTES = 32 << 20    # grid plan: float64 bytes of each side held by one group
SCREEN_ROWS = 2048             # queries screened in one go; no smaller blocks for the sake of more tasks
PAIRS_AT_ONCE = 1 << 16        # pairs scored in float64 in one go
TILE = 512                     # rows of each side of one float32 product, which stays in a core's cache
FLOOR_ROWS = 4096              # items that give a query without k items its first floor
TILE_GROUPS = 64               # of the items of a tile, for first floors
MAX_VERSIONS = 1000            # of the items, looked at by the driver
PROBES_AT_ONCE = 512           # queries whose probed cells are marked in one go

_OUT = TY.StructType([
    TY.StructField("qid", TY.LongType()),
    TY.StructField("item_id", TY.StringType()),
    TY.StructField("score", TY.DoubleType()),
])


def quantize(s: np.ndarray) -> np.ndarray:
    """Round scores to 1e-9 (the same arithmetic in every engine)."""
    return np.floor(s * SCALE + 0.5) / SCALE


def _scores(q: np.ndarray, q2: np.ndarray, x: np.ndarray) -> np.ndarray:
    x2 = np.einsum("ij,ij->i", x, x)
    denom = np.sqrt(np.outer(q2, x2))
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (q @ x.T) / denom
    s[~np.isfinite(s)] = -np.inf
    return quantize(s)


def _merge_topk(best_s, best_id, s, ids, k):
    """Keep the k best (score desc, id asc) per row across two candidate sets.

    Vectorised: everything above the row's k-th score is kept; only rows with a
    tie exactly at the cut choose among the tied ids in Python (smallest ids
    win).  The order inside the k kept entries is left to the final window.
    """
    if best_s is not None:
        s = np.concatenate([best_s, s], axis=1)
        ids = np.concatenate([best_id, ids], axis=1)
    n_rows, m = s.shape
    if m <= k:
        return s, ids
    kth = np.partition(s, m - k, axis=1)[:, m - k][:, None]
    above = s > kth
    tied = (s == kth) & np.isfinite(s)
    need = k - above.sum(axis=1)
    keep = above | tied
    over = np.nonzero(tied.sum(axis=1) > need)[0]
    for r in over:  # rare: more ties at the cut than places left
        cols = np.nonzero(tied[r])[0]
        chosen = sorted(cols, key=lambda j: ids[r, j] or "")[:need[r]]
        keep[r, cols] = False
        keep[r, chosen] = True
    key = np.where(keep, s, -np.inf)
    sel = np.argpartition(-key, k - 1, axis=1)[:, :k]
    out_s = np.take_along_axis(key, sel, axis=1)
    out_id = np.take_along_axis(np.asarray(ids, dtype=object), sel, axis=1)
    return out_s, out_id


class _TopK:
    """Running top-k per query over item blocks (score desc, item id asc).

    A product of unit float32 rows screens a block against each query's k-th score so far; only
    pairs that may reach it (``margin`` covers the rounding of the screen) are scored in float64.
    """

    def __init__(self, qids, qmat, qver, qmin, k):
        self.qids, self.qmat, self.qmin, self.k = qids, qmat, qmin, k
        self.q2 = np.einsum("ij,ij->i", qmat, qmat)
        usable = np.isfinite(self.q2) & (self.q2 > 0)
        self.unit = _unit32(qmat, np.where(usable, self.q2, 1))
        self.by_version = [(v, np.flatnonzero((qver == v) & usable)) for v in np.unique(qver)]
        self.margin = (qmat.shape[1] + 16) * 1.2e-7
        self.best_s = np.full((len(qids), k), -np.inf)
        self.best_id = np.full((len(qids), k), None, dtype=object)

    def add(self, x: np.ndarray, ids: np.ndarray, iv: np.ndarray, only: np.ndarray | None = None) -> None:
        """Score items against all queries, or those marked in ``only``."""
        x2 = np.einsum("ij,ij->i", x, x)
        keep = np.flatnonzero(np.isfinite(x2) & (x2 > 0))
        keep = keep[_least_copies(x[keep], ids[keep], iv[keep], self.k)]
        if not len(keep):
            return
        x, x2, ids, iv = x[keep], x2[keep], ids[keep], iv[keep]
        unit = _unit32(x, x2)
        for version, rows in self.by_version:
            rows = rows if only is None else rows[only[rows]]
            cols = np.arange(len(x)) if version == ANY_VERSION else np.flatnonzero(iv == version)
            if len(rows) and len(cols):
                some = unit[cols]
                for lo in range(0, len(rows), SCREEN_ROWS):
                    self._scan(rows[lo:lo + SCREEN_ROWS], some, x, x2, ids, cols)

    def _scan(self, rows, unit, x, x2, ids, cols) -> None:
        asked = self.unit[rows]
        floor = np.maximum(self.qmin[rows], self.best_s[rows].min(axis=1))
        lo, step = 0, len(cols)
        if not np.isfinite(self.best_s[rows]).all():
            if min(len(unit), FLOOR_ROWS) // TILE * TILE_GROUPS >= 4 * self.k:
                floor = np.maximum(floor, _first_floors(asked, unit[:FLOOR_ROWS], self.k) - self.margin)
            else:  # rows without k items yet let everything through: begin small, the floors rise as blocks double
                step = max(64, 4 * self.k)
        screen = (floor - self.margin).astype(np.float32)  # read for each tile, so it rises with the floors
        while lo < len(cols):
            for i, j in near_pairs(asked, unit[lo:lo + step], screen):
                j = cols[lo + j]
                scores = exact_scores(self.qmat, self.q2, rows[i], x, x2, j)
                good = scores >= floor[i]
                if good.any():
                    i = i[good]
                    self._merge(rows[i], ids[j[good]], scores[good])
                    i = np.unique(i)
                    floor[i] = np.maximum(floor[i], self.best_s[rows[i]].min(axis=1))
                    screen[i] = floor[i] - self.margin
            lo, step = lo + step, 2 * step

    def _merge(self, rows, ids, scores) -> None:
        """Take found items into the lists of their query rows: the k best of each by score, of equal ones by id."""
        found = np.unique(rows)
        line, place = np.nonzero(np.isfinite(self.best_s[found]))
        rows = np.concatenate([found[line], rows])
        scores = np.concatenate([self.best_s[found[line], place], scores])
        ids = np.concatenate([self.best_id[found[line], place], ids])
        order = np.lexsort((-scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        last = first + self.k - 1
        more = np.flatnonzero(np.append(first[1:], len(rows)) > last + 1)
        tied = np.zeros(len(first), bool)  # more equal scores at the cut than places left
        tied[more] = scores[last[more]] == scores[last[more] + 1]
        if tied.any():
            at = np.flatnonzero(tied[of])
            at = at[scores[at] == scores[last[of[at]]]]
            _, by_id = np.unique(np.array([v or "" for v in ids[at]], dtype=object), return_inverse=True)
            order = np.lexsort((by_id, of[at]))  # the places of a row's equal scores are one run: sorted in place
            ids[at] = ids[at[order]]
        keep = np.arange(len(rows)) - first[of] < self.k
        self.best_s[found] = -np.inf
        self.best_id[found] = None
        place = (np.arange(len(rows)) - first[of])[keep]
        self.best_s[rows[keep], place], self.best_id[rows[keep], place] = scores[keep], ids[keep]

    def result(self):
        rows_q, rows_k = np.nonzero(np.isfinite(self.best_s))
        if not len(rows_q):
            return None
        return (self.qids[rows_q].astype(np.int64), self.best_id[rows_q, rows_k], self.best_s[rows_q, rows_k])

    def batch(self) -> pa.RecordBatch:
        qids, ids, scores = self.result() or ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(list(ids), pa.string()),
                                           pa.array(scores, pa.float64())], names=["qid", "item_id", "score"])


def _tiles(a: np.ndarray, b: np.ndarray):
    """(row of ``a``, row of ``b``, product) of every tile of ``a @ b.T``; the next tile takes the product's place."""
    buffer = np.empty(TILE * TILE, np.float32)
    for r in range(0, len(a), TILE):
        some = a[r:r + TILE]
        for c in range(0, len(b), TILE):
            other = b[c:c + TILE]
            out = buffer[:len(some) * len(other)].reshape(len(some), len(other))
            yield r, c, np.matmul(some, other.T, out=out)


def near_pairs(a: np.ndarray, b: np.ndarray, floor: np.ndarray):
    """Places (in ``a``, in ``b``) of the float32 products that reach their row's floor, some rows of ``a`` at a time."""
    i, j, held, began = [], [], 0, 0
    reached = np.zeros(TILE * TILE + 8, bool)
    for r, c, s in _tiles(a, b):
        if held and (r != began or held > PAIRS_AT_ONCE):
            yield np.concatenate(i), np.concatenate(j)
            i, j, held = [], [], 0
        n, began = s.size, r
        np.greater_equal(s, floor[r:r + TILE, None], out=reached[:n].reshape(s.shape))
        reached[n:n + 8] = False
        eights = reached[:n + 8 - n % 8]
        words = np.flatnonzero(eights.view(np.uint64))  # most products are below: looked at eight at a time
        if len(words):
            word, bit = np.nonzero(eights.reshape(-1, 8)[words])
            at = words[word] * 8 + bit
            i.append(r + at // s.shape[1])
            j.append(c + at % s.shape[1])
            held += len(at)
    if held:
        yield np.concatenate(i), np.concatenate(j)


def _first_floors(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Per row of ``a`` a product that ``k`` rows of ``b`` reach: the k-th best of the maxima of ``TILE_GROUPS`` groups a tile."""
    b = b[:len(b) // TILE * TILE]
    best = np.empty((len(a), len(b) // TILE * TILE_GROUPS), np.float32)
    for r, c, s in _tiles(a, b):
        at = c // TILE * TILE_GROUPS
        np.max(s.reshape(len(s), -1, TILE_GROUPS), axis=1, out=best[r:r + len(s), at:at + TILE_GROUPS])
    return np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k].astype(np.float64)


def exact_scores(x: np.ndarray, x2: np.ndarray, i: np.ndarray, y: np.ndarray, y2: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Quantised cosine of the pairs (row ``i`` of ``x``, row ``j`` of ``y``), given their squared norms."""
    scores = np.empty(len(i))
    for at in range(0, len(i), PAIRS_AT_ONCE):
        ii, jj = i[at:at + PAIRS_AT_ONCE], j[at:at + PAIRS_AT_ONCE]
        scores[at:at + PAIRS_AT_ONCE] = quantize(np.einsum("ij,ij->i", x[ii], y[jj]) / np.sqrt(x2[ii] * y2[jj]))
    return scores


def _unit32(m: np.ndarray, norm2: np.ndarray) -> np.ndarray:
    return (m / np.sqrt(norm2)[:, None]).astype(np.float32)


def _least_copies(x: np.ndarray, ids: np.ndarray, iv: np.ndarray, k: int) -> np.ndarray:
    """Places of the items without those that k items of the same vector and version precede by id."""
    if len(x) <= k:
        return np.arange(len(x))
    rows = np.ascontiguousarray(np.column_stack([x, iv]))
    _, kind, count = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True, return_counts=True)
    drop = np.zeros(len(x), bool)
    for c in np.flatnonzero(count > k):
        at = np.flatnonzero(kind == c)
        drop[sorted(at, key=lambda p: ids[p] or "")[k:]] = True
    return np.flatnonzero(~drop)


def _versions(qversion) -> tuple[np.ndarray, dict[str, int]]:
    """(code of each query's version, codes); null and '' ask for any version."""
    named = [v if isinstance(v, str) and v != "" else None for v in qversion]
    codes = {v: i for i, v in enumerate(sorted({v for v in named if v is not None}))}
    return np.array([ANY_VERSION if v is None else codes[v] for v in named], dtype=np.int64), codes


def _item_arrays(items, dim: int, codes: dict[str, int]):
    """(mask of usable rows, matrix, ids, version codes) of an Arrow batch or table of items."""
    vec = _one(items.column("vector"))
    keep = pc.fill_null(pc.and_(pc.is_valid(vec), pc.equal(pc.list_value_length(vec), dim)), False)
    vec = vec.filter(keep)
    x = pc.list_flatten(vec).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    ids = _one(items.column("item_id")).filter(keep).to_numpy(zero_copy_only=False).astype(object)
    if codes and "version" in items.schema.names:
        iv = pd.Series(_one(items.column("version")).filter(keep).to_pylist(), dtype=object).map(codes).fillna(NO_MATCH).to_numpy(np.int64)
    else:
        iv = np.full(len(ids), NO_MATCH)
    return keep.to_numpy(zero_copy_only=False), x, ids, iv


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _arrow_kernel(qids, qmat, qver, qmin, k, version_codes):
    """mapInArrow function: the vector column becomes one (rows x dim) matrix
    without a Python object per row."""
    def run(batches):
        acc = _TopK(qids, qmat, qver, qmin, k)
        for rb in batches:
            _, x, ids, iv = _item_arrays(rb, qmat.shape[1], version_codes)
            acc.add(x, ids, iv)
        yield acc.batch()
    return run


def _rank(cands: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("item_id"))
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn(queries: DataFrame, items: DataFrame, k: int, *, min_score_col: str | None = None,
        default_min_score: float = -math.inf, plan: str = "auto",
        max_broadcast_bytes: int = MAX_BROADCAST_BYTES, block_rows: int | None = None) -> DataFrame:
    """Top-``k`` items per query by cosine similarity.

    queries: ``qid BIGINT, qvec ARRAY<FLOAT>`` and optional ``qversion`` (NULL or
    '' = any version) and a per-query score floor column.
    items: ``item_id STRING, vector ARRAY<FLOAT>`` and optional ``version``.
    Returns ``qid, item_id, score, rank`` (rank 1 = best; ties by item_id).
    """
    q = queries.filter(F.col("qvec").isNotNull())
    has_ver = "qversion" in queries.columns and "version" in items.columns
    qcols = [F.col("qid"), F.col("qvec"),
             (F.col("qversion") if has_ver else F.lit(None).cast("string")).alias("qversion"),
             (F.col(min_score_col) if min_score_col else F.lit(default_min_score)).cast("double").alias("qmin")]
    q = q.select(*qcols)
    icols = ["item_id", "vector"] + (["version"] if has_ver else [])
    it = items.select(*icols)

    if plan == "auto":
        n_q = q.count()
        dim = _dim_of(q)
        plan = "broadcast" if n_q * max(dim, 1) * 8 <= max_broadcast_bytes else "grid"
    if plan == "broadcast":
        return _rank(_broadcast_plan(q, it, k), k)
    return _rank(_grid_plan(q, it, k, block_rows), k)


def _dim_of(q: DataFrame) -> int:
    row = q.select(F.size("qvec").alias("d")).head(1)
    return int(row[0]["d"]) if row else 0


def _broadcast_plan(q: DataFrame, it: DataFrame, k: int) -> DataFrame:
    # the caller has checked the size bound; this is the broadcast side
    pdf = q.toPandas()
    if pdf.empty:
        return it.sparkSession.createDataFrame([], _OUT)
    qver, codes = _versions(pdf["qversion"])
    versions = list(codes)
    if "version" in it.columns and len(versions) and (qver != ANY_VERSION).all():
        # every query names its version(s): only those partitions are read
        it = it.filter(F.col("version").isin(versions))
    qmat = np.stack(pdf["qvec"].to_numpy()).astype(np.float64)
    payload = (pdf["qid"].to_numpy(np.int64), qmat, qver, pdf["qmin"].to_numpy(np.float64), codes)
    from ..session import _context
    sc = _context(it.sparkSession)
    bc = sc.broadcast(payload) if sc is not None else None  # Connect: travels with the function

    def run(batches):
        qids, qm, qv, qmin, cd = bc.value if bc is not None else payload
        yield from _arrow_kernel(qids, qm, qv, qmin, k, cd)(batches)

    # every kernel task emits up to k rows per query, so the merge shuffles
    # queries x k x tasks rows: read the items with about two tasks per core
    # (coalesce: no shuffle, a task reads several splits in turn)
    if sc is not None:
        it = it.coalesce(2 * sc.defaultParallelism)
    return it.mapInArrow(run, _OUT)


def _grid_plan(q: DataFrame, it: DataFrame, k: int, block_rows: int | None) -> DataFrame:
    """Every (query block, item block) pair is one cogroup task.

    Moving data costs ``items x query_blocks + queries x item_blocks`` rows, so
    blocks are as large as a group may hold (``GRID_BLOCK_BYTES`` of float64
    per side by default, ~65k rows at 64 dims) while their pairs keep every core
    busy, instead of replicating either side thousands of times.  Queries of a
    version that no item has stay where they are.
    """
    n_i = None
    if "version" in it.columns:
        held = it.groupBy("version").count().limit(MAX_VERSIONS + 1).collect()
        if len(held) <= MAX_VERSIONS:
            n_i = sum(r["count"] for r in held)
            q = q.filter((F.coalesce("qversion", F.lit("")) == "") | F.col("qversion").isin([r["version"] for r in held if r["version"] is not None]))
    n_q, n_i = q.count(), it.count() if n_i is None else n_i
    qb, ib = _block_counts(q.sparkSession, n_q, n_i, _dim_of(q), block_rows)
    # every query block meets every item block: replicate by the other side's count
    qg = (q.withColumn("qblk", F.pmod(F.xxhash64("qid"), F.lit(qb)))
           .withColumn("iblk", F.explode(F.sequence(F.lit(0), F.lit(ib - 1))))
           .withColumn("g", F.col("qblk") * ib + F.col("iblk")))
    ig = (it.withColumn("iblk", F.pmod(F.xxhash64("item_id"), F.lit(ib)))
            .withColumn("qblk", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
            .withColumn("g", F.col("qblk") * ib + F.col("iblk")))
    # few pairs and much work in each: enough partitions to keep them apart
    parts = 4 * qb * ib
    return (qg.repartition(parts, "g").groupBy("g").cogroup(ig.repartition(parts, "g").groupBy("g"))
            .applyInArrow(lambda a, b: _block_topk(a, b, k), _OUT))


def _block_counts(spark, n_q: int, n_i: int, dim: int, block_rows: int | None = None) -> tuple[int, int]:
    """(query blocks, item blocks): as few as a group may hold, yet pairs enough to keep every core busy."""
    rows = block_rows or max(1024, GRID_BLOCK_BYTES // (8 * max(dim, 1)))
    qb, ib = max(1, math.ceil(n_q / rows)), max(1, math.ceil(n_i / rows))
    from ..session import _context
    sc = _context(spark)
    side = math.ceil(math.sqrt(4 * sc.defaultParallelism)) if sc is not None and block_rows is None else 1
    return max(qb, min(side, math.ceil(n_q / SCREEN_ROWS))), max(ib, min(side, math.ceil(n_i / SCREEN_ROWS)))


def _block_topk(queries: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """Top-k of one (query block, item block) pair.

    With a ``cells`` column (see ``probe_blocks``) a query meets only the items of its marked cells."""
    vec = _one(queries.column("qvec"))
    dim = int(pc.max(pc.list_value_length(vec)).as_py() or 0)
    if pc.all(pc.equal(pc.list_value_length(vec), dim)).as_py() is False:
        raise ValueError("query vectors of different sizes")
    if not dim or not items.num_rows:
        return pa.Table.from_batches([_TopK(np.empty(0, np.int64), np.empty((0, 1)), np.empty(0, np.int64), np.empty(0), k).batch()])
    qver, codes = _versions(queries.column("qversion").to_pylist())
    qmat = pc.list_flatten(vec).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    top = _TopK(queries.column("qid").to_numpy().astype(np.int64), qmat, qver,
                queries.column("qmin").to_numpy().astype(np.float64), k)
    kept, x, ids, iv = _item_arrays(items, dim, codes)
    marks = queries.column("cells").to_pylist() if "cells" in queries.schema.names else []
    if all(m is None for m in marks):
        for lo in range(0, len(x), GRID_BLOCK_ROWS):
            top.add(x[lo:lo + GRID_BLOCK_ROWS], ids[lo:lo + GRID_BLOCK_ROWS], iv[lo:lo + GRID_BLOCK_ROWS])
    else:
        slot = items.column("slot").to_numpy()[kept]
        for s in np.unique(slot):
            only = np.array([m is None or bool(m[s >> 3] & (128 >> (s & 7))) for m in marks])
            for at in np.array_split(np.flatnonzero(slot == s), math.ceil((slot == s).sum() / GRID_BLOCK_ROWS)):
                top.add(x[at], ids[at], iv[at], only)
    return pa.Table.from_batches([top.batch()])


def pack_cells(sizes: dict[int, int], rows: int) -> tuple[list, list]:
    """([(cell, first block, blocks, slot)], places in it where a new block begins): whole cells packed into
    blocks of about ``rows`` rows, larger ones cut into several."""
    layout, first, held, starts = [], 0, 0, []
    for cell in sorted(sizes):
        parts = math.ceil(sizes[cell] / rows)
        if parts > 1 or not starts or layout[-1][2] > 1 or held + sizes[cell] > rows:
            first, held = (layout[-1][1] + layout[-1][2] if layout else 0), 0
            starts.append(len(layout))
        layout.append((cell, first, parts, len(layout) - starts[-1]))
        held += sizes[cell]
    return layout, starts


def blocks_of(group: np.ndarray, firsts: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks per entry of ``group``, all blocks in a row): a group has ``parts`` blocks from its first on."""
    times = parts[group]
    return times, np.repeat(firsts[group], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def probe_blocks(probes: DataFrame, items: DataFrame, sizes: dict[int, int], probe, k: int,
                 block_rows: int | None = None) -> DataFrame:
    """Top-k of every (query block, item block) over probed cells: (qid, item_id, score).

    probes: (qid, qvec, qversion, qmin and what ``probe`` reads); ``probe(batch, cells)`` gives the (rows x
    cells) matrix of the cells each row visits.  items: (item_id, vector, version, cell) of the cells in
    ``sizes`` (rows per cell; few enough for the driver).  Whole cells are packed into item blocks, larger
    ones cut by a hash, and a query travels once to a block with a bit per cell instead of once per cell.
    """
    spark = items.sparkSession
    n_q = probes.count()
    dim = _dim_of(probes)
    qb, ib = _block_counts(spark, n_q, sum(sizes.values()), dim, block_rows)
    if not n_q or not sizes:
        return spark.createDataFrame([], _OUT)
    layout, starts = pack_cells(sizes, math.ceil(sum(sizes.values()) / ib))
    cells = np.array([c[0] for c in layout])
    from ..session import _context
    sc = _context(spark)
    value = (cells, np.array(starts), np.array([layout[p][1] for p in starts]), np.array([layout[p][2] for p in starts]))
    shared = sc.broadcast(value) if sc is not None else None

    def visits(batches):
        cells, starts, firsts, parts = shared.value if shared is not None else value
        ends = np.append(starts[1:], len(cells))
        for whole in batches:
            for lo in range(0, whole.num_rows, PROBES_AT_ONCE):
                batch = whole.slice(lo, PROBES_AT_ONCE)
                marked = probe(batch, cells)
                some = np.logical_or.reduceat(marked, starts, axis=1)
                every = np.logical_and.reduceat(marked, starts, axis=1)
                row, group = np.nonzero(some)
                marks = [None if every[r, g] else np.packbits(marked[r, starts[g]:ends[g]]).tobytes() for r, g in zip(row, group)]
                times, block = blocks_of(group, firsts, parts)
                out = batch.select(["qid", "qvec", "qversion", "qmin"]).take(pa.array(np.repeat(row, times)))
                marks = pa.array(marks, pa.binary()).take(pa.array(np.repeat(np.arange(len(row)), times)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(block, pa.int32()), marks],
                                                 names=[*out.schema.names, "block", "cells"])

    kept = TY.StructType([probes.schema[c] for c in ("qid", "qvec", "qversion", "qmin")]
                         + [TY.StructField("block", TY.IntegerType()), TY.StructField("cells", TY.BinaryType())])
    left = probes.mapInArrow(visits, kept).withColumn("qblk", F.pmod(F.xxhash64("qid"), F.lit(qb)))
    places = spark.createDataFrame([tuple(int(v) for v in c) for c in layout], "cell int, first int, parts int, slot int")
    right = (items.join(places, "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("item_id"), "parts")).cast("int"))
             .withColumn("qblk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb - 1).cast("long")))))
    return (left.groupBy("block", "qblk")
            .cogroup(right.select("block", "qblk", "item_id", "vector", "version", "slot").groupBy("block", "qblk"))
            .applyInArrow(lambda a, b: _block_topk(a, b, k), _OUT))


# --------------------------------------------------------------------------- A7
def _unit(v):
    from ..functions.text import let
    return let(v, lambda a: let(F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)),
                                lambda n: F.transform(a, lambda x: x / n)))


def knn_ivf(queries: DataFrame, items: DataFrame, k: int, *, n_cells: int | None = None,
            n_probe: int = 8, block_rows: int | None = None, seed: int = 1,
            max_iter: int = 20, default_min_score: float = -math.inf) -> DataFrame:
    """Approximate top-k (A7): an inverted-file index.

    Cells are k-means centroids of all unit item vectors (``pyspark.ml``,
    distributed), ``sqrt(n)`` of them unless given.  Each query is scored only
    against the items of its ``n_probe`` nearest cells.  Cells are packed into
    blocks, larger ones split by a hash; the queries are split into blocks as
    well (``probe_blocks``), so neither a hot cell nor a popular probe lands in
    one task.  Scores are exact cosine for the
    items looked at; version filter and score floor are those of ``knn``.  The
    same path runs at every size: for exact answers call ``knn``.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = items.sparkSession
    has_ver = "qversion" in queries.columns and "version" in items.columns
    dim = _dim_of(queries.filter(F.col("qvec").isNotNull()))
    it = items.filter(F.size("vector") == dim).select(
        "item_id", "vector", (F.col("version") if has_ver else F.lit(None).cast("string")).alias("version"))
    seen = it.agg(F.count("*").alias("n"), F.countDistinct(F.xxhash64("vector")).alias("kinds")).first()
    cells = min(n_cells or int(math.sqrt(seen["n"])), seen["kinds"])  # k-means needs as many kinds as cells
    if cells < 2:  # one cell is the exact scan
        return knn(queries, items, k, default_min_score=default_min_score)
    feats = it.withColumn("features", array_to_vector(_unit(F.col("vector"))))
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, featuresCol="features",
                   predictionCol="cell").fit(feats)
    centers = np.array([c for c in model.clusterCenters()], dtype=np.float64)  # sqrt(n) x dim
    cells = len(centers)
    assigned = model.transform(feats).select("item_id", "vector", "version", "cell")

    sizes = {r["cell"]: r["n"] for r in assigned.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # sqrt(n) cells
    unit_centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)
    from ..session import _context
    sc = _context(spark)
    bc = sc.broadcast(unit_centers) if sc is not None else None
    probe_n = min(n_probe, cells)

    def probe(batch, held):
        c = bc.value if bc is not None else unit_centers
        if probe_n == len(c):
            return np.ones((batch.num_rows, len(held)), bool)
        q = pc.list_flatten(batch.column("qvec")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, c.shape[1])
        s = q @ c.T
        marked = np.zeros(s.shape, bool)
        np.put_along_axis(marked, np.argpartition(-s, probe_n - 1, axis=1)[:, :probe_n], True, axis=1)
        return marked[:, held]

    q = queries.filter(F.size("qvec") == dim).select(
        "qid", "qvec", (F.col("qversion") if has_ver else F.lit(None).cast("string")).alias("qversion"),
        F.lit(default_min_score).cast("double").alias("qmin"))
    return _rank(probe_blocks(q, assigned, sizes, probe, k, block_rows), k)
