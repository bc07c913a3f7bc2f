"""Stored inverted file of vectors (A7, R2) and exact threshold join (semantic near duplicates, D2).

Layout under a base folder on shared storage:

* ``items``: (item_id, vector, angle) partitioned by ``version`` and ``cell``; ``angle`` is
  that to the cell's centroid.  Appended rows go to the cell of the nearest stored centroid.
* ``stats``: rows and radius (largest angle) of each (version, cell) a run appended, written
  before its items, so a crash leaves radii too large, never too small.
* ``centroids``: the cells by generation; the latest counts.  ``split_cells`` replaces
  overgrown cells by smaller ones in a new generation; rows of cells that are no longer listed
  are not read.
* ``errors``: items whose vector is missing, of another size or without direction.

A search probes cells in the order of the best score an item in them could have, which the
triangle inequality bounds by the angle between query and centroid less the cell's radius.  It ends
when no cell left can reach a query's k-th score: the answer is exact, nothing is
fitted, and only the partitions of probed cells are read.

Centroids are fitted on at most ``SAMPLE_ROWS`` vectors and number at most ``MAX_CELLS``; both
bound what reaches the driver and the workers.  Every item is stored, whatever the sample.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..session import _context, ship_package, written
from . import knn as K

MAX_CELLS = 16384
SAMPLE_ROWS = 200_000
BLOCK_ROWS = 4096
ROW_CELLS = 1 << 20  # vectors x centroids compared at once (8 MB)
FIRST_PROBES = 4
MORE_PROBES = 16
PAIR_ROWS = 200_000  # rows moved to a task of the threshold join, about
SLACK = 1e-6  # on radii, for the rounding of angles

_CENTROID = "cell int, centroid array<double>, generation int"
_PAIR = TY.StructType([TY.StructField("a", TY.StringType()), TY.StructField("b", TY.StringType()),
                       TY.StructField("score", TY.DoubleType())])


def _unit_rows(vectors) -> np.ndarray:
    m = np.stack(list(vectors)).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _rows_at_once(centers: np.ndarray) -> int:
    """Vectors compared with all centroids in one go."""
    return max(1, min(BLOCK_ROWS, ROW_CELLS // max(1, len(centers))))


def fit_centroids(items: DataFrame, n_cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 1,
                  max_iter: int = 20) -> np.ndarray:
    """Unit centroids of k-means over a sample of usable item vectors: ``sqrt(n)`` of them unless given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    n = items.count()
    if n == 0:
        raise ValueError("no usable vector to fit centroids on")
    some = items.sample(min(1.0, sample_rows / n), seed) if n > sample_rows else items
    kinds = some.agg(F.countDistinct(F.xxhash64("vector"))).first()[0]
    cells = max(1, min(n_cells or int(math.sqrt(n)), MAX_CELLS, kinds))
    feats = written(some.select(array_to_vector(K._unit(F.col("vector"))).alias("features")), "cell-sample")
    if cells == 1:
        centers = [np.asarray(feats.first()["features"])]
    else:
        centers = KMeans(k=cells, seed=seed, maxIter=max_iter, initMode="random").fit(feats).clusterCenters()
    centers = np.unique(np.array([c for c in centers if np.linalg.norm(c) > 0], dtype=np.float64), axis=0)
    return centers / np.linalg.norm(centers, axis=1, keepdims=True)


def _shared(spark: SparkSession, value):
    sc = _context(spark)
    return sc.broadcast(value) if sc is not None else type("Local", (), {"value": value})()


def assign(items: DataFrame, numbers: np.ndarray, centers: np.ndarray) -> DataFrame:
    """``items`` with the ``cell`` of the nearest centroid and the ``angle`` to it."""
    shared = _shared(items.sparkSession, (numbers, centers))

    @F.pandas_udf("cell int, angle double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        numbers, centers = shared.value
        cells, angles = [], []
        step = _rows_at_once(centers)
        for k in range(0, len(vectors), step):
            likeness = _unit_rows(vectors.iloc[k:k + step]) @ centers.T
            np.clip(likeness, -1, 1, out=likeness)
            best = likeness.argmax(axis=1)
            cells.append(numbers[best])
            angles.append(np.arccos(likeness[np.arange(len(best)), best]))
        return pd.DataFrame({"cell": np.concatenate(cells), "angle": np.concatenate(angles)})

    near = nearest.asNondeterministic()
    return items.withColumn("_near", near("vector")).select(*items.columns, "_near.cell", "_near.angle")


def usable(items: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(items with a vector of ``dim`` numbers and a direction, error rows of the others)."""
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    problem = (F.when(F.col("vector").isNull(), "missing vector").when(F.size("vector") != dim, "wrong vector size")
               .when(F.coalesce(~(norm > 0) | F.isnan(norm) | (norm == float("inf")), F.lit(True)), "vector without direction"))
    marked = items.withColumn("error", problem)
    return marked.where(F.col("error").isNull()).drop("error"), marked.where(F.col("error").isNotNull()).select("item_id", "error")


# --------------------------------------------------------------------------- store
def create_cells(items: DataFrame, base: str, dim: int, n_cells: int | None = None, **fit) -> None:
    """A new store of ``items`` (item_id, vector, version) at ``base``."""
    spark = items.sparkSession
    ship_package(spark)
    good, _ = usable(items, dim)
    centers = fit_centroids(good, n_cells, **fit)
    _write_centroids(spark, base, [(k, c.tolist()) for k, c in enumerate(centers)], 0)
    append_cells(items, base)


def _write_centroids(spark: SparkSession, base: str, cells: list, generation: int) -> None:
    rows = [(int(k), [float(x) for x in c], generation) for k, c in cells]
    spark.createDataFrame(rows, _CENTROID).coalesce(1).write.mode("append").parquet(f"{base}/centroids")


def _centroids(spark: SparkSession, base: str) -> tuple[np.ndarray, np.ndarray, int]:
    rows = spark.read.schema(_CENTROID).parquet(f"{base}/centroids")
    last = rows.agg(F.max("generation")).first()[0]
    rows = sorted(rows.where(F.col("generation") == last).collect(), key=lambda r: r["cell"])  # at most MAX_CELLS
    return np.array([r["cell"] for r in rows], np.int32), np.array([r["centroid"] for r in rows]), last


def append_cells(items: DataFrame, base: str) -> None:
    """Add ``items`` (item_id, vector, version) to the cells of their nearest stored centroids."""
    spark = items.sparkSession
    ship_package(spark)
    numbers, centers, _ = _centroids(spark, base)
    good, bad = usable(items.select("item_id", "vector", "version"), centers.shape[1])
    _append(written(assign(good, numbers, centers), "cell-rows"), base)
    bad.write.mode("append").parquet(f"{base}/errors")


def _append(rows: DataFrame, base: str) -> None:
    (rows.groupBy("version", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
     .coalesce(1).write.mode("append").parquet(f"{base}/stats"))
    # a file per (version, cell) and task: rows of a cell come together first, large cells in several parts
    (rows.repartition("version", "cell", F.pmod(F.xxhash64("item_id"), F.lit(8)))
     .write.mode("append").partitionBy("version", "cell").parquet(f"{base}/items"))


def cell_stats(spark: SparkSession, base: str) -> DataFrame:
    """(cell, n, radius) of the live cells over all versions and runs."""
    numbers, _, _ = _centroids(spark, base)
    stats = spark.read.parquet(f"{base}/stats")
    return (stats.where(F.col("cell").isin([int(x) for x in numbers])).groupBy("cell")
            .agg(F.sum("n").alias("n"), F.max("radius").alias("radius")))


def read_items(spark: SparkSession, base: str) -> DataFrame:
    """The stored rows of all cells, live or not (see ``cell_stats``)."""
    return spark.read.parquet(f"{base}/items").withColumn("cell", F.col("cell").cast("int"))


def split_cells(spark: SparkSession, base: str, max_rows: int, seed: int = 1) -> int:
    """Replace every live cell of more than ``max_rows`` rows by smaller ones; how many were split.

    Run it between appends.  Rows and radii of the new cells are written first; the new
    generation of centroids, which makes them live and drops the old cells, comes last.
    """
    numbers, centers, generation = _centroids(spark, base)
    large = [r for r in cell_stats(spark, base).where(F.col("n") > max_rows).collect()]  # at most MAX_CELLS
    if not large:
        return 0
    keep = {int(k): c for k, c in zip(numbers, centers)}
    after = int(spark.read.parquet(f"{base}/stats").agg(F.max("cell")).first()[0]) + 1
    for row in large:
        own = read_items(spark, base).where(F.col("cell") == row["cell"])
        new = fit_centroids(own, math.ceil(row["n"] / max_rows) + 1, seed=seed)
        if len(new) < 2 or len(keep) + len(new) > MAX_CELLS:
            continue  # equal vectors, or no room: the search splits such a cell into blocks
        fresh = np.arange(after, after + len(new), dtype=np.int32)
        after += len(new)
        _append(written(assign(own.select("item_id", "vector", "version"), fresh, new), "cell-rows"), base)
        del keep[row["cell"]]
        keep.update({int(k): c for k, c in zip(fresh, new)})
    _write_centroids(spark, base, sorted(keep.items()), generation + 1)
    return len(large)


# --------------------------------------------------------------------------- search
def search_cells(queries: DataFrame, base: str, k: int, *, default_min_score: float = -math.inf,
                 block_rows: int | None = None, first_probes: int = FIRST_PROBES) -> DataFrame:
    """Exact top ``k`` stored items of ``queries`` (qid, qvec, optional qversion): (qid, item_id, score, rank).

    A query vector of another size than the store's fails the job.  Each round probes ``MORE_PROBES``
    times as many cells as the one before, for the queries that still need them.
    """
    spark = queries.sparkSession
    ship_package(spark)
    numbers, centers, _ = _centroids(spark, base)
    stats = cell_stats(spark, base).collect()  # at most MAX_CELLS
    radius, size = {r["cell"]: r["radius"] for r in stats}, {r["cell"]: r["n"] for r in stats}
    live = np.array([int(c) in radius for c in numbers])
    numbers, centers = numbers[live], centers[live]
    shared = _shared(spark, (numbers, centers, np.array([radius[int(c)] for c in numbers]) + SLACK))
    items = read_items(spark, base)
    version = F.col("qversion") if "qversion" in queries.columns else F.lit(None)
    sized = F.when(F.size("qvec") == centers.shape[1] if len(centers) else F.lit(True), F.col("qvec")).otherwise(
        F.raise_error(F.lit("a query vector has another size than the stored ones")))
    asked = written(queries.where(F.col("qvec").isNotNull()).select(
        "qid", sized.alias("qvec"), version.cast("string").alias("qversion"), F.lit(default_min_score).cast("double").alias("qmin")),
        "cell-queries")
    named = asked.agg(F.sum(F.when(F.coalesce("qversion", F.lit("")) == "", 1).otherwise(0)).alias("any")).first()["any"]
    if named == 0:  # every query names its version: only those partitions are read
        versions = [r[0] for r in asked.select("qversion").distinct().limit(1001).collect()]
        if len(versions) <= 1000:
            items = items.where(F.col("version").isin(versions))
    best, low, high = None, 0, first_probes
    while low < len(numbers):
        floor = F.col("qmin")
        todo = asked
        if best is not None:
            kth = best.where(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
            todo = asked.join(kth, "qid", "left")
            floor = F.greatest("qmin", F.coalesce("kth", F.lit(-math.inf)))
        todo = todo.select("qid", "qvec", "qversion", "qmin", floor.alias("floor"))
        probed = [r[0] for r in todo.select(F.explode_outer(_next_cells(shared, low, high)(F.col("qvec"), F.col("floor"))).alias("cell"))
                  .where(F.col("cell").isNotNull()).distinct().collect()]  # at most MAX_CELLS
        if not probed:
            break
        found = K.probe_blocks(todo, items.where(F.col("cell").isin(probed)), {c: size[c] for c in probed},
                               _prober(shared, low, high), k, block_rows)
        every = found if best is None else best.select("qid", "item_id", "score").unionByName(found)
        best = written(K._rank(every, k), "cell-best")
        low, high = high, MORE_PROBES * high
    return best if best is not None else K._rank(spark.createDataFrame([], K._OUT), k)


def _reached(vec: np.ndarray, floor: np.ndarray, centers: np.ndarray, radius: np.ndarray, low: int, high: int):
    """(cells ranked ``low`` to ``high`` by the best score they could hold, whether that reaches the floor), per row."""
    norm = np.linalg.norm(vec, axis=1, keepdims=True)
    usable = np.isfinite(norm[:, 0]) & (norm[:, 0] > 0)
    reach = np.where(usable[:, None], vec, 0) / np.where(usable[:, None], norm, 1) @ centers.T
    np.arccos(np.clip(reach, -1, 1, out=reach), out=reach)
    reach -= radius
    np.cos(np.maximum(reach, 0, out=reach), out=reach)
    reach += 2 / K.SCALE
    order = np.argsort(-reach, axis=1, kind="stable")[:, low:high]
    return order, (np.take_along_axis(reach, order, axis=1) >= floor[:, None]) & usable[:, None]


def _next_cells(shared, low: int, high: int):
    """Cells ranked ``low`` to ``high`` by the best score they could hold, as far as it reaches the floor."""
    @F.pandas_udf(TY.ArrayType(TY.IntegerType()))
    def cells(vectors: pd.Series, floor: pd.Series) -> pd.Series:
        numbers, centers, radius = shared.value
        out = []
        step = _rows_at_once(centers)
        for k in range(0, len(vectors), step):
            vec = np.stack(list(vectors.iloc[k:k + step])).astype(np.float64)
            order, enough = _reached(vec, floor.iloc[k:k + step].to_numpy(), centers, radius, low, high)
            out += [numbers[o[e]] for o, e in zip(order, enough)]
        return pd.Series(out, dtype=object)
    return cells.asNondeterministic()


def _prober(shared, low: int, high: int):
    """The cells of ``_next_cells`` as a matrix, for ``knn.probe_blocks``."""
    def probe(batch: pa.RecordBatch, held: np.ndarray) -> np.ndarray:
        numbers, centers, radius = shared.value
        marked = np.zeros((batch.num_rows, len(held)), bool)
        at = np.minimum(np.searchsorted(held, numbers), len(held) - 1)  # the place of each cell among the held ones
        known = held[at] == numbers
        step = _rows_at_once(centers)
        for k in range(0, batch.num_rows, step):
            some = batch.slice(k, step)
            vec = pc.list_flatten(some.column("qvec")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
            order, enough = _reached(vec, some.column("floor").to_numpy(zero_copy_only=False), centers, radius, low, high)
            row, place = np.nonzero(enough & known[order])
            marked[k + row, at[order[row, place]]] = True
        return marked
    return probe


# --------------------------------------------------------------------------- threshold join
def similar_pairs(items: DataFrame, min_score: float, dim: int, n_cells: int | None = None,
                  block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(all pairs (a, b, score) of different vectors with cosine of at least ``min_score``, (item_id, rep)).

    A pair names the smallest item ids of its two vectors, ``a`` before ``b``; equal vectors share
    a rep.  Whole cells are packed into blocks (larger ones cut by a hash).  A vector travels once to each
    block, its own included, that has a cell whose radius its angle, less that of the threshold, does not
    exceed: both vectors of a pair reach the pair of their two blocks, and meet there alone.  So rows are
    moved at most as often as there are blocks, not as there are cells.
    """
    spark = items.sparkSession
    ship_package(spark)
    good, _ = usable(items.select("item_id", "vector"), dim)
    good = good.withColumn("item_id", F.col("item_id").cast("string"))
    reps = written(good.groupBy("vector").agg(F.min("item_id").alias("item_id")), "cell-reps")
    members = good.join(reps.withColumnRenamed("item_id", "rep"), "vector").select("item_id", "rep")
    if not reps.limit(1).count():
        return spark.createDataFrame([], _PAIR), members
    centers = fit_centroids(reps, n_cells)
    homes = written(assign(reps, np.arange(len(centers), dtype=np.int32), centers), "cell-homes")
    cells = homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # at most MAX_CELLS
    sizes, radius = {r["cell"]: r["n"] for r in cells}, {r["cell"]: r["radius"] for r in cells}
    n = sum(sizes.values())
    layout, starts = K.pack_cells(sizes, math.ceil(n / K._block_counts(spark, n, n, dim, block_rows)[0]))
    held = [c[0] for c in layout]
    reach = np.array([radius[c] for c in held]) + math.acos(min(1.0, max(-1.0, min_score))) + SLACK
    n_blocks = layout[-1][1] + layout[-1][2]
    shared = _shared(spark, (centers[held], reach, np.array(starts), np.array([layout[p][1] for p in starts]),
                             np.array([layout[p][2] for p in starts])))

    def visits(batches):
        centers, reach, starts, firsts, parts = shared.value
        step = _rows_at_once(centers)
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                angle = np.arccos(np.clip(_unit_rows(_matrix(batch.column("vector"), dim)) @ centers.T, -1, 1))
                row, group = np.nonzero(np.logical_or.reduceat(angle <= reach, starts, axis=1))
                times, block = K.blocks_of(group, firsts, parts)
                row = np.repeat(row, times)
                own = batch.column("block").to_numpy()[row]
                pair = np.minimum(block, own) * n_blocks + np.maximum(block, own)
                some = batch.select(["item_id", "vector"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(block < own), *some.columns],
                                                 names=["pair", "later", "item_id", "vector"])

    places = spark.createDataFrame([tuple(int(v) for v in c) for c in layout], "cell int, first int, parts int, slot int")
    placed = (homes.where(F.col("item_id").isNotNull()).join(places, "cell")
              .select("item_id", "vector", (F.col("first") + F.pmod(F.xxhash64("item_id"), "parts")).cast("long").alias("block")))
    moved = placed.mapInArrow(visits, TY.StructType([TY.StructField("pair", TY.LongType()), TY.StructField("later", TY.BooleanType()),
                                                     reps.schema["item_id"], reps.schema["vector"]]))
    sc = _context(spark)
    cores = sc.defaultParallelism if sc is not None else 16
    parts = min(2 * n_blocks * (n_blocks + 1), max(16 * cores, n * n_blocks // PAIR_ROWS))
    pairs = (moved.repartition(parts, "pair").sortWithinPartitions("pair", "later")
             .mapInArrow(lambda batches: _close(batches, n_blocks, dim, min_score), _PAIR))
    return pairs, members


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class _Vectors:
    """Rows of one side: ids, vectors, squared norms and unit float32 rows."""

    def __init__(self, batches: list, dim: int):
        self.ids = np.concatenate([b.column("item_id").to_numpy(zero_copy_only=False) for b in batches]).astype(object)
        self.x = np.concatenate([_matrix(b.column("vector"), dim) for b in batches])
        self.x2 = np.einsum("ij,ij->i", self.x, self.x)
        self.unit = K._unit32(self.x, self.x2)


def _close(batches, n_blocks: int, dim: int, min_score: float):
    """Close pairs of rows sorted by pair of blocks, those of the earlier block first.

    The rows of one block are held; those of the other stream past, and pairs leave as they are found."""
    now, first, held = None, [], None
    for batch in batches:
        pair = batch.column("pair").to_numpy()
        later = batch.column("later").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (later[1:] != later[:-1])))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(pair))):
            if pair[lo] != now:
                yield from _own_pairs(now, first, n_blocks, dim, min_score)
                now, first, held = pair[lo], [], None
            run = batch.slice(lo, hi - lo)
            if not later[lo]:
                first.append(run)
            elif first:
                held = held or _Vectors(first, dim)
                yield from _found(_Vectors([run], dim), held, min_score)
    yield from _own_pairs(now, first, n_blocks, dim, min_score)


def _own_pairs(pair, rows: list, n_blocks: int, dim: int, min_score: float):
    """Close pairs within a block."""
    if rows and pair // n_blocks == pair % n_blocks:
        own = _Vectors(rows, dim)
        for lo in range(0, len(own.x), BLOCK_ROWS):
            yield from _found(own, own, min_score, lo)


def _found(some: _Vectors, held: _Vectors, min_score: float, lo: int | None = None):
    """Pairs of ``some`` and ``held``; with ``lo``, of ``BLOCK_ROWS`` rows from there on and later rows of the same."""
    at, end = (0, len(some.x)) if lo is None else (lo, lo + BLOCK_ROWS)
    margin = (some.x.shape[1] + 16) * 1.2e-7  # of the float32 screen
    floor = np.full(len(some.unit[at:end]), min_score - margin, np.float32)
    for i, j in K.near_pairs(some.unit[at:end], held.unit[at:], floor):
        i, j = at + i, at + j
        if lo is not None:
            i, j = i[i < j], j[i < j]
        scores = K.exact_scores(some.x, some.x2, i, held.x, held.x2, j)
        a, b = some.ids[i], held.ids[j]
        keep = (scores >= min_score) & (a != b)
        a, b, scores = a[keep], b[keep], scores[keep]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.where(a < b, a, b), pa.string()), pa.array(np.where(a < b, b, a), pa.string()),
                                              pa.array(scores)], names=["a", "b", "score"])
