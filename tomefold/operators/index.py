"""Chunk index: schema, pairing with vectors, upsert, ledger, stats
(S5-S9, S11, J1, J5, A2).

The index is parquet partitioned by ``version``, in one of two layouts:

* append-only (default for ingest): a run appends only its own chunk rows, then
  its ledger rows; ``live_index`` keeps the rows of each file's latest
  committed run, so nothing is ever rewritten;
* snapshots: parquet has no MERGE, so an update writes a whole new snapshot
  directory (never overwriting what is being read), then a pointer row, then
  the ledger rows.

Either way the ledger append is a run's last write: a crash repeats work, but
the ledger never names a file whose rows are missing.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions import text as T

INDEX_SCHEMA = TY.StructType([
    TY.StructField("version", TY.StringType(), False),
    TY.StructField("chunk_id", TY.StringType(), False),
    TY.StructField("file_path", TY.StringType()),
    TY.StructField("chunk_index", TY.IntegerType()),
    TY.StructField("content", TY.StringType()),
    TY.StructField("section", TY.StringType()),
    TY.StructField("content_type", TY.StringType()),
    TY.StructField("title", TY.StringType()),
    TY.StructField("heading_path", TY.ArrayType(TY.StringType())),
    TY.StructField("has_code", TY.BooleanType()),
    TY.StructField("doc_url", TY.StringType()),
    TY.StructField("vector", TY.ArrayType(TY.FloatType())),
    TY.StructField("run_id", TY.StringType()),
])

LEDGER_SCHEMA = TY.StructType([
    TY.StructField("version", TY.StringType(), False),
    TY.StructField("file_path", TY.StringType(), False),
    TY.StructField("content_hash", TY.StringType()),
    TY.StructField("n_chunks", TY.IntegerType()),
    TY.StructField("run_id", TY.StringType()),
    TY.StructField("ts", TY.TimestampType()),
])

POINTER_SCHEMA = TY.StructType([
    TY.StructField("path", TY.StringType()),
    TY.StructField("ts", TY.TimestampType()),
])

ERROR_SCHEMA = TY.StructType([
    TY.StructField("version", TY.StringType()),
    TY.StructField("file_path", TY.StringType()),
    TY.StructField("stage", TY.StringType()),
    TY.StructField("error", TY.StringType()),
    TY.StructField("ts", TY.TimestampType()),
])


def new_run_id() -> str:
    """A sortable, unique run id: UTC time plus a random suffix."""
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]


def read_or_empty(spark: SparkSession, path: str | None, schema: TY.StructType) -> DataFrame:
    """A table, or an empty frame of ``schema`` when its path does not exist.

    Only a missing path counts as a first run: a corrupt file, a denied read or a
    storage fault fails, since an empty or partial table would drop live rows."""
    if path:
        try:
            return spark.read.schema(schema).option("ignoreCorruptFiles", "false").parquet(path)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def content_hash(content) -> F.Column:
    """sha-256 of a document text (the change detector of D7)."""
    return F.sha2(T._c(content), 256)


# --------------------------------------------------------------------------- J1
def pair_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id",
                 dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Equi-join of chunks with their vectors; everything unmatched, or of the
    wrong size, comes back as error rows instead of failing the batch (one full
    outer join)."""
    both = chunks.withColumn("_chunk", F.lit(True)).join(
        vectors.select(key, "vector", F.lit(True).alias("_vector")), key, "full_outer")
    problem = (F.when(F.col("_chunk").isNull(), F.lit("vector without chunk"))
               .when(F.col("_vector").isNull(), F.lit("missing vector")))
    if dim is not None:
        problem = problem.when(F.coalesce(F.size("vector"), F.lit(-1)) != dim, F.lit("wrong vector size"))
    both = both.withColumn("error", problem)
    paired = both.filter(F.col("error").isNull()).select(*chunks.columns, "vector")
    return paired, both.filter(F.col("error").isNotNull()).select(key, "error")


# --------------------------------------------------------------------------- S6, J5
def dedupe_latest(rows: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """One row per key; with ``order_col`` the greatest wins (last write wins).

    Equal ``order_col`` values are decided by the other columns, so the choice is
    the same on every run."""
    if order_col is None:
        return rows.dropDuplicates(keys)
    ties = [F.desc(c) for c in sorted(rows.columns) if c not in keys and c != order_col]
    w = Window.partitionBy(*keys).orderBy(F.desc(order_col), *ties)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, new: DataFrame, mode: str = "replace",
           id_keys: list[str] | None = None) -> DataFrame:
    """Next snapshot of the index.

    ``mode="upsert"``: by point id only (the parity mode): rows of ``existing``
    whose id appears in ``new`` are replaced, nothing is ever deleted; an id that
    is twice in ``new`` is kept once (the row that sorts last).
    ``mode="replace"``: all rows of every ``(version, file_path)`` present in
    ``new`` are replaced, so a shrunk document leaves no stale chunks.
    """
    if mode == "upsert":
        keys = id_keys or ["chunk_id"]
        new = dedupe_latest(new, keys, next(c for c in sorted(new.columns) if c not in keys))
        return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
    files = new.select("version", "file_path").distinct()
    return existing.join(files, ["version", "file_path"], "left_anti").unionByName(new)


def write_snapshot(index: DataFrame, base_dir: str, run_id: str) -> str:
    """Write a snapshot directory (partitioned by version) and return its path."""
    path = f"{base_dir.rstrip('/')}/snapshots/{run_id}"
    index.write.mode("errorifexists").partitionBy("version").parquet(path)
    return path


# --------------------------------------------------------------------------- append-only index
def chunks_dir(spark: SparkSession, base_dir: str) -> str:
    """The current generation of the append-only chunk rows (see ``compact``)."""
    base = base_dir.rstrip("/")
    return latest_pointer(spark, f"{base}/generation") or f"{base}/chunks"


def latest_pointer(spark: SparkSession, path: str) -> str | None:
    """The newest path recorded in a pointer table (one small row per move); None before the first."""
    rows = read_or_empty(spark, path, POINTER_SCHEMA).orderBy(F.desc("ts"), F.desc("path")).head(1)
    return rows[0]["path"] if rows else None


def append_rows(rows: DataFrame, base_dir: str) -> None:
    """Append a run's chunk rows to the current chunk directory (partitioned by version).

    Nothing is rewritten: which rows are live is decided by the ledger (see
    ``live_index``), so a run touches only its own files, whatever the index size.
    """
    rows.write.mode("append").partitionBy("version").parquet(chunks_dir(rows.sparkSession, base_dir))


def live_index(index_rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows written by the latest committed run of their file.

    Older rows of a re-processed file, rows of runs that never committed their
    ledger rows and rows of deleted files (a ledger row without chunks) drop out;
    the ledger has one row per file and run, far fewer rows than the index.
    """
    latest = dedupe_latest(ledger, ["version", "file_path"], "ts").select("version", "file_path", "run_id")
    return index_rows.join(latest, ["version", "file_path", "run_id"], "left_semi")


def read_live_index(spark: SparkSession, base_dir: str) -> DataFrame:
    """The live rows of an append-only index directory."""
    base = base_dir.rstrip("/")
    return live_index(read_or_empty(spark, chunks_dir(spark, base), INDEX_SCHEMA),
                      read_or_empty(spark, f"{base}/ledger", LEDGER_SCHEMA))


def compact(spark: SparkSession, base_dir: str) -> str:
    """Write the live rows once into a new chunk directory and make it current.

    Dead rows (replaced, deleted, uncommitted) are left behind in the old
    directory; live rows keep their run ids, so the ledger still decides.  Run it
    between ingest runs (rows appended to the old directory meanwhile would not
    be carried over).
    """
    base = base_dir.rstrip("/")
    new_dir = f"{base}/chunks-{new_run_id()}"
    read_live_index(spark, base).write.mode("errorifexists").partitionBy("version").parquet(new_dir)
    spark.createDataFrame([(new_dir,)], "path string").withColumn(
        "ts", F.current_timestamp()).write.mode("append").parquet(f"{base}/generation")
    return new_dir


def tombstones(deleted: DataFrame, run_id) -> DataFrame:
    """Ledger rows that retire deleted files (``deleted(version, file_path)``)."""
    run = run_id if isinstance(run_id, F.Column) else F.lit(run_id)
    return deleted.select("version", "file_path", F.lit(None).cast("string").alias("content_hash"),
                          F.lit(0).alias("n_chunks"), run.alias("run_id"), F.current_timestamp().alias("ts"))


# --------------------------------------------------------------------------- S8, A2
def ledger_rows(docs: DataFrame, chunks: DataFrame | None, run_id) -> DataFrame:
    """One ledger row per committed document: its content hash and chunk count
    (``chunks=None`` records hashes only)."""
    base = docs.select("version", "file_path", content_hash("content").alias("content_hash"))
    if chunks is None:
        base = base.withColumn("n_chunks", F.lit(None).cast("int"))
    else:
        # blank files and files without chunks count as done but are not marked
        counts = chunks.groupBy("version", "file_path").agg(F.count("*").cast("int").alias("n_chunks"))
        base = base.join(counts, ["version", "file_path"], "inner")
    run = run_id if isinstance(run_id, F.Column) else F.lit(run_id)
    return base.select("version", "file_path", "content_hash", "n_chunks",
                       run.alias("run_id"), F.current_timestamp().alias("ts"))


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """Files processed and chunks created over all runs (A2); latest row per file."""
    latest = dedupe_latest(ledger, ["version", "file_path"], "ts")
    return latest.groupBy("version").agg(F.count("*").alias("files_processed"),
                                         F.sum("n_chunks").alias("chunks_created"))


# --------------------------------------------------------------------------- S11
def index_stats(index: DataFrame) -> DataFrame:
    """Chunks, files, code chunks and chunks without vector per version."""
    return index.groupBy("version").agg(
        F.count("*").alias("n_chunks"),
        F.countDistinct("file_path").alias("n_files"),
        F.sum(F.col("has_code").cast("int")).alias("n_code_chunks"),
        F.sum(F.when(F.col("vector").isNull(), 1).otherwise(0)).alias("n_without_vector"))
