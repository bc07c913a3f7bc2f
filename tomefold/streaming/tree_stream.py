"""Ingest of a markdown tree whose files are added, edited and deleted.

Every run writes a listing of the tree (path, modification time, length; no content)
and streams the listings through a state per path: a path first seen is ``new``, one
whose time or length differs is ``touched``, and one that the latest listing lacks
times out and is ``deleted`` (event time is the listing's time).  Only new and touched
files are read; the hash in the ledger decides whether a touched file has changed.

The state is one small row per file: for very many files set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.
One run at a time on a ``base_dir``.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as C
from ..operators import index as IX
from ..operators import ingest as IN
from ..session import ship_package
from ..sources.files import _rel

LISTING_SCHEMA = TY.StructType([
    TY.StructField("file_path", TY.StringType()),
    TY.StructField("modified_ms", TY.LongType()),
    TY.StructField("length", TY.LongType()),
    TY.StructField("listed_ms", TY.LongType()),
    TY.StructField("listed_at", TY.TimestampType()),
])

CHANGE_SCHEMA = TY.StructType([
    TY.StructField("file_path", TY.StringType()),
    TY.StructField("change", TY.StringType()),
    TY.StructField("modified_ms", TY.LongType()),
])

STATE_SCHEMA = TY.StructType([
    TY.StructField("modified_ms", TY.LongType()),
    TY.StructField("length", TY.LongType()),
])

#: a listing's own row: a tree without files still moves the event time on
MARK = ""


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).load(root))


def write_listing(spark: SparkSession, root: str, base_dir: str, glob: str = "*.md") -> str:
    """Append a listing of ``root`` under ``base_dir``; returns its folder.

    Listing times always grow, also when the clock is set back.  A missing ``root``
    fails (it is not an empty tree)."""
    pointer = f"{base_dir.rstrip('/')}/listed"
    last = IX.read_or_empty(spark, pointer, IX.POINTER_SCHEMA).agg(F.max("ts").alias("ts")).first()["ts"]
    at = _dt.datetime.now()
    if last is not None:
        at = max(at, last + _dt.timedelta(milliseconds=1))
    rows = _files(spark, root, glob).select(
        _rel(F.col("path"), root).alias("file_path"), F.unix_millis("modificationTime").alias("modified_ms"),
        "length", F.unix_millis(F.lit(at)).alias("listed_ms"), F.lit(at).alias("listed_at"))
    mark = spark.range(1).select(
        F.lit(MARK).alias("file_path"), F.lit(0).cast("long").alias("modified_ms"), F.lit(0).cast("long").alias("length"),
        F.unix_millis(F.lit(at)).alias("listed_ms"), F.lit(at).alias("listed_at"))
    path = f"{base_dir.rstrip('/')}/listings/{IX.new_run_id()}"
    rows.unionByName(mark).write.parquet(path)
    spark.createDataFrame([(path, at)], IX.POINTER_SCHEMA).write.mode("append").parquet(pointer)
    return path


def path_changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The change of one path; its state expires once a later listing lacks it."""
    path = key[0]
    if path == MARK:
        return
    if state.hasTimedOut:
        modified = state.get[0]
        state.remove()
        yield pd.DataFrame({"file_path": [path], "change": ["deleted"], "modified_ms": [modified]})
        return
    # several listings may wait after a failed run: the latest row counts
    rows = pd.concat(list(batches)).sort_values("listed_ms")
    row = rows.iloc[-1]
    now = (int(row["modified_ms"]), int(row["length"]))
    old = state.getOption
    state.update(now)
    state.setTimeoutTimestamp(int(row["listed_ms"]) + 1)
    if old is None or tuple(old) != now:
        yield pd.DataFrame({"file_path": [path], "change": ["new" if old is None else "touched"],
                            "modified_ms": [now[0]]})


def change_stream(spark: SparkSession, base_dir: str) -> DataFrame:
    """The listings of ``base_dir`` as a stream of changes ``(file_path, change, modified_ms)``."""
    listings = (spark.readStream.schema(LISTING_SCHEMA).option("recursiveFileLookup", True)
                .parquet(f"{base_dir.rstrip('/')}/listings"))
    return (listings.withWatermark("listed_at", "0 seconds").groupBy("file_path")
            .applyInPandasWithState(path_changes, CHANGE_SCHEMA, STATE_SCHEMA, "append",
                                    GroupStateTimeout.EventTimeTimeout))


def failed_before(errors: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose last embedding failed and that no later run committed: they are tried again."""
    keys = ["version", "file_path"]
    last = errors.filter(F.col("stage") == "embed").groupBy(*keys).agg(F.max("ts").alias("failed_at"))
    done = ledger.groupBy(*keys).agg(F.max("ts").alias("done_at"))
    return (last.join(done, keys, "left")
            .filter(F.col("done_at").isNull() | (F.col("done_at") < F.col("failed_at"))).select(*keys))


def apply_changes(spark: SparkSession, changes: DataFrame, root: str, base_dir: str,
                  version: str = C.DEFAULT_VERSION, glob: str = "*.md", embed=None) -> str:
    """Bring an append-only index up to date with ``changes``; returns the run id.

    New and touched files are read, chunked and embedded; deleted files, and files
    whose new content has no chunks, get a tombstone.  A file that is not valid UTF-8
    becomes an error row and its earlier chunks stay live.  Chunk rows are written
    before the ledger, so a crash only makes the batch run again."""
    base, run_id = base_dir.rstrip("/"), IX.new_run_id()
    staging = f"{base}/staging/{run_id}"
    # the batch is a stateful plan: it runs once, everything below reads what it wrote
    changes.write.parquet(f"{staging}-changes")
    changes = spark.read.schema(CHANGE_SCHEMA).parquet(f"{staging}-changes").withColumn("version", F.lit(version))
    ledger = IX.read_or_empty(spark, f"{base}/ledger", IX.LEDGER_SCHEMA).filter(F.col("version") == version)
    errors = IX.read_or_empty(spark, f"{base}/errors", IX.ERROR_SCHEMA).filter(F.col("version") == version)
    keys = ["version", "file_path"]
    live = IN._live(ledger).select(*keys, "content_hash")
    gone = changes.filter(F.col("change") == "deleted").select(*keys)
    fresh = changes.filter(F.col("change") != "deleted")
    again = failed_before(errors, ledger).join(gone, keys, "left_anti")
    first = fresh.agg(F.min("modified_ms").alias("ms")).first()["ms"]
    retry = not again.isEmpty()
    led = None
    if first is not None or retry:
        found = _files(spark, root, glob)
        if not retry:  # older files cannot be among the new and touched: their content is not read
            found = found.filter(F.col("modificationTime") >= F.lit(_dt.datetime.fromtimestamp(first / 1000)))
        found = found.select(F.lit(version).alias("version"), _rel(F.col("path"), root).alias("file_path"), "content")
        found = found.join(fresh.select(*keys).union(again).distinct(), keys, "left_semi")
        found = found.withColumn("ok", F.is_valid_utf8(F.col("content").cast("string")))
        found.write.parquet(f"{staging}-files")
        found = spark.read.parquet(f"{staging}-files")
        docs = found.filter("ok").select(*keys, F.col("content").cast("string").alias("content"))
        rows, led, failed = IN.ingest_batch_with_errors(docs, None, ledger, run_id, mode="append",
                                                        embed=embed, staging=staging)
        IX.append_rows(rows, base)
        unread = found.filter(~F.col("ok")).select(*keys, F.lit("read").alias("stage"),
                                                   F.lit("content is not valid UTF-8").alias("error"),
                                                   F.current_timestamp().alias("ts"))
        failed.unionByName(unread).write.mode("append").parquet(f"{base}/errors")
        emptied = (docs.withColumn("content_hash", IX.content_hash("content"))
                   .join(live, [*keys, "content_hash"], "left_anti")
                   .join(led, keys, "left_anti").join(failed, keys, "left_anti").select(*keys))
        gone = gone.union(emptied)
    marks = IX.tombstones(gone.join(live, keys, "left_semi"), run_id)
    (marks if led is None else led.unionByName(marks)).write.mode("append").parquet(f"{base}/ledger")
    return run_id


def sync_tree(spark: SparkSession, root: str, base_dir: str, checkpoint: str,
              version: str = C.DEFAULT_VERSION, glob: str = "*.md", embed=None):
    """List ``root`` and start the stream over what is listed and not yet processed.

    Returns the ``StreamingQuery``; after ``awaitTermination`` the live index of
    ``base_dir`` (``index.read_live_index``) equals the tree, apart from files with
    error rows.  ``checkpoint`` is on shared storage and belongs to one tree."""
    ship_package(spark)
    write_listing(spark, root, base_dir, glob)

    def per_batch(batch: DataFrame, epoch: int) -> None:
        apply_changes(batch.sparkSession, batch, root, base_dir, version, glob, embed)

    return (change_stream(spark, base_dir).writeStream.foreachBatch(per_batch).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
