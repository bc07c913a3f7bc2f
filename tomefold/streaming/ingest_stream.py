"""Incremental, resumable ingest of a markdown tree.

``readStream`` over the tree with ``trigger(availableNow=True)``: the stream
checkpoint records which files were read, so a rerun picks up only new files.
Each micro-batch is chunked and embedded; by default its rows are appended to
the index and its ledger rows after them, so a batch costs the size of the
batch, not of the index (the ledger decides which rows are live).  Changed files at
a known path are not re-read by the file source: ``tree_stream.sync_tree``
follows edits and deletions, as does the batch ``changes`` job (hash ledger, D7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from .. import constants as C
from ..operators import index as IX
from ..session import release
from ..operators import ingest as IN
from ..sources.files import _rel


def start_ingest(spark: SparkSession, root: str, base_dir: str, checkpoint: str,
                 version: str = C.DEFAULT_VERSION, mode: str = "append"):
    """Start the stream; returns the ``StreamingQuery`` (call ``awaitTermination``).

    ``mode="append"`` (default): each micro-batch appends only its own chunk rows
    and then its ledger rows; ``index.read_live_index`` gives the current index.
    ``mode="replace"``/``"upsert"``: each micro-batch writes a full new snapshot
    (small collections only: the whole index is rewritten per batch).
    """
    stream = (spark.readStream.format("text").option("wholetext", True)
              .option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
              .schema(TY.StructType([TY.StructField("value", TY.StringType())])).load(root))
    docs = stream.select(F.lit(version).alias("version"),
                         _rel(F.col("_metadata.file_path"), root).alias("file_path"),
                         F.col("value").alias("content"))

    def per_batch(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        ledger_path = f"{base_dir}/ledger"
        ledger = IX.read_or_empty(s, ledger_path, IX.LEDGER_SCHEMA)
        run_id = f"epoch{epoch:08d}-{IX.new_run_id()}"
        staging = f"{base_dir}/staging/{run_id}"
        if mode == "append":
            rows, led, err = IN.ingest_batch_with_errors(batch, None, ledger, run_id, mode="append", staging=staging)
            # rows first, ledger next: rows of a run without ledger rows are never live
            IX.append_rows(rows, base_dir)
            led.write.mode("append").parquet(ledger_path)
            err.write.mode("append").parquet(f"{base_dir}/errors")
            release(rows)
            return
        current = f"{base_dir}/current"
        existing = IX.read_or_empty(s, IX.latest_pointer(s, current), IX.INDEX_SCHEMA)
        nxt, led, err = IN.ingest_batch_with_errors(batch, existing, ledger, run_id, mode=mode, staging=staging)
        # commit order: snapshot, then the pointer to it, then the ledger.  A crash
        # before the ledger append only makes the next run redo these files, and
        # replacing them again is idempotent; the ledger never names a file whose
        # chunks are missing from the current snapshot.
        path = IX.write_snapshot(nxt, base_dir, run_id)
        s.createDataFrame([(path,)], "path string").withColumn(
            "ts", F.current_timestamp()).write.mode("append").parquet(current)
        led.write.mode("append").parquet(ledger_path)
        err.write.mode("append").parquet(f"{base_dir}/errors")
        release(nxt)

    return (docs.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_index(spark: SparkSession, base_dir: str) -> DataFrame:
    """The current index of either layout (append-only chunks or snapshots)."""
    snap = IX.latest_pointer(spark, f"{base_dir}/current")
    if snap:
        return IX.read_or_empty(spark, snap, IX.INDEX_SCHEMA)
    return IX.read_live_index(spark, base_dir)
