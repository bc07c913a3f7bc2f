"""End-to-end batch jobs: pages -> markdown -> chunks -> vectors -> index
(append-only rows + ledger, or snapshots) and tables of queries -> results.  Paths are shared storage
(the cluster's file system); nothing goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import chunk as CH
from ..operators import convert as CV
from ..operators import index as IX
from ..operators import ingest as IN
from ..operators import partial as PA
from ..operators import search as SE
from ..session import release
from ..streaming.ingest_stream import latest_index


def build_index(spark: SparkSession, pages: DataFrame, base_dir: str, version: str = C.DEFAULT_VERSION,
                selector: CV.MainSelector = CV.DEFAULT_SELECTOR, params: CH.ChunkParams = CH.ChunkParams(),
                mode: str = "append", embed=None, skip: str = "hash", whole_tree: bool = False) -> dict:
    """Convert and ingest ``pages(page_id, file_path, html)`` into ``base_dir``.

    ``mode="append"`` (default): append this run's chunk rows, then its ledger and
    error rows; the ledger decides which rows are live (``index.read_live_index``).
    ``mode="replace"``/``"upsert"``: write a whole new snapshot, move the
    ``current`` pointer to it, then append ledger and error rows.

    ``whole_tree=True`` says that ``pages`` is the complete tree of ``version``:
    files of the ledger that are no longer in it are retired (tombstones in the
    ledger; in snapshot modes their rows are left out as well).
    """
    run_id = IX.new_run_id()
    converted = CV.pages_to_markdown(pages, selector)
    docs = CV.markdown_docs(converted, version)
    current = f"{base_dir}/current"
    gone = None
    ledger = IX.read_or_empty(spark, f"{base_dir}/ledger", IX.LEDGER_SCHEMA)
    existing = None if mode == "append" else IX.read_or_empty(
        spark, IX.latest_pointer(spark, current), IX.INDEX_SCHEMA)
    nxt, led, errors = IN.ingest_batch_with_errors(docs, existing, ledger, run_id, params, mode, embed, skip,
                                                  staging=f"{base_dir}/staging/{run_id}")
    if whole_tree:  # a page that failed to convert is still there
        present = converted.select(F.lit(version).alias("version"), "file_path",
                                   F.coalesce("markdown", F.lit("")).alias("content"))
        gone = IN.changes(ledger, present, [version]).filter(F.col("status") == "deleted").select("version", "file_path")
        if mode != "append":
            nxt = nxt.join(gone, ["version", "file_path"], "left_anti")
    conv_err = converted.filter(F.col("error").isNotNull()).select(
        F.lit(version).alias("version"), "file_path", F.lit("convert").alias("stage"), "error",
        F.current_timestamp().alias("ts"))
    if mode == "append":
        IX.append_rows(nxt, base_dir)
        path = IX.chunks_dir(spark, base_dir)
    else:
        # snapshot, then pointer, then ledger (see streaming.ingest_stream for why)
        path = IX.write_snapshot(nxt, base_dir, run_id)
        spark.createDataFrame([(path,)], "path string").withColumn(
            "ts", F.current_timestamp()).write.mode("append").parquet(current)
    if gone is not None:
        led = led.unionByName(IX.tombstones(gone, run_id))
    led.write.mode("append").parquet(f"{base_dir}/ledger")
    errors.unionByName(conv_err).write.mode("append").parquet(f"{base_dir}/errors")
    release(nxt)
    return {"run_id": run_id, "snapshot": path}


def answer(spark: SparkSession, queries: DataFrame, base_dir: str, out_path: str | None = None,
           rules: SE.RerankRules = SE.RerankRules()) -> DataFrame:
    """Search the current index snapshot; optionally append the results to ``out_path``."""
    index = latest_index(spark, base_dir)
    res = SE.search(queries, index, rules=rules)
    if out_path:
        res.write.mode("append").parquet(out_path)
    return res


def ingest_sections(spark: SparkSession, docs: DataFrame, base_dir: str, params: CH.ChunkParams = CH.ChunkParams(),
                    embed=None, skip: str = "hash") -> str:
    """Ingest ``docs(version, file_path, content)`` into an append-only index, chunk by chunk:
    a file with failed chunks is searchable without them (``retry_failed`` takes those)."""
    run_id = IX.new_run_id()
    ledger = IX.read_or_empty(spark, f"{base_dir}/ledger", IX.LEDGER_SCHEMA)
    rows, led, failed = PA.ingest_sections(docs, ledger, run_id, f"{base_dir}/staging/{run_id}", params, embed, skip)
    IX.append_rows(rows, base_dir)
    failed.write.mode("append").parquet(f"{base_dir}/failed_chunks")
    led.write.mode("append").parquet(f"{base_dir}/ledger")
    return run_id


def retry_failed(spark: SparkSession, base_dir: str, embed=None) -> None:
    """Embed the pending failed chunks of ``base_dir`` alone; the other chunks are not touched."""
    failed = IX.read_or_empty(spark, f"{base_dir}/failed_chunks", PA.FAILED_SCHEMA)
    rows, led, again = PA.retry_sections(
        failed, IX.read_or_empty(spark, IX.chunks_dir(spark, base_dir), IX.INDEX_SCHEMA),
        IX.read_or_empty(spark, f"{base_dir}/ledger", IX.LEDGER_SCHEMA), f"{base_dir}/staging/{IX.new_run_id()}", embed)
    # the ledger rows count the index before this run's rows are in it: written first, committed last
    counted = f"{base_dir}/staging/{IX.new_run_id()}-ledger"
    led.write.parquet(counted)
    led = spark.read.schema(IX.LEDGER_SCHEMA).parquet(counted)
    again.write.mode("append").parquet(f"{base_dir}/failed_chunks")
    IX.append_rows(rows, base_dir)
    led.write.mode("append").parquet(f"{base_dir}/ledger")
