"""Section-level recovery (roadmap D11): good chunks of a file commit, failed ones are retried alone.

``ingest.ingest_batch_with_errors`` holds a whole file back when one of its chunks
fails.  Here the file becomes searchable with the chunks that were embedded; each
failed chunk is a row of its own (``FAILED_SCHEMA``) under the run that wrote the file.
A failed chunk is pending while that run is the file's live one and the index has no
row of the chunk, so nothing has to be marked as solved: a retry that stopped half-way,
a file that was edited or deleted meanwhile and a repeated retry all come out right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from . import chunk as CH
from . import embed as EM
from . import index as IX
from . import ingest as IN

FILE = ["version", "file_path"]
CHUNK = [*FILE, "run_id", "chunk_id"]

FAILED_SCHEMA = TY.StructType([f for f in IX.INDEX_SCHEMA.fields if f.name != "vector"] + [
    TY.StructField("error", TY.StringType()),
    TY.StructField("ts", TY.TimestampType()),
])


def _embedded(chunks: DataFrame, embed, staging: str) -> tuple[DataFrame, DataFrame]:
    """(index rows, failed rows) of ``chunks``, embedded once and written to ``staging``."""
    out = (embed or (lambda df: EM.embed_hashed(df, "content")))(chunks)
    if "embed_error" not in out.columns:
        out = out.withColumn("embed_error", F.lit(None).cast("string"))
    names = [f.name for f in IX.INDEX_SCHEMA.fields]
    out = out.select(*names, "embed_error")
    out.write.mode("errorifexists").parquet(staging)
    out = out.sparkSession.read.schema(out.schema).parquet(staging)
    failed = out.filter(F.col("embed_error").isNotNull()).select(
        *[n for n in names if n != "vector"], F.col("embed_error").alias("error"), F.current_timestamp().alias("ts"))
    return out.filter(F.col("embed_error").isNull()).drop("embed_error"), failed


def ingest_sections(docs: DataFrame, ledger: DataFrame, run_id: str, staging: str,
                    params: CH.ChunkParams = CH.ChunkParams(), embed=None,
                    skip: str = "hash") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index rows, ledger rows, failed rows) of one run; append all three, the ledger last.

    A file with at least one embedded chunk is in the ledger, with the number of
    those.  A file of which every chunk failed is not: the next run takes it whole."""
    todo = IN.to_process(docs, ledger, skip)
    chunks = CH.chunk_documents(todo, params).withColumn("run_id", F.lit(run_id))
    rows, failed = _embedded(chunks, embed, staging)
    return rows, IX.ledger_rows(todo, rows, run_id), failed


def _live_runs(ledger: DataFrame) -> DataFrame:
    return IN._live(ledger).select(*FILE, "run_id", "content_hash", "n_chunks")


def pending_sections(failed: DataFrame, index_rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """The failed chunks still to do, each once with its latest error."""
    mine = failed.join(_live_runs(ledger).select(*FILE, "run_id"), [*FILE, "run_id"], "left_semi")
    mine = mine.join(index_rows.select(*CHUNK), CHUNK, "left_anti")
    return IX.dedupe_latest(mine, CHUNK, "ts")


def retry_sections(failed: DataFrame, index_rows: DataFrame, ledger: DataFrame, staging: str,
                   embed=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Embed the pending chunks alone: (index rows, ledger rows, failed rows) to append.

    The rows carry the run of their file, so they are live as soon as they are
    written.  A file whose number of chunks is no longer that of its ledger row
    gets a new one, also when an earlier retry stopped before writing it."""
    rows, again = _embedded(pending_sections(failed, index_rows, ledger).drop("error", "ts"), embed, staging)
    live = _live_runs(ledger).join(failed.select(*FILE, "run_id").distinct(), [*FILE, "run_id"], "left_semi")
    have = index_rows.select(*CHUNK).unionByName(rows.select(*CHUNK))
    counts = (have.join(live.select(*FILE, "run_id"), [*FILE, "run_id"], "left_semi")
              .groupBy(*FILE, "run_id").agg(F.count("*").cast("int").alias("_n")))
    led = live.join(counts, [*FILE, "run_id"]).filter(~F.col("_n").eqNullSafe(F.col("n_chunks")))
    led = led.select(*FILE, "content_hash", F.col("_n").alias("n_chunks"), "run_id", F.current_timestamp().alias("ts"))
    return rows, led, again


def section_states(failed: DataFrame, index_rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per live file: ``n_indexed``, ``n_pending`` and status whole | partial."""
    live = _live_runs(ledger).select(*FILE, "run_id")
    have = (index_rows.join(live, [*FILE, "run_id"], "left_semi").groupBy(*FILE).agg(F.count("*").alias("n_indexed")))
    todo = pending_sections(failed, index_rows, ledger).groupBy(*FILE).agg(F.count("*").alias("n_pending"))
    zero = F.lit(0)
    return (live.select(*FILE).join(have, FILE, "left").join(todo, FILE, "left")
            .select(*FILE, F.coalesce("n_indexed", zero).alias("n_indexed"), F.coalesce("n_pending", zero).alias("n_pending"),
                    F.when(F.coalesce("n_pending", zero) > 0, "partial").otherwise("whole").alias("status")))
