"""Batch ingest: what to process, what changed, what was covered
(F1, F3, F4, J3, A1, D7, D10, D11) and the end-to-end ingest job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import keep_cached
from . import chunk as CH
from . import embed as EM
from . import index as IX


def pending_by_path(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Parity skip (F4/J3): files whose (version, path) is not in the ledger.
    A file whose latest ledger row is a tombstone counts as not processed, so a
    re-created file is read again."""
    done = ledger.select("version", "file_path").distinct()
    if "content_hash" in ledger.columns and "ts" in ledger.columns:
        done = _live(ledger).select("version", "file_path")
    return docs.join(done, ["version", "file_path"], "left_anti")


def _live(ledger: DataFrame) -> DataFrame:
    """The latest ledger row of every file that is not deleted."""
    latest = IX.dedupe_latest(ledger, ["version", "file_path"], "ts")
    return latest.filter(F.col("content_hash").isNotNull())


def changes(old_ledger: DataFrame, docs: DataFrame, versions: list[str] | None = None) -> DataFrame:
    """Incremental update (D7): compare content hashes of the current tree with
    the ledger by (version, file path).  status = new | changed | deleted | same.

    A tombstone counts as absent: a file deleted earlier and still gone has no
    row, one that came back is ``new``.  ``versions`` names the versions of which
    ``docs`` is the whole tree: ledger rows of others are left out, since a tree of
    one version says nothing about another's files."""
    keys = ["version", "file_path"]
    cur = docs.select(*keys, IX.content_hash("content").alias("new_hash"))
    prev = _live(old_ledger).select(*keys, F.col("content_hash").alias("old_hash"))
    if versions is not None:
        prev = prev.filter(F.col("version").isin(versions))
    j = cur.join(prev, keys, "full_outer")
    status = (F.when(F.col("old_hash").isNull(), F.lit("new"))
              .when(F.col("new_hash").isNull(), F.lit("deleted"))
              .when(F.col("old_hash") != F.col("new_hash"), F.lit("changed"))
              .otherwise(F.lit("same")))
    return j.select(*keys, status.alias("status"))


def coverage(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per file: empty (blank), no_chunks, or processed with its chunk count
    (F1, F3, A1, D10)."""
    counts = chunks.groupBy("version", "file_path").agg(F.count("*").alias("n_chunks"))
    d = docs.select("version", "file_path", T.is_blank("content").alias("blank"),
                    F.length("content").alias("n_chars"))
    j = d.join(counts, ["version", "file_path"], "left")
    status = (F.when(F.col("blank"), F.lit("empty"))
              .when(F.coalesce("n_chunks", F.lit(0)) == 0, F.lit("no_chunks"))
              .otherwise(F.lit("processed")))
    return j.select("version", "file_path", status.alias("status"),
                    F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "n_chars")


def page_coverage(converted: DataFrame, chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Coverage from pages to the index (D10): per page the stage it reached.

    status = convert_error | empty | no_chunks | not_indexed | indexed; with the
    number of chunks and of indexed chunks and the share of page text kept.
    """
    n_chunks = chunks.groupBy("file_path").agg(F.count("*").alias("n_chunks"),
                                               F.sum(F.length("content")).alias("chunk_chars"))
    n_indexed = index.filter(F.col("vector").isNotNull()).groupBy("file_path").agg(
        F.count("*").alias("n_indexed"))
    j = (converted.select("page_id", "file_path", "error", "markdown")
         .join(n_chunks, "file_path", "left").join(n_indexed, "file_path", "left"))
    status = (F.when(F.col("error").isNotNull(), F.lit("convert_error"))
              .when(T.is_blank(F.coalesce("markdown", F.lit(""))), F.lit("empty"))
              .when(F.coalesce("n_chunks", F.lit(0)) == 0, F.lit("no_chunks"))
              .when(F.coalesce("n_indexed", F.lit(0)) == 0, F.lit("not_indexed"))
              .otherwise(F.lit("indexed")))
    return j.select("page_id", "file_path", status.alias("status"),
                    F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
                    F.coalesce("n_indexed", F.lit(0)).alias("n_indexed"),
                    F.round(F.coalesce("chunk_chars", F.lit(0)) / F.greatest(F.length("markdown"), F.lit(1)), 4)
                    .alias("kept_share"))


def coverage_summary(cov: DataFrame) -> DataFrame:
    """Files and chunks per version and coverage status (A1)."""
    return cov.groupBy("version", "status").agg(F.count("*").alias("n_files"),
                                                F.sum("n_chunks").alias("n_chunks"))


def drop_uncommitted(index: DataFrame, ledger: DataFrame) -> DataFrame:
    """Clean-up of unfinished runs (D11): index rows whose run has no ledger row."""
    runs = ledger.select("run_id").distinct()
    return index.join(runs, "run_id", "left_semi")


def expand_queries(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Query expansion (roadmap D9): every query term is followed by its synonyms.

    ``synonyms(term, synonym)`` is a dictionary; the engine chooses the join by its size.
    """
    terms = queries.select("qid", F.posexplode(F.split(F.lower("query"), r"(?U)[\s\x{1C}-\x{1F}]+", -1))
                           .alias("pos", "term")).filter(F.col("term") != "")
    syn = synonyms.select(F.lower("term").alias("term"), "synonym")
    j = terms.join(syn, "term", "left")
    per_term = j.groupBy("qid", "pos", "term").agg(F.array_sort(F.collect_set("synonym")).alias("syns"))
    words = per_term.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "syns"))).alias("w"))
    expanded = words.select("qid", F.array_join(F.flatten(F.transform(
        "w", lambda x: F.concat(F.array(x["term"]), x["syns"]))), " ").alias("expanded_query"))
    return queries.join(expanded, "qid", "left").withColumn(
        "expanded_query", F.coalesce("expanded_query", F.col("query")))


def to_process(docs: DataFrame, ledger: DataFrame, skip: str = "hash") -> DataFrame:
    """The documents a run has to chunk and embed (``skip`` as in ``ingest_batch``)."""
    if skip == "path":
        return pending_by_path(docs, ledger)
    if skip == "none":
        return docs
    # only the ledger rows of this batch's files matter: restrict before ranking
    mine = ledger.join(docs.select("version", "file_path").distinct(), ["version", "file_path"], "left_semi")
    latest = IX.dedupe_latest(mine, ["version", "file_path"], "ts")
    seen = latest.select("version", "file_path", "content_hash")
    return (docs.withColumn("content_hash", IX.content_hash("content"))
            .join(seen, ["version", "file_path", "content_hash"], "left_anti").drop("content_hash"))


def ingest_batch(docs: DataFrame, existing_index: DataFrame, ledger: DataFrame, run_id: str,
                 params: CH.ChunkParams = CH.ChunkParams(), mode: str = "replace",
                 embed=None, skip: str = "hash") -> tuple[DataFrame, DataFrame]:
    """Chunk + embed the documents that need it and return (next index, ledger rows).

    ``skip="path"`` is the parity behaviour (a known path is never re-read);
    ``skip="hash"`` re-processes files whose content changed; ``skip="none"``
    ignores the ledger (a full reset).  See ``ingest_batch_with_errors`` for the
    error rows of files that failed.
    """
    nxt, led, _errors = ingest_batch_with_errors(docs, existing_index, ledger, run_id, params, mode, embed, skip)
    return nxt, led


def ingest_batch_with_errors(docs: DataFrame, existing_index: DataFrame, ledger: DataFrame, run_id: str,
                             params: CH.ChunkParams = CH.ChunkParams(), mode: str = "replace",
                             embed=None, skip: str = "hash",
                             staging: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next index, ledger rows, error rows) of one ingest run.

    ``staging`` is a new folder on shared storage: the embedded batch is written there
    and index rows, ledger and errors are all read from it, so they agree even when a
    lost executor would have embedded some texts again.  Without it the batch is cached.

    ``mode="append"`` returns only this run's rows (for ``index.append_rows``;
    liveness comes from the ledger); ``"replace"``/``"upsert"`` return the whole
    next snapshot.

    A file with any chunk whose embedding failed (``embed_error`` set) is
    reported once in the errors, none of its chunks is written and it is not
    marked processed, so the next run retries it; the other files commit.
    """
    todo = to_process(docs, ledger, skip)
    chunks = CH.chunk_documents(todo, params)
    embedded = (embed or (lambda df: EM.embed_hashed(df, "content")))(chunks)
    if "embed_error" not in embedded.columns:
        embedded = embedded.withColumn("embed_error", F.lit(None).cast("string"))
    # rows, ledger counts and errors all come from this one batch: chunk and embed once
    if staging:
        embedded.write.mode("errorifexists").parquet(staging)
        embedded = embedded.sparkSession.read.schema(embedded.schema).parquet(staging)
    else:
        embedded = embedded.persist()
    failed = (embedded.filter(F.col("embed_error").isNotNull())
              .groupBy("version", "file_path").agg(F.min("embed_error").alias("error")))
    ok = embedded.join(failed.select("version", "file_path"), ["version", "file_path"], "left_anti")
    rows = ok.select(*[c.name for c in IX.INDEX_SCHEMA.fields if c.name != "run_id"],
                     F.lit(run_id).alias("run_id"))
    nxt = rows if mode == "append" else IX.upsert(existing_index, rows, mode=mode)
    errors = failed.select("version", "file_path", F.lit("embed").alias("stage"), "error",
                           F.current_timestamp().alias("ts"))
    ledger_new = IX.ledger_rows(todo, ok, run_id)
    return (nxt if staging else keep_cached(nxt, embedded)), ledger_new, errors
