"""A stream of search requests against a static index (X2): stream-static,
no state; every micro-batch is one batch search whose results are the folder
``batch=<number>`` of the output (read as a partition column)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import search as SE


def start_query_stream(requests: DataFrame, index: DataFrame, out_path: str, checkpoint: str,
                       rules: SE.RerankRules = SE.RerankRules(), once: bool = True):
    """``requests`` is a streaming frame ``(qid, query, version, limit, min_score)``."""
    def per_batch(batch: DataFrame, epoch: int) -> None:
        res = SE.search(batch, index, rules=rules)
        # a batch's folder is replaced, not appended to: a retried batch leaves its answers once
        res.write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")
        SE.release(res)  # a long-running stream must not pile up cached batches

    w = requests.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")
    return w.start()
