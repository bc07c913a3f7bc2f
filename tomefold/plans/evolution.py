"""Registered queries over trees that change and runs that fail in part."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import association as AS
from ..operators import embed as EM
from ..operators import index as IX
from ..operators import partial as PA
from ..operators import versions as VS
from ..session import ensure_checkpoint_dir
from ..sources import derived as D
from ..sources.tables import table
from . import branches as B
from . import jobs as J
from . import registry as R
from .registry import WORDS, register

SQL_THIRD = f"""(SELECT '{D.NEXT_VERSION}' AS version, printf('%s/%s/%d.md', lang, source, doc_id) AS file_path, text AS content
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))"""
VERSIONS = [D.OLD_VERSION, D.NEW_VERSION, D.NEXT_VERSION]


# --------------------------------------------------------------------------- D5
@register("section_timeline", f"""
WITH s AS (SELECT 1 AS pos, * FROM ({R._sql_secs(R.SQL_OLD)}) UNION ALL SELECT 2, * FROM ({R._sql_secs(R.SQL_NEW)})
           UNION ALL SELECT 3, * FROM ({R._sql_secs(SQL_THIRD)})),
     v AS (SELECT * FROM (VALUES {', '.join(f"({k + 1}, '{v}')" for k, v in enumerate(VERSIONS))}) t(pos, version)),
     p AS (SELECT file_path, heading, occurrence, max(CASE WHEN pos = 1 THEN h END) AS h1,
                  max(CASE WHEN pos = 2 THEN h END) AS h2, max(CASE WHEN pos = 3 THEN h END) AS h3
           FROM s GROUP BY file_path, heading, occurrence),
     g AS (SELECT *, 1 AS lo, 3 AS hi, (h1 <> h2)::INT + (h2 <> h3)::INT AS n_edits FROM p WHERE h1 IS NOT NULL AND h2 IS NOT NULL AND h3 IS NOT NULL
           UNION ALL SELECT *, 1, 2, (h1 <> h2)::INT FROM p WHERE h1 IS NOT NULL AND h2 IS NOT NULL AND h3 IS NULL
           UNION ALL SELECT *, 2, 3, (h2 <> h3)::INT FROM p WHERE h1 IS NULL AND h2 IS NOT NULL AND h3 IS NOT NULL
           UNION ALL SELECT *, 1, 1, 0 FROM p WHERE h1 IS NOT NULL AND h2 IS NULL
           UNION ALL SELECT *, 2, 2, 0 FROM p WHERE h1 IS NULL AND h2 IS NOT NULL AND h3 IS NULL
           UNION ALL SELECT *, 3, 3, 0 FROM p WHERE h2 IS NULL AND h3 IS NOT NULL)
SELECT file_path, heading, occurrence, a.version AS valid_from, b.version AS valid_to, hi - lo + 1 AS n_versions, n_edits,
       CASE WHEN hi < 3 THEN 'deprecated' WHEN lo = 3 AND h1 IS NOT NULL THEN 'returned' WHEN lo > 1 THEN 'added'
            ELSE 'original' END AS status
FROM g JOIN v a ON a.pos = lo JOIN v b ON b.pos = hi""")
def q_section_timeline(spark, sf_dir):
    """Stretches of versions that hold each section, over three versions of the tree."""
    return VS.section_timeline(D.three_versions(spark, sf_dir), VERSIONS, WORDS)


# --------------------------------------------------------------------------- D9
@register("term_associations", rf"""
WITH w AS (SELECT row_number() OVER () AS d, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
           FROM documents),
     p AS (SELECT d, unnest(w) AS t, unnest(range(len(w))) AS i FROM w),
     df AS (SELECT t, count(DISTINCT d) AS n FROM p GROUP BY t),
     pr AS (SELECT DISTINCT x.d, least(x.t, y.t) AS a, greatest(x.t, y.t) AS b
            FROM (SELECT p.*, p.i + k AS j FROM p, range(1, {AS.WINDOW + 1}) r(k)) x JOIN p y ON x.d = y.d AND y.i = x.j WHERE x.t <> y.t),
     c AS (SELECT a, b, count(*) AS n_both FROM pr GROUP BY a, b HAVING count(*) >= {AS.MIN_SUPPORT}),
     m AS (SELECT a AS term, b AS synonym, n_both FROM c UNION ALL SELECT b, a, n_both FROM c)
SELECT term, synonym, rank, n_term, n_synonym, n_both FROM (
  SELECT m.*, x.n AS n_term, y.n AS n_synonym, row_number() OVER (PARTITION BY m.term
         ORDER BY m.n_both::DOUBLE / sqrt(x.n::DOUBLE * y.n::DOUBLE) DESC, m.synonym) AS rank
  FROM m JOIN df x ON x.t = m.term JOIN df y ON y.t = m.synonym) WHERE rank <= {AS.TOP}""")
def q_term_associations(spark, sf_dir):
    """The strongest partners of every word of the documents (D9): a learned synonym table."""
    return AS.term_associations(table(spark, sf_dir, "documents", "text"))


# --------------------------------------------------------------------------- D11
@register("section_retry", f"""
WITH c AS (SELECT version, file_path, count(*) AS n_chunks, sum(CASE WHEN length(content) % 7 = 0 THEN 1 ELSE 0 END) AS n_refused
           FROM ({R._sql_chunks(R.SQL_BOTH_DOCS)}) GROUP BY version, file_path)
SELECT version, file_path, n_chunks - n_refused AS n_first, CASE WHEN n_refused > 0 THEN 'partial' ELSE 'whole' END AS status_first,
       n_chunks AS n_last FROM c WHERE n_chunks > n_refused""")
def q_section_retry(spark, sf_dir):
    """A run whose embedder refuses some chunks, then a retry of those alone (D11): indexed
    chunks of every searchable file after either."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tomefold/sections-{uuid.uuid4().hex}"
    docs = R.both_docs(spark, sf_dir)

    def refusing(df):
        return EM.embed_with(df, B._flaky, "content", batch_size=16, base_delay=0.0, batch_delay=0.0, sleep=lambda s: None)

    def states(folder):
        df = PA.section_states(IX.read_or_empty(spark, f"{base}/failed_chunks", PA.FAILED_SCHEMA),
                               IX.read_or_empty(spark, IX.chunks_dir(spark, base), IX.INDEX_SCHEMA),
                               IX.read_or_empty(spark, f"{base}/ledger", IX.LEDGER_SCHEMA))
        df.write.parquet(f"{base}/{folder}")
        return spark.read.schema(df.schema).parquet(f"{base}/{folder}")

    J.ingest_sections(spark, docs, base, WORDS, refusing)
    first = states("first")
    J.retry_failed(spark, base)
    last = states("last").filter(F.col("status") == "whole")
    return first.join(last.select("version", "file_path", F.col("n_indexed").alias("n_last")), ["version", "file_path"]).select(
        "version", "file_path", F.col("n_indexed").alias("n_first"), F.col("status").alias("status_first"), "n_last")
