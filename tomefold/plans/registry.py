"""Registered queries: Spark DataFrame builders and their DuckDB oracle SQL.

Each Spark builder takes ``(spark, sf_dir)`` and reads whole tables; each
oracle string runs in DuckDB over the same tables.  Column names agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import chunk as CH
from ..session import ensure_checkpoint_dir, written
from ..sources import derived as D
from ..sources.tables import table
from . import sql_twins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# oracle-checked queries count tokens as words: the SQL twins reproduce that counter
WORDS = CH.ChunkParams(counter="words")
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --------------------------------------------------------------------------- SQL sources
V = C.DEFAULT_VERSION
SQL_DOC_DOCS = (f"SELECT '{V}' AS version, printf('%s/%s/%d.md', lang, source, doc_id) AS file_path, "
                f"text AS content FROM documents")
SQL_CONV_DOCS = (
    f"SELECT '{V}' AS version, printf('conversations/%d.md', conv_id) AS file_path, "
    f"printf('# Conversation %d', conv_id) || chr(10) || chr(10) || string_agg("
    f"printf('## Turn %d (%s)', turn, role) || chr(10) || chr(10) || text || chr(10), chr(10) "
    f"ORDER BY turn, role, text) AS content FROM conversations GROUP BY conv_id")
_URL = "'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)'"


def sql_page_path(url: str, page_id: str = "page_id") -> str:
    path = f"regexp_replace(regexp_replace(regexp_extract({url}, {_URL}, 2), '^/+|/+$', '', 'g'), '\\.html?$', '')"
    return (f"(regexp_extract({url}, {_URL}, 1) || '/' || "
            f"(CASE WHEN {path} = '' THEN 'index' ELSE {path} END) || '/' || CAST({page_id} AS VARCHAR) || '.md')")


def both_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.document_docs(spark, sf_dir).unionByName(D.conversation_docs(spark, sf_dir))


SQL_BOTH_DOCS = f"({SQL_DOC_DOCS} UNION ALL {SQL_CONV_DOCS})"


# --------------------------------------------------------------------------- P1-P3, P7
@register("path_metadata", f"""
SELECT page_id, {sql_page_path('url')} AS file_path,
       {S.section(sql_page_path('url'))} AS section,
       {S.content_type(sql_page_path('url'))} AS content_type,
       {S.doc_url(sql_page_path('url'))} AS doc_url
FROM pages""")
def q_path_metadata(spark, sf_dir):
    """Section, content type and URL of every page path."""
    p = table(spark, sf_dir, "pages", "page_id", "url").withColumn("file_path", D.page_file_path("url", "page_id"))
    return p.select("page_id", "file_path", T.section_of("file_path").alias("section"),
                    T.content_type_of("file_path").alias("content_type"),
                    T.doc_url_of("file_path").alias("doc_url"))


# --------------------------------------------------------------------------- P5
@register("headings", f"""
SELECT file_path, len(h) AS n_headings, array_to_string(h, ' | ') AS headings
FROM (SELECT file_path, {S.heading_list('content')} AS h FROM {SQL_BOTH_DOCS})""")
def q_headings(spark, sf_dir):
    """Heading list of every document and conversation file (P5)."""
    d = both_docs(spark, sf_dir).select("file_path", T.heading_list("content").alias("h"))
    return d.select("file_path", F.size("h").alias("n_headings"),
                    F.array_join("h", " | ").alias("headings"))


# --------------------------------------------------------------------------- P6, P7
@register("title_url", f"""
SELECT file_path, {S.title(S.heading_list('content'), 'file_path')} AS title,
       {S.doc_url('file_path')} AS doc_url
FROM {SQL_BOTH_DOCS}""")
def q_title_url(spark, sf_dir):
    """Title (first heading or file stem) and URL of every file."""
    d = both_docs(spark, sf_dir)
    return d.select("file_path", T.title_of(T.heading_list("content"), "file_path").alias("title"),
                    T.doc_url_of("file_path").alias("doc_url"))


# --------------------------------------------------------------------------- P9
@register("has_code", f"""
SELECT file_path, {S.has_code('content')} AS has_code FROM {SQL_BOTH_DOCS}""")
def q_has_code(spark, sf_dir):
    """Code flag of every file's whole text."""
    return both_docs(spark, sf_dir).select("file_path", T.has_code("content").alias("has_code"))


# --------------------------------------------------------------------------- P10
@register("token_count", f"""
SELECT doc_id, {S.tok('text')} AS n_tokens, length(text) AS n_chars FROM documents""")
def q_token_count(spark, sf_dir):
    """Word tokens and characters of every document (P10)."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", T.token_count("text").alias("n_tokens"), F.length("text").alias("n_chars"))


# --------------------------------------------------------------------------- P11
@register("overlap_tail", f"""
SELECT doc_id, {S.overlap('text', C.OVERLAP_TOKENS)} AS tail FROM documents""")
def q_overlap_tail(spark, sf_dir):
    """Text of the last 175 tokens of every document."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", T.overlap_tail("text", C.OVERLAP_TOKENS).alias("tail"))


# --------------------------------------------------------------------------- T1
@register("split_sections", f"""
SELECT file_path, sec_idx, section, {S.tok('section')} AS n_tokens
FROM (SELECT file_path, unnest(range(len(secs))) AS sec_idx, unnest(secs) AS section
      FROM (SELECT file_path, {S.split_by_headers('content')} AS secs FROM {SQL_BOTH_DOCS}))""")
def q_split_sections(spark, sf_dir):
    """Sections split at column-0 headers."""
    return CH.sections_of(both_docs(spark, sf_dir), merged=False, params=WORDS).drop("version")


# --------------------------------------------------------------------------- T2
@register("merge_sections", f"""
SELECT file_path, sec_idx, section, {S.tok('section')} AS n_tokens
FROM (SELECT file_path, unnest(range(len(secs))) AS sec_idx, unnest(secs) AS section
      FROM (SELECT file_path, {S.merge_small(S.split_by_headers('content'))} AS secs FROM {SQL_BOTH_DOCS}))""")
def q_merge_sections(spark, sf_dir):
    """Sections after the small-section merge."""
    return CH.sections_of(both_docs(spark, sf_dir), merged=True, params=WORDS).drop("version")


# --------------------------------------------------------------------------- T4, W1, P8, P12
def _sql_chunks(docs_sql: str) -> str:
    return f"""
SELECT version, file_path, chunk_index, raw_chunk, heading_path,
       {S.chunk_id(S.full_path('file_path'), 'chunk_index', 'raw_chunk')} AS chunk_id,
       {S.strip('raw_chunk')} AS content,
       {S.section('file_path')} AS section,
       {S.content_type('file_path')} AS content_type,
       {S.title('heading_path', 'file_path')} AS title,
       {S.has_code('raw_chunk')} AS has_code,
       {S.doc_url('file_path')} AS doc_url
FROM (SELECT version, file_path, heading_path,
             unnest(range(len(chunks))) AS chunk_index, unnest(chunks) AS raw_chunk
      FROM (SELECT version, file_path, {S.heading_list('content')} AS heading_path,
                   {S.chunk_texts('content')} AS chunks
            FROM ({docs_sql}) WHERE NOT {S.is_blank('content')}))"""


SQL_CHUNKS_BOTH = _sql_chunks(SQL_BOTH_DOCS)


@register("chunk_docs", f"""
SELECT version, file_path, chunk_index, chunk_id, content, section, content_type, title,
       array_to_string(heading_path, ' | ') AS heading_path, has_code, doc_url
FROM ({SQL_CHUNKS_BOTH})""")
def q_chunk_docs(spark, sf_dir):
    """All chunks of the documents and conversation files with metadata."""
    c = CH.chunk_documents(both_docs(spark, sf_dir), WORDS)
    return c.select("version", "file_path", "chunk_index", "chunk_id", "content", "section",
                    "content_type", "title", F.array_join("heading_path", " | ").alias("heading_path"),
                    "has_code", "doc_url")


@register("chunk_ids", f"""
SELECT file_path, chunk_index, chunk_id, {S.tok('raw_chunk')} AS n_tokens, length(content) AS n_chars
FROM ({SQL_CHUNKS_BOTH})""")
def q_chunk_ids(spark, sf_dir):
    """Chunk ids, positions and sizes."""
    c = CH.chunk_documents(both_docs(spark, sf_dir), WORDS)
    return c.select("file_path", "chunk_index", "chunk_id", T.token_count("raw_chunk").alias("n_tokens"),
                    F.length("content").alias("n_chars"))


# --------------------------------------------------------------------------- E1
from ..operators import embed as EM  # noqa: E402
from ..operators import knn as KN  # noqa: E402
from ..operators import search as SE  # noqa: E402

DIM = C.EMBED_DIM
DBL = "CAST({} AS DOUBLE)".format


def sql_vectors(src: str, key: str, text: str) -> str:
    """Hashed signed-count vectors in DuckDB: one row (key, vec DOUBLE[]) per text with tokens."""
    e = S._v("e")
    i = S._v("i")
    return f"""(SELECT {key}, list_transform(range({DIM}), lambda {i}:
              coalesce(list_filter(pairs, lambda {e}: {e}.b = {i})[1].v, 0))::DOUBLE[] AS vec
       FROM (SELECT {key}, list({{'b': b, 'v': v}}) AS pairs
             FROM (SELECT {key}, h % {DIM} AS b, sum(CASE WHEN (h // {DIM}) % 2 = 0 THEN 1 ELSE -1 END) AS v
                   FROM (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h
                         FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '{EM.HASH_TOKEN_PATTERN}')) AS w
                               FROM {src}))
                   GROUP BY ALL)
             GROUP BY {key}))"""


@register("embed_hashed", f"""
SELECT d.doc_id, array_to_string(list_transform(v.vec, lambda x: CAST(x AS INTEGER)), ',') AS vector,
       CAST(list_dot_product(v.vec, v.vec) AS BIGINT) AS norm2
FROM documents d LEFT JOIN {sql_vectors('documents', 'doc_id', 'text')} v USING (doc_id)""")
def q_embed_hashed(spark, sf_dir):
    """Hashed bag-of-words vector of every document."""
    d = EM.embed_hashed(table(spark, sf_dir, "documents", "doc_id", "text"), "text")
    return d.select("doc_id", F.array_join(F.transform("vector", lambda x: x.cast("int")), ",").alias("vector"),
                    F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x).cast("bigint").alias("norm2"))


# --------------------------------------------------------------------------- J2
def sql_score(a: str, b: str) -> str:
    return (f"floor(list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
            f" * 1e9 + 0.5) / 1e9")


@register("knn_topk", f"""
SELECT qid, item_id, score, rank FROM (
  SELECT q.vec_id AS qid, CAST(i.vec_id AS VARCHAR) AS item_id,
         {sql_score('q.embedding::DOUBLE[]', 'i.embedding::DOUBLE[]')} AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY {sql_score('q.embedding::DOUBLE[]', 'i.embedding::DOUBLE[]')} DESC,
                            CAST(i.vec_id AS VARCHAR)) AS rank
  FROM embeddings q CROSS JOIN embeddings i)
WHERE rank <= 10""")
def q_knn_topk(spark, sf_dir):
    """Exact top-10 neighbours of every driver vector among all of them."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    it = e.select(F.col("vec_id").cast("string").alias("item_id"), F.col("embedding").alias("vector"))
    return KN.knn(q, it, 10).select("qid", "item_id", "score", F.col("rank").cast("int").alias("rank"))


# --------------------------------------------------------------------------- search
SQL_TWO_VERSIONS = f"""(
SELECT '{D.OLD_VERSION}' AS version, printf('%s/%s/%d.md', lang, source, doc_id) AS file_path, text AS content
FROM documents
UNION ALL
SELECT '{D.NEW_VERSION}', printf('%s/%s/%d.md', d.lang, d.source, d.doc_id),
       CASE WHEN l.toxic = 1 THEN d.text || {S.lit(D.REVISION_NOTE)} ELSE d.text END
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 1) <> 0
UNION ALL
SELECT '{D.NEW_VERSION}', printf('bench/%d.md', item_id), text FROM benchmark)"""


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = D.two_versions(spark, sf_dir)
    chunks = CH.chunk_documents(old.unionByName(new), WORDS)
    # derived here from the tables; read by the kNN scan and the payload join
    return written(EM.embed_hashed(chunks, "content"), "search-index")


def search_queries(spark: SparkSession, sf_dir: str, limit=None, min_score=None) -> DataFrame:
    """Every benchmark text as a query without a version filter and with each version."""
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    variants = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(v).cast("string").alias("version"))
                         for j, v in [(0, None), (1, D.OLD_VERSION), (2, D.NEW_VERSION)]])
    return b.select("item_id", "text", F.explode(variants).alias("f")).select(
        (F.col("item_id") * 10 + F.col("f.j")).alias("qid"), F.col("text").alias("query"), F.col("f.version").alias("version"),
        F.lit(limit).cast("int").alias("limit"), F.lit(min_score).cast("double").alias("min_score"))


def _sql_search(limit: int, min_score: float, stages: tuple[str, ...]) -> str:
    stage_list = ", ".join(f"'{s}'" for s in stages)
    return _sql_search_ctes(limit, min_score) + f"\nSELECT * FROM results WHERE stage IN ({stage_list})"


def sql_boost(query: str, content_type: str, title: str, heading_path: str, has_code: str,
              content: str) -> str:
    """DuckDB twin of ``search.boost_factor`` (same additions in the same order)."""
    t, h = S._v("t"), S._v("acc")
    type_hit = " OR ".join(f"contains(lower(coalesce({content_type}, '')), '{x}')" for x in C.TYPE_TERMS)
    code_q = " OR ".join(f"contains(lower({query}), '{x}')" for x in C.CODE_QUERY_PHRASES)
    ui_q = " OR ".join(f"contains(lower({query}), '{x}')" for x in C.UI_QUERY_TERMS)
    ui_c = " OR ".join(f"contains(lower(coalesce({content}, '')), '{x}')" for x in C.UI_CONTENT_TERMS)
    terms = f"list_filter(regexp_split_to_array(lower({query}), '{C.WS_CLASS}+'), lambda {t}: {t} <> '')"
    zero = "CAST(0.0 AS DOUBLE)"
    b0 = f"(CAST(1.0 AS DOUBLE) + CASE WHEN {type_hit} THEN {DBL(C.TYPE_BOOST)} ELSE {zero} END)"
    b1 = (f"list_reduce({terms}, lambda {h}, {t}: ({h} + CASE WHEN contains(lower(coalesce({title}, '')), {t}) "
          f"THEN {DBL(C.TITLE_TERM_BOOST)} ELSE {zero} END) + CASE WHEN "
          f"contains(lower(array_to_string(coalesce({heading_path}, []::VARCHAR[]), ' ')), {t}) "
          f"THEN {DBL(C.HEADING_TERM_BOOST)} ELSE {zero} END, {b0})")
    b2 = f"({b1} + CASE WHEN coalesce({has_code}, false) AND ({code_q}) THEN {DBL(C.CODE_BOOST)} ELSE {zero} END)"
    return f"({b2} + CASE WHEN ({ui_q}) AND ({ui_c}) THEN {DBL(C.UI_BOOST)} ELSE {zero} END)"


SQL_SEARCH_QUERIES = (
    f"SELECT item_id * 10 + j AS qid, text AS query, v AS version "
    f"FROM benchmark CROSS JOIN (VALUES (0, NULL), (1, '{D.OLD_VERSION}'), (2, '{D.NEW_VERSION}')) f(j, v)")


def _sql_search_ctes(limit: int, min_score: float, chunks: str | None = None, queries: str = SQL_SEARCH_QUERIES) -> str:
    L, M = limit, DBL(min_score)
    b3 = sql_boost("q.query", "c.content_type", "c.title", "c.heading_path", "c.has_code", "c.content")
    no_res = C.NO_RESULTS_TEXT.split("{query}")
    cols = ("content, coalesce(title, '') AS title, file_path, coalesce(section, '') AS section, "
            "coalesce(doc_url, '') AS doc_url, coalesce(array_to_string(heading_path, ' | '), '') AS heading_path, "
            "coalesce(has_code, false) AS has_code, coalesce(content_type, '') AS content_type, version")
    return f"""
WITH chunks AS ({chunks or _sql_chunks(SQL_TWO_VERSIONS)}),
items AS (SELECT version || '/' || chunk_id AS item_id, * FROM chunks),
ivec AS {sql_vectors('items', 'item_id', 'content')},
queries AS ({queries}),
qvec AS {sql_vectors('queries', 'qid', 'query')},
scored AS (
  SELECT qv.qid, iv.item_id, {sql_score('qv.vec', 'iv.vec')} AS score
  FROM qvec qv JOIN queries q USING (qid) CROSS JOIN ivec iv JOIN items i ON i.item_id = iv.item_id
  WHERE (q.version IS NULL OR q.version = '' OR q.version = i.version)
    AND list_dot_product(qv.vec, qv.vec) > 0 AND list_dot_product(iv.vec, iv.vec) > 0),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank
                 FROM scored WHERE score >= {DBL(C.FALLBACK_MIN_SCORE)})
  WHERE rank <= {C.CANDIDATE_CAP}),
cand AS (SELECT r.*, q.query, c.* EXCLUDE (item_id) FROM ranked r JOIN queries q USING (qid)
         JOIN items c ON c.item_id = r.item_id),
boosted AS (
  SELECT c.*, c.score * {b3} AS boosted FROM cand c JOIN queries q USING (qid)
  WHERE c.rank <= least({L} * 2, {C.CANDIDATE_CAP}) AND c.score >= greatest({M} - {DBL(C.CANDIDATE_MARGIN)}, {DBL(C.CANDIDATE_FLOOR)})),
first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY boosted DESC, rank) AS pos
                 FROM boosted WHERE boosted >= {M}) WHERE pos <= {L}),
fb AS (SELECT * FROM cand WHERE rank <= {C.FALLBACK_K} AND qid NOT IN (SELECT qid FROM first)),
results AS (
  SELECT qid, CAST(pos AS BIGINT) AS rank, 'hit' AS stage, {cols}, round(boosted, {C.SCORE_DIGITS}) AS similarity_score FROM first
  UNION ALL
  SELECT qid, CAST(rank AS BIGINT), 'fallback', {cols}, round(score, {C.SCORE_DIGITS}) FROM fb
  UNION ALL
  SELECT qid, 1, 'none', {S.lit(no_res[0])} || query || {S.lit(no_res[1])}, '{C.NO_RESULTS_TITLE}', '',
         '{C.NO_RESULTS_SECTION}', '', '', false, '{C.NO_RESULTS_TYPE}', coalesce(nullif(version, ''), '{C.UNKNOWN_VERSION}'),
         CAST(0.0 AS DOUBLE)
  FROM queries WHERE qid IN (SELECT qid FROM qvec) AND qid NOT IN (SELECT qid FROM first) AND qid NOT IN (SELECT qid FROM fb)
  UNION ALL
  SELECT qid, 1, 'error', 'Error searching knowledge base: the query has no usable embedding', '{C.ERROR_TITLE}', '',
         '{C.ERROR_SECTION}', '', '', false, '{C.ERROR_TYPE}', coalesce(nullif(version, ''), '{C.UNKNOWN_VERSION}'),
         CAST(0.0 AS DOUBLE)
  FROM queries WHERE qid NOT IN (SELECT qid FROM qvec))"""


def _search_out(df: DataFrame) -> DataFrame:
    return df.withColumn("heading_path", F.array_join("heading_path", " | "))


ALL_STAGES = ("hit", "fallback", "none", "error")


@register("search_full", _sql_search(C.SEARCH_LIMIT, C.SEARCH_MIN_SCORE, ALL_STAGES))
def q_search_full(spark, sf_dir):
    """All 600 benchmark queries against the two-version index: every result row."""
    return _search_out(SE.search(search_queries(spark, sf_dir), search_index(spark, sf_dir)))


@register("search_rerank", _sql_search(10, 0.3, ("hit",)))
def q_search_rerank(spark, sf_dir):
    """First-pass hits with limit 10 and min_score 0.3."""
    r = SE.search(search_queries(spark, sf_dir, 10, 0.3), search_index(spark, sf_dir))
    return _search_out(r.filter(F.col("stage") == "hit"))


@register("search_fallback", _sql_search(C.SEARCH_LIMIT, C.SEARCH_MIN_SCORE, ("fallback", "none")))
def q_search_fallback(spark, sf_dir):
    """Fallback and 'No Results' rows of the default search."""
    r = SE.search(search_queries(spark, sf_dir), search_index(spark, sf_dir))
    return _search_out(r.filter(F.col("stage").isin("fallback", "none")))




# --------------------------------------------------------------------------- index, ingest
from ..operators import cells as CE  # noqa: E402
from ..operators import blocks as BL  # noqa: E402
from ..operators import dedup as DD  # noqa: E402
from ..operators import index as IX  # noqa: E402
from ..operators import ingest as IN  # noqa: E402
from ..operators import quality as QA  # noqa: E402
from ..operators import versions as VS  # noqa: E402

SQL_OLD = f"(SELECT * FROM {SQL_TWO_VERSIONS} WHERE version = '{D.OLD_VERSION}')"
SQL_NEW = f"(SELECT * FROM {SQL_TWO_VERSIONS} WHERE version = '{D.NEW_VERSION}')"


@register("pair_vectors", """
SELECT coalesce(d.doc_id, e.vec_id) AS doc_id,
       CASE WHEN d.doc_id IS NULL THEN 'vector without chunk'
            WHEN e.vec_id IS NULL THEN 'missing vector'
            WHEN len(e.embedding) <> 64 THEN 'wrong vector size' ELSE 'paired' END AS status
FROM documents d FULL OUTER JOIN embeddings e ON d.doc_id = e.vec_id""")
def q_pair_vectors(spark, sf_dir):
    """Documents paired with their vectors; mismatches as error rows."""
    docs = table(spark, sf_dir, "documents", "doc_id")
    vecs = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    paired, errors = IX.pair_vectors(docs, vecs, key="doc_id", dim=DIM)
    return paired.select("doc_id", F.lit("paired").alias("status")).unionByName(
        errors.select("doc_id", F.col("error").alias("status")))


def _chunks_of(docs: DataFrame) -> DataFrame:
    return CH.chunk_documents(docs, WORDS).select("version", "file_path", "chunk_index", "chunk_id")


@register("upsert_index", f"""
WITH o AS (SELECT version, file_path, chunk_index, chunk_id FROM ({_sql_chunks(SQL_OLD)})),
     n AS (SELECT version, file_path, chunk_index, chunk_id FROM ({_sql_chunks(SQL_NEW)}))
SELECT * FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM n)
UNION ALL SELECT * FROM n""")
def q_upsert_index(spark, sf_dir):
    """Old-version chunks upserted with new-version chunks by point id."""
    old, new = D.two_versions(spark, sf_dir)
    return IX.upsert(_chunks_of(old), _chunks_of(new), mode="upsert")


def _relabel(df: DataFrame, version: str) -> DataFrame:
    return df.withColumn("version", F.lit(version))


@register("refresh_index", f"""
WITH oh AS (SELECT file_path, sha256(content) AS h FROM {SQL_OLD}),
     nh AS (SELECT file_path, sha256(content) AS h FROM {SQL_NEW}),
     same AS (SELECT file_path FROM oh JOIN nh USING (file_path) WHERE oh.h = nh.h),
     todo AS (SELECT file_path FROM nh WHERE file_path NOT IN (SELECT file_path FROM same)),
     o AS (SELECT file_path, chunk_index, chunk_id FROM ({_sql_chunks(SQL_OLD)})),
     n AS (SELECT file_path, chunk_index, chunk_id FROM ({_sql_chunks(
        f"SELECT * FROM {SQL_NEW} WHERE file_path IN (SELECT file_path FROM todo)")}))
SELECT * FROM o WHERE file_path IN (SELECT file_path FROM same)
UNION ALL SELECT * FROM n""")
def q_refresh_index(spark, sf_dir):
    """Incremental update (D7) applied to an index: changed and new files are
    re-chunked and replace their old rows; deleted files lose theirs."""
    old, new = D.two_versions(spark, sf_dir)
    v = D.NEW_VERSION
    ledger = IX.ledger_rows(_relabel(old, v), None, "previous")
    existing = _chunks_of(_relabel(old, v))
    ch = IN.changes(ledger, new)
    todo = new.join(ch.filter(F.col("status").isin("new", "changed")).select("file_path"), "file_path", "left_semi")
    gone = ch.filter(F.col("status") == "deleted").select("file_path")
    nxt = IX.upsert(existing.join(gone, "file_path", "left_anti"), _chunks_of(todo), mode="replace")
    return nxt.select("file_path", "chunk_index", "chunk_id")


@register("pending_docs", f"""
SELECT version, file_path FROM {SQL_NEW}
WHERE file_path NOT IN (SELECT file_path FROM {SQL_OLD})""")
def q_pending_docs(spark, sf_dir):
    """New-version files not yet in the ledger by path."""
    old, new = D.two_versions(spark, sf_dir)
    ledger = _relabel(old, D.NEW_VERSION).select("version", "file_path")
    return IN.pending_by_path(new, ledger).select("version", "file_path")


@register("incremental_changes", f"""
WITH l AS (
  SELECT version, file_path, sha256(content) AS h, 1 AS ts FROM {SQL_OLD}
  UNION ALL SELECT '{D.NEW_VERSION}', file_path, sha256(content), 1 FROM {SQL_OLD}
  UNION ALL SELECT '{D.NEW_VERSION}', file_path, NULL, 2 FROM {SQL_OLD} WHERE split_part(file_path, '/', 2) IN ('src1', 'src2', 'src3')
  UNION ALL SELECT '{D.NEW_VERSION}', file_path, sha256(content), 3 FROM {SQL_OLD} WHERE split_part(file_path, '/', 2) IN ('src2', 'src3')
  UNION ALL SELECT '{D.NEW_VERSION}', file_path, NULL, 4 FROM {SQL_OLD} WHERE split_part(file_path, '/', 2) = 'src3'),
o AS (SELECT file_path, h FROM (SELECT *, row_number() OVER (PARTITION BY version, file_path ORDER BY ts DESC) AS r FROM l)
      WHERE r = 1 AND h IS NOT NULL AND version = '{D.NEW_VERSION}'),
n AS (SELECT file_path, sha256(content) AS h FROM {SQL_NEW})
SELECT '{D.NEW_VERSION}' AS version, file_path,
       CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted'
            WHEN o.h <> n.h THEN 'changed' ELSE 'same' END AS status
FROM o FULL OUTER JOIN n USING (file_path)""")
def q_incremental_changes(spark, sf_dir):
    """new / changed / deleted / same per file by content hash.

    The ledger holds the old tree under both versions; under the new one, the
    files of three sources were deleted, those of two came back, and those of
    one were deleted again."""
    old, new = D.two_versions(spark, sf_dir)
    source = F.split_part(F.col("file_path"), F.lit("/"), F.lit(2))
    here = _relabel(old, D.NEW_VERSION)

    def run(docs, k):
        led = IX.ledger_rows(docs, None, f"run{k}")
        return led.withColumn("ts", F.timestamp_seconds(F.lit(k)))

    def gone(docs, k):
        return IX.tombstones(docs, f"run{k}").withColumn("ts", F.timestamp_seconds(F.lit(k)))

    ledger = (run(old, 1).unionByName(run(here, 1))
              .unionByName(gone(here.filter(source.isin("src1", "src2", "src3")), 2))
              .unionByName(run(here.filter(source.isin("src2", "src3")), 3))
              .unionByName(gone(here.filter(source == "src3"), 4)))
    return IN.changes(ledger, new, [D.NEW_VERSION])


@register("coverage", f"""
WITH d AS (SELECT version, file_path, {S.is_blank('content')} AS blank FROM {SQL_BOTH_DOCS}),
     c AS (SELECT version, file_path, count(*) AS n FROM ({SQL_CHUNKS_BOTH}) GROUP BY ALL),
     s AS (SELECT d.version, CASE WHEN blank THEN 'empty' WHEN coalesce(c.n, 0) = 0 THEN 'no_chunks'
                  ELSE 'processed' END AS status, coalesce(c.n, 0) AS n
           FROM d LEFT JOIN c USING (version, file_path))
SELECT version, status, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_chunks FROM s GROUP BY ALL""")
def q_coverage(spark, sf_dir):
    """Files per status with their chunk counts."""
    docs = both_docs(spark, sf_dir)
    return IN.coverage_summary(IN.coverage(docs, CH.chunk_documents(docs, WORDS)))


SQL_INDEX = f"""(WITH chunks AS ({_sql_chunks(SQL_TWO_VERSIONS)}),
  items AS (SELECT version || '/' || chunk_id AS item_id, * FROM chunks)
  SELECT i.*, v.vec FROM items i LEFT JOIN {sql_vectors('items', 'item_id', 'content')} v USING (item_id))"""


@register("index_stats", f"""
SELECT version, count(*) AS n_chunks, count(DISTINCT file_path) AS n_files,
       CAST(sum(CAST(has_code AS INTEGER)) AS BIGINT) AS n_code_chunks,
       CAST(sum(CASE WHEN vec IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_without_vector
FROM {SQL_INDEX} GROUP BY version""")
def q_index_stats(spark, sf_dir):
    """Chunks, files, code chunks and missing vectors per version."""
    return IX.index_stats(search_index(spark, sf_dir))


@register("chunk_quality", f"""
SELECT version, count(*) AS n_chunks, avg(n_tokens) AS avg_tokens,
       quantile_cont(n_tokens, 0.5) AS p50_tokens, quantile_cont(n_tokens, 0.9) AS p90_tokens,
       max(n_tokens) AS max_tokens, CAST(sum(CAST(has_code AS INTEGER)) AS BIGINT) AS n_code,
       CAST(sum(CAST(content_type = 'tutorial' AS INTEGER)) AS BIGINT) AS n_tutorial,
       CAST(sum(CAST(content_type = 'example' AS INTEGER)) AS BIGINT) AS n_example,
       CAST(sum(CAST(content_type = 'api' AS INTEGER)) AS BIGINT) AS n_api,
       CAST(sum(CAST(content_type = 'reference' AS INTEGER)) AS BIGINT) AS n_reference,
       CAST(sum(CASE WHEN vec IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_no_vector,
       CAST(sum(CASE WHEN len(vec) <> {DIM} THEN 1 ELSE 0 END) AS BIGINT) AS n_bad_dim,
       CAST(sum(CASE WHEN list_dot_product(vec, vec) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero_vector
FROM (SELECT *, {S.tok('content')} AS n_tokens FROM {SQL_INDEX}) GROUP BY version""")
def q_chunk_quality(spark, sf_dir):
    """Chunk size distribution, type counts and vector checks per version."""
    return QA.chunk_quality(search_index(spark, sf_dir), DIM)


# --------------------------------------------------------------------------- D1, D3
def _sql_norm(x: str) -> str:
    return f"lower({S.strip(f'regexp_replace({x}, {chr(39)}{C.WS_CLASS}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')})"


@register("exact_dups", f"""
WITH h AS (SELECT doc_id, sha256({_sql_norm('text')}) AS text_hash FROM documents),
     g AS (SELECT text_hash, min(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_hash)
SELECT doc_id, text_hash, group_size, keep_id, doc_id = keep_id AS keep FROM h JOIN g USING (text_hash)""")
def q_exact_dups(spark, sf_dir):
    """Exact duplicate groups of the documents after normalisation."""
    return DD.exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


BP_SHARE, BP_MIN_DOCS = 0.01, 3
_SQL_LINES = (f"SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line "
              f"FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)")
_SQL_BP = (f"SELECT norm, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, {S.strip('line')} AS norm "
           f"FROM ({_SQL_LINES})) WHERE norm <> '' GROUP BY norm "
           f"HAVING count(DISTINCT doc_id) >= greatest({BP_MIN_DOCS}, "
           f"CAST(ceil({BP_SHARE} * (SELECT count(*) FROM documents)) AS BIGINT))")


@register("boilerplate_lines", _SQL_BP)
def q_boilerplate_lines(spark, sf_dir):
    """Lines repeated across at least 1 % of the documents (D3)."""
    return DD.boilerplate_lines(table(spark, sf_dir, "documents", "doc_id", "text"),
                                share=BP_SHARE, min_docs=BP_MIN_DOCS)


@register("strip_boilerplate", f"""
WITH l AS ({_SQL_LINES}), bp AS ({_SQL_BP}),
     k AS (SELECT * FROM l WHERE {S.strip('line')} NOT IN (SELECT norm FROM bp))
SELECT d.doc_id, len(string_split(d.text, chr(10))) AS n_lines, coalesce(x.n_kept, 0) AS n_kept,
       coalesce(x.clean_text, '') AS clean_text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY pos) AS clean_text
                            FROM k GROUP BY doc_id) x USING (doc_id)""")
def q_strip_boilerplate(spark, sf_dir):
    """Documents rebuilt without their boilerplate lines (D3)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return DD.strip_boilerplate(docs, DD.boilerplate_lines(docs, share=BP_SHARE, min_docs=BP_MIN_DOCS))


_SQL_BLOCKS = f"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, list_filter(range(1, len(ls) + 1), lambda i: {S.strip('ls[i]')} <> '') AS nb,
             list_filter(list_transform(ls, lambda x: {S.strip('x')}), lambda x: x <> '') AS ls FROM raw),
starts AS (SELECT doc_id, nb, ls, unnest(range(1, len(ls) + 1)) AS i FROM n),
runs AS (SELECT *, unnest(range(1, len(ls) - i + 2)) AS l FROM starts),
occ AS (SELECT doc_id, i, l, nb[i] AS a, nb[i + l - 1] AS z, array_to_string(ls[i:i + l - 1], chr(10)) AS block FROM runs),
freq AS (SELECT l, block, count(DISTINCT doc_id) AS n_docs FROM occ GROUP BY l, block HAVING count(DISTINCT doc_id) >= 3),
best AS (SELECT doc_id, i, max(l) AS l FROM occ JOIN freq USING (l, block) GROUP BY doc_id, i),
top AS (SELECT b.* FROM best b LEFT JOIN best p ON p.doc_id = b.doc_id AND p.i = b.i - 1
        WHERE b.l >= 2 AND coalesce(p.l, 0) <= b.l),
places AS (SELECT * FROM top JOIN occ USING (doc_id, i, l))"""


@register("repeated_blocks", _SQL_BLOCKS + """
SELECT block, l AS n_lines, n_docs, count(*) AS n_places FROM places JOIN freq USING (l, block) GROUP BY block, l, n_docs""")
def q_repeated_blocks(spark, sf_dir):
    """Maximal runs of two or more lines that stand in three or more documents (D3)."""
    return BL.repeated_blocks(table(spark, sf_dir, "documents", "doc_id", "text"))


@register("strip_blocks", _SQL_BLOCKS + """,
cut AS (SELECT doc_id, list(a) AS aa, list(z) AS zz FROM places GROUP BY doc_id),
kept AS (SELECT doc_id, text, len(ls) AS n, aa, list_filter(range(1, len(ls) + 1), lambda p: len(list_filter(range(1, len(aa) + 1),
                lambda k: aa[k] <= p AND p <= zz[k])) = 0) AS k, ls FROM raw LEFT JOIN cut USING (doc_id))
SELECT doc_id, CASE WHEN aa IS NULL THEN 0 ELSE n - len(k) END AS n_removed,
       CASE WHEN aa IS NULL THEN text ELSE coalesce(array_to_string(list_transform(k, lambda p: ls[p]), chr(10)), '') END AS clean_text
FROM kept""")
def q_strip_blocks(spark, sf_dir):
    """Documents without their repeated blocks (D3)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return BL.strip_blocks(docs, BL.block_places(docs)[0])


SQL_SHINGLE_PAIRS = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS sh
  FROM words WHERE len(w) > 0),
tokens AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS token FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.7)"""


@register("near_dups", SQL_SHINGLE_PAIRS + """,
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
labels AS (SELECT a AS doc_id, least(a, min(b)) AS component FROM reach GROUP BY a)
SELECT doc_id, component, count(*) OVER (PARTITION BY component) AS component_size FROM labels""")
def q_near_dups(spark, sf_dir):
    """Near-duplicate components of the documents: all pairs of a Jaccard similarity of 0.7 or more."""
    return DD.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


SEMANTIC_SCORE = 0.35


@register("semantic_dups", f"""
WITH reps AS (SELECT min(CAST(vec_id AS VARCHAR)) AS id, embedding::DOUBLE[] AS v FROM embeddings GROUP BY embedding)
SELECT a.id AS a, b.id AS b, {sql_score('a.v', 'b.v')} AS score
FROM reps a JOIN reps b ON a.id < b.id WHERE {sql_score('a.v', 'b.v')} >= {SEMANTIC_SCORE}""")
def q_semantic_dups(spark, sf_dir):
    """Semantic near duplicates: all pairs of different vectors with a cosine of at least SEMANTIC_SCORE."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    it = e.select(F.col("vec_id").cast("string").alias("item_id"), F.col("embedding").alias("vector"))
    return CE.similar_pairs(it, SEMANTIC_SCORE, KN._dim_of(it.select(F.col("vector").alias("qvec"))))[0]


# --------------------------------------------------------------------------- D5
def _sql_secs(docs_sql: str) -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY file_path, heading ORDER BY sec_idx) AS occurrence FROM ("
            f"SELECT file_path, sec_idx, sha256(section) AS h, {S.tok('section')} AS n, "
            f"CASE WHEN starts_with(section, '#') THEN {S.strip('split_part(section, chr(10), 1)')} ELSE '' END AS heading "
            f"FROM (SELECT file_path, unnest(range(len(secs))) AS sec_idx, unnest(secs) AS section FROM ("
            f"SELECT file_path, {S.split_by_headers('content')} AS secs FROM {docs_sql})))")


@register("version_diff", f"""
SELECT file_path, heading, occurrence,
       CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed'
            WHEN o.h <> n.h THEN 'changed' ELSE 'same' END AS status,
       coalesce(o.n, 0) AS old_tokens, coalesce(n.n, 0) AS new_tokens
FROM ({_sql_secs(SQL_OLD)}) o FULL OUTER JOIN ({_sql_secs(SQL_NEW)}) n USING (file_path, heading, occurrence)""")
def q_version_diff(spark, sf_dir):
    """Section-by-section comparison of the two versions."""
    old, new = D.two_versions(spark, sf_dir)
    return VS.section_diff(old, new, WORDS)


# --------------------------------------------------------------------------- D12
@register("retrieval_accuracy", f"""
WITH s AS (SELECT q.vec_id AS qid, CAST(i.vec_id AS VARCHAR) AS item_id, q.label AS qlabel, i.label AS ilabel,
                  {sql_score('q.embedding::DOUBLE[]', 'i.embedding::DOUBLE[]')} AS score
           FROM embeddings q CROSS JOIN embeddings i WHERE q.vec_id <> i.vec_id),
     r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS pos FROM s)
           WHERE pos <= 10),
     pq AS (SELECT qid, qlabel, sum(CAST(qlabel = ilabel AS INTEGER)) / 10 AS p_at_k,
                   coalesce(1.0 / min(CASE WHEN qlabel = ilabel THEN pos END), 0.0) AS rr
            FROM r GROUP BY qid, qlabel)
SELECT CAST(qlabel AS BIGINT) AS label, count(*) AS n_queries, round(avg(p_at_k), 9) AS precision_at_k, round(avg(rr), 9) AS mrr
FROM pq GROUP BY qlabel""")
def q_retrieval_accuracy(spark, sf_dir):
    """Leave-one-out precision@10 and MRR per label over the driver vectors."""
    return QA.retrieval_accuracy(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))




# --------------------------------------------------------------------------- T0, F9, D13
from ..operators import convert as CV  # noqa: E402


def converted_pages(spark: SparkSession, sf_dir: str, selector=CV.DEFAULT_SELECTOR) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "url", "html").withColumn("file_path", D.page_file_path("url", "page_id"))
    return CV.pages_to_markdown(p, selector)


def _md_counts(c: DataFrame) -> DataFrame:
    return c.select("page_id", "file_path",
                    F.regexp_count("markdown", F.lit(r"(?m)^#{1,6}( |$)")).alias("n_headings"),
                    F.regexp_count("markdown", F.lit(r"\]\(")).alias("n_links"), "used_fallback")


@register("html_to_markdown", f"""
SELECT page_id, {sql_page_path('url')} AS file_path,
       len(regexp_extract_all(html, '<h[1-6][\\s>]')) AS n_headings,
       len(regexp_extract_all(html, '<a\\s[^>]*href')) AS n_links,
       NOT regexp_matches(html, '<div[^>]*role="main"') AS used_fallback
FROM pages""")
def q_html_to_markdown(spark, sf_dir):
    """Heading and link counts of every converted page, default selector."""
    return _md_counts(converted_pages(spark, sf_dir))


@register("html_article_markdown", f"""
SELECT page_id, {sql_page_path('url')} AS file_path,
       len(regexp_extract_all(a, '<h[1-6][\\s>]')) AS n_headings,
       len(regexp_extract_all(a, '<a\\s[^>]*href')) AS n_links,
       a = '' AS used_fallback
FROM (SELECT page_id, url, regexp_extract(html, '<article[\\s>][\\s\\S]*?</article>') AS a FROM pages)""")
def q_html_article_markdown(spark, sf_dir):
    """Heading and link counts of every converted page, article selector."""
    return _md_counts(converted_pages(spark, sf_dir, CV.ARTICLE_SELECTOR))


@register("chunk_pages")
def q_chunk_pages(spark, sf_dir):
    """Pages -> markdown (article selector) -> chunks: the paragraph-packing path."""
    docs = CV.markdown_docs(converted_pages(spark, sf_dir, CV.ARTICLE_SELECTOR), C.DEFAULT_VERSION)
    return CH.chunk_documents(docs).select("file_path", "chunk_index", "chunk_id",
                                           T.token_count("raw_chunk", "bounded").alias("n_tokens"))




# --------------------------------------------------------------------------- A7
def _ivf(spark, sf_dir, probes: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    it = e.select(F.col("vec_id").cast("string").alias("item_id"), F.col("embedding").alias("vector"))
    return KN.knn_ivf(q, it, 10, n_probe=probes).select("qid", "item_id", "score", F.col("rank").cast("int").alias("rank"))


@register("knn_approx", ORACLE["knn_topk"])
def q_knn_approx(spark, sf_dir):
    """The inverted-file search probing every cell (A7): it finds what the exact scan finds."""
    return _ivf(spark, sf_dir, 1 << 30)


def _stored(spark, sf_dir) -> DataFrame:
    """Every vector's top 10 from a stored inverted file: one half creates it, the other is appended, large cells are split."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    it = e.select(F.col("vec_id").cast("string").alias("item_id"), F.col("embedding").alias("vector"), F.lit(V).alias("version"))
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tomefold/cells-{uuid.uuid4().hex}"
    half = F.xxhash64("item_id") % 2 == 0
    CE.create_cells(it.where(half), base, KN._dim_of(it.select(F.col("vector").alias("qvec"))))
    CE.append_cells(it.where(~half), base)
    most = it.count() // 10
    CE.split_cells(spark, base, max(most, 1))
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return CE.search_cells(q, base, 10).select("qid", "item_id", "score", F.col("rank").cast("int").alias("rank"))


@register("knn_stored", ORACLE["knn_topk"])
def q_knn_stored(spark, sf_dir):
    """Top-10 by the stored inverted file: probing ends at the bound of the cells' radii, so it is exact."""
    return _stored(spark, sf_dir)


RECALL_FLOOR = 0.9


@register("knn_approx_recall", """
SELECT 10 * count(*) AS n_exact, true AS recall_reached FROM embeddings""")
def q_knn_approx_recall(spark, sf_dir):
    """Recall@10 of the stored inverted file against the exact scan (A7): at least RECALL_FLOOR."""
    exact = q_knn_topk(spark, sf_dir).select("qid", "item_id")
    found = _stored(spark, sf_dir).select("qid", "item_id", F.lit(1).alias("found"))
    return exact.join(found, ["qid", "item_id"], "left").agg(
        F.count("*").alias("n_exact"),
        (F.coalesce(F.sum("found"), F.lit(0)) >= RECALL_FLOOR * F.count("*")).alias("recall_reached"))


@register("search_stored", ORACLE["search_full"])
def q_search_stored(spark, sf_dir):
    """``search_full`` over a stored inverted file of the index (A7, R2): the same answers without a fit or a full scan."""
    index = search_index(spark, sf_dir)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tomefold/index-cells-{uuid.uuid4().hex}"
    SE.store_cells(index, base, DIM)
    return _search_out(SE.search(search_queries(spark, sf_dir), index, cells=base))


@register("search_hit_counts", _sql_search_ctes(C.SEARCH_LIMIT, C.SEARCH_MIN_SCORE) + """
SELECT v.qid, coalesce(i.n, 0) AS n_initial, coalesce(f.n, 0) AS n_final
FROM (SELECT qid FROM qvec) v
LEFT JOIN (SELECT qid, count(*) AS n FROM boosted GROUP BY qid) i USING (qid)
LEFT JOIN (SELECT qid, count(*) AS n FROM first GROUP BY qid) f USING (qid)""")
def q_search_hit_counts(spark, sf_dir):
    """Initial candidates vs final hits per query."""
    return SE.search(search_queries(spark, sf_dir), search_index(spark, sf_dir), counts_only=True)


# --------------------------------------------------------------------------- A2, D11
@register("ledger_totals", f"""
SELECT version, count(DISTINCT file_path) AS files_processed, count(*) AS chunks_created
FROM ({_sql_chunks(SQL_OLD)}) GROUP BY version""")
def q_ledger_totals(spark, sf_dir):
    """Files processed and chunks created per version from a ledger (A2)."""
    old, _ = D.two_versions(spark, sf_dir)
    return IX.ledger_totals(IX.ledger_rows(old, _chunks_of(old), "run-1"))


@register("uncommitted_cleanup", f"""
SELECT version, file_path, chunk_index, chunk_id, 'old-' || split_part(file_path, '/', 2) AS run_id
FROM ({_sql_chunks(SQL_OLD)})""")
def q_uncommitted_cleanup(spark, sf_dir):
    """Index rows of a run without a ledger commit are dropped (D11).  One run
    per document source and version; the old tree's runs committed their ledger
    rows, the new tree's runs never did."""
    old, new = D.two_versions(spark, sf_dir)

    def run_of(prefix):
        return F.concat(F.lit(prefix), F.split_part(F.col("file_path"), F.lit("/"), F.lit(2)))
    idx = (_chunks_of(old).withColumn("run_id", run_of("old-"))
           .unionByName(_chunks_of(new).withColumn("run_id", run_of("new-"))))
    ledger = IX.ledger_rows(old, None, run_of("old-"))
    return IN.drop_uncommitted(idx, ledger)


# --------------------------------------------------------------------------- D8
@register("quality_classifier")
def q_quality_classifier(spark, sf_dir):
    """Document quality classifier (D8) trained on ``labels`` with pyspark.ml:
    hashed word counts -> IDF -> logistic regression; scores every document."""
    from ..operators import classify as CL
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return CL.quality_scores(docs, labels)


# --------------------------------------------------------------------------- D10 (from pages)
@register("page_coverage")
def q_page_coverage(spark, sf_dir):
    """Pages -> markdown -> chunks -> index: the stage each page reached."""
    conv = written(converted_pages(spark, sf_dir, CV.ARTICLE_SELECTOR), "converted-pages")
    chunks = CH.chunk_documents(CV.markdown_docs(conv, C.DEFAULT_VERSION))
    # chunked and embedded once; both counts read the written rows
    index = written(EM.embed_hashed(chunks, "content"), "page-index")
    return IN.page_coverage(conv, index.drop("vector"), index)


FLAGSHIP = "search_full"

from . import branches, evolution  # noqa: E402,F401  (they register further rows)
