"""Registered queries whose derived inputs reach the branches that the plain tables do not.

``rich`` documents are the documents as markdown with a title, paragraphs apart by blank
lines (so that sections over the chunk size are packed with overlap), an example section
with a code fence and inline code, four kinds of path, and some blank files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import chunk as CH
from ..operators import code_blocks as CB
from ..operators import embed as EM
from ..operators import ingest as IN
from ..operators import search as SE
from ..session import written
from ..sources.tables import table
from . import registry as R
from . import sql_twins as S
from .registry import register

_LF = "chr(10)"
_SQL_TITLE = f"array_to_string(string_split(replace(coalesce(text, ''), {_LF}, ' '), ' ')[1:3], ' ')"
SQL_RICH_DOCS = f"""(SELECT '{C.DEFAULT_VERSION}' AS version,
  (CASE doc_id % 4 WHEN 0 THEN 'tutorials/' WHEN 1 THEN 'examples/' WHEN 2 THEN 'api/' ELSE 'guide/' END)
    || coalesce(lang, 'none') || '/' || CAST(doc_id AS VARCHAR) || '.md' AS file_path,
  CASE WHEN doc_id % 10 = 0 THEN ' ' || {_LF} || chr(9) ELSE
    '# ' || {_SQL_TITLE} || {_LF} || {_LF}
    || replace(coalesce(text, ''), {_LF}, {_LF} || {_LF} || {_LF} || {_LF}) || {_LF} || {_LF}
    || '## Example ' || coalesce(source, 'none') || {_LF} || {_LF} || '```Python' || {_LF}
    || split_part(coalesce(text, ''), {_LF}, 1) || {_LF} || '```' || {_LF} || {_LF}
    || 'Use `' || coalesce(source, 'none') || '` here.' || {_LF} END AS content
FROM documents)"""


def _title() -> F.Column:
    return F.substring_index(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), " ", 3)


def rich_docs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    text, source = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("none"))
    kind = F.element_at(F.array(*map(F.lit, ("tutorials/", "examples/", "api/", "guide/"))),
                        (F.col("doc_id") % 4 + 1).cast("int"))
    content = F.concat(F.lit("# "), _title(), F.lit("\n\n"), F.replace(text, F.lit("\n"), F.lit("\n\n\n\n")),
                       F.lit("\n\n## Example "), source, F.lit("\n\n```Python\n"), F.split_part(text, F.lit("\n"), F.lit(1)),
                       F.lit("\n```\n\nUse `"), source, F.lit("` here.\n"))
    return d.select(F.lit(C.DEFAULT_VERSION).alias("version"),
                    F.concat(kind, F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"),
                             F.lit(".md")).alias("file_path"),
                    F.when(F.col("doc_id") % 10 == 0, F.lit(" \n\t")).otherwise(content).alias("content"))


SQL_RICH_CHUNKS = R._sql_chunks(SQL_RICH_DOCS)


@register("rich_chunks", f"""
SELECT file_path, chunk_index, chunk_id, content, section, content_type, title,
       array_to_string(heading_path, ' | ') AS heading_path, has_code, doc_url, {S.tok('raw_chunk')} AS n_tokens
FROM ({SQL_RICH_CHUNKS})""")
def q_rich_chunks(spark, sf_dir):
    """Chunks of the rich documents: paragraph packing with overlap (T3a, T3b), blank files
    and pieces (F1, F2), code flags (P9), the four content types (P3), headings (P5, P6)."""
    c = CH.chunk_documents(rich_docs(spark, sf_dir), R.WORDS)
    return c.select("file_path", "chunk_index", "chunk_id", "content", "section", "content_type", "title",
                    F.array_join("heading_path", " | ").alias("heading_path"), "has_code", "doc_url",
                    T.token_count("raw_chunk").alias("n_tokens"))


@register("rich_code", f"SELECT file_path, {S.has_code('content')} AS has_code FROM {SQL_RICH_DOCS}")
def q_rich_code(spark, sf_dir):
    """Code flag of files with and without fences and inline code."""
    return rich_docs(spark, sf_dir).select("file_path", T.has_code("content").alias("has_code"))


@register("rich_coverage", f"""
WITH d AS (SELECT file_path, {S.is_blank('content')} AS blank, length(content) AS n_chars FROM {SQL_RICH_DOCS}),
     c AS (SELECT file_path, count(*) AS n FROM ({SQL_RICH_CHUNKS}) GROUP BY ALL)
SELECT file_path, CASE WHEN blank THEN 'empty' WHEN n IS NULL THEN 'no_chunks' ELSE 'processed' END AS status,
       coalesce(n, 0) AS n_chunks, n_chars FROM d LEFT JOIN c USING (file_path)""")
def q_rich_coverage(spark, sf_dir):
    """Coverage per file with blank files."""
    docs = rich_docs(spark, sf_dir)
    return IN.coverage(docs, CH.chunk_documents(docs, R.WORDS)).drop("version")


@register("code_blocks", f"""
SELECT file_path, chunk_id, unnest(range(len(b))) AS block_idx, 'python' AS lang, unnest(b) AS code
FROM (SELECT file_path, chunk_id, regexp_extract_all(raw_chunk, '(?s)```[^\\n`]*\\n(.*?)```', 1) AS b
      FROM ({SQL_RICH_CHUNKS}))""")
def q_code_blocks(spark, sf_dir):
    """Fenced code as rows."""
    c = CH.chunk_documents(rich_docs(spark, sf_dir), R.WORDS)
    return CB.code_blocks(c).select("file_path", "chunk_id", "block_idx", "lang", "code")


@register("inline_code", f"""
SELECT chunk_id, unnest(range(len(b))) AS span_idx, unnest(b) AS code
FROM (SELECT chunk_id, regexp_extract_all(raw_chunk, '`([^`\\n]+)`', 1) AS b FROM ({SQL_RICH_CHUNKS}))""")
def q_inline_code(spark, sf_dir):
    """Inline code spans as rows."""
    return CB.inline_code(CH.chunk_documents(rich_docs(spark, sf_dir), R.WORDS)).select("chunk_id", "span_idx", "code")


# --------------------------------------------------------------------------- search
_NULLED = ("title", "section", "doc_url", "content_type", "has_code", "heading_path")
_SQL_RICH_INDEX = (f"SELECT * EXCLUDE ({', '.join(_NULLED)}), "
                   + ", ".join(f"CASE WHEN chunk_index % 5 = 4 THEN NULL ELSE {c} END AS {c}" for c in _NULLED)
                   + f" FROM ({SQL_RICH_CHUNKS})")
_SQL_RICH_QUERIES = (f"SELECT doc_id * 10 + j AS qid, CASE WHEN j = 2 THEN '!?' ELSE 'how to implement example ' || {_SQL_TITLE} END "
                     f"AS query, v AS version FROM documents CROSS JOIN (VALUES (0, NULL), (1, '9.9'), (2, NULL)) f(j, v)")
RICH_MIN_SCORE = 0.35


@register("rich_search", R._sql_search_ctes(C.SEARCH_LIMIT, RICH_MIN_SCORE, _SQL_RICH_INDEX, _SQL_RICH_QUERIES)
          + "\nSELECT * FROM results")
def q_rich_search(spark, sf_dir):
    """Queries that hit titles, headings, types and code (A3, A5, R3-R5), null payload fields
    (P15), an unknown version (R9, U2) and texts without a token (R10, U3)."""
    chunks = CH.chunk_documents(rich_docs(spark, sf_dir), R.WORDS)
    for c in _NULLED:
        chunks = chunks.withColumn(c, F.when(F.col("chunk_index") % 5 != 4, F.col(c)))
    index = written(EM.embed_hashed(chunks, "content"), "rich-index")
    variants = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(v).cast("string").alias("version"))
                         for j, v in [(0, None), (1, "9.9"), (2, None)]])
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    q = d.select("doc_id", _title().alias("title"), F.explode(variants).alias("f")).select(
        (F.col("doc_id") * 10 + F.col("f.j")).alias("qid"),
        F.when(F.col("f.j") == 2, F.lit("!?")).otherwise(F.concat(F.lit("how to implement example "), "title")).alias("query"),
        F.col("f.version").alias("version"), F.lit(None).cast("int").alias("limit"), F.lit(RICH_MIN_SCORE).alias("min_score"))
    return R._search_out(SE.search(q, index))


@register("search_bad_limits", f"""
SELECT item_id * 10 + j AS qid, 1 AS rank, 'error' AS stage, '{C.ERROR_TITLE}' AS title,
       'Error searching knowledge base: the limit must be at least 1' AS content, 'unknown' AS version
FROM benchmark CROSS JOIN (VALUES (0), (1)) f(j)""")
def q_search_bad_limits(spark, sf_dir):
    """Requests with a limit of zero or less are error rows."""
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    q = b.select("item_id", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("j")).select(
        (F.col("item_id") * 10 + F.col("j")).alias("qid"), F.col("text").alias("query"), F.lit(None).cast("string").alias("version"),
        (F.col("j") * -3).cast("int").alias("limit"), F.lit(None).cast("double").alias("min_score"))
    res = SE.search(q, R.search_index(spark, sf_dir))
    return res.select("qid", "rank", "stage", "title", "content", "version")


# --------------------------------------------------------------------------- text, embedding, queries
_SQL_UNSPACED = "replace(coalesce(text, ''), ' ', '')"


@register("token_count_default", f"""
SELECT doc_id, {S.tok_bounded('text')} AS n_tokens, {S.tok_bounded(_SQL_UNSPACED)} AS n_unspaced,
       {S.tok_bounded("text || '漢字かなカナ' || CAST(doc_id AS VARCHAR)")} AS n_mixed FROM documents""")
def q_token_count_default(spark, sf_dir):
    """Bounded pieces, the default counter, of texts, of texts without spaces and with unspaced scripts (P10)."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    unspaced = F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(""))
    mixed = F.concat("text", F.lit("漢字かなカナ"), F.col("doc_id").cast("string"))
    return d.select("doc_id", T.token_count("text", "bounded").alias("n_tokens"),
                    T.token_count(unspaced, "bounded").alias("n_unspaced"), T.token_count(mixed, "bounded").alias("n_mixed"))


@register("overlap_tail_default", f"""
SELECT doc_id, {S.overlap_bounded('text', C.OVERLAP_TOKENS)} AS tail FROM documents""")
def q_overlap_tail_default(spark, sf_dir):
    """Text of the last 175 bounded pieces."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", T.overlap_tail("text", C.OVERLAP_TOKENS, "bounded").alias("tail"))


@register("relative_paths", f"""
SELECT page_id, {R.sql_page_path('url')} AS rel, 'other/root/' || {R.sql_page_path('url')} AS outside FROM pages""")
def q_relative_paths(spark, sf_dir):
    """Paths under a root lose it, others stay."""
    p = table(spark, sf_dir, "pages", "page_id", "url").withColumn("path", R.D.page_file_path("url", "page_id"))
    return p.select("page_id", T.relative_path(F.concat(F.lit("build/md/"), "path"), "build/md").alias("rel"),
                    T.relative_path(F.concat(F.lit("other/root/"), "path"), "build/md").alias("outside"))


def _flaky(texts: list[str]) -> list[list[float]]:
    """An embedder that refuses the first request of a batch now and then, and some texts always."""
    seen = _flaky.__dict__.setdefault("seen", set())
    first = texts[0]
    if len(texts) > 1 and first not in seen:
        seen.add(first)
        raise RuntimeError("429: slow down")
    if any(len(t) % 7 == 0 for t in texts):
        raise ValueError("text refused")
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@register("embed_with_retries", """
SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN -1 ELSE length(text) END AS v_len,
       CASE WHEN length(text) % 7 = 0 THEN -1 ELSE length(text) - length(replace(text, 'e', '')) END AS v_e,
       CASE WHEN length(text) % 7 = 0 THEN 'text refused' ELSE '' END AS error FROM documents""")
def q_embed_with_retries(spark, sf_dir):
    """A batch embedder with rate limits and refused texts (E1-E3): only those texts fail."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    e = EM.embed_with(d, _flaky, "text", batch_size=16, base_delay=0.0, batch_delay=0.0, sleep=lambda s: None)
    return e.select("doc_id", F.coalesce(F.get("vector", F.lit(0)).cast("long"), F.lit(-1)).alias("v_len"),
                    F.coalesce(F.get("vector", F.lit(1)).cast("long"), F.lit(-1)).alias("v_e"),
                    F.coalesce("embed_error", F.lit("")).alias("error"))


_SQL_TERMS = f"list_filter(regexp_split_to_array(lower(text), '{C.WS_CLASS}+'), lambda t: t <> '')"


@register("expand_queries", f"""
WITH syn AS (SELECT DISTINCT ({_SQL_TERMS})[1] AS term FROM benchmark),
     t AS (SELECT item_id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM (SELECT item_id, {_SQL_TERMS} AS w FROM benchmark))
SELECT item_id AS qid, string_agg(t.term || CASE WHEN s.term IS NULL THEN '' ELSE ' also_' || s.term || ' syn_' || s.term END, ' '
       ORDER BY pos) AS expanded_query
FROM t LEFT JOIN syn s USING (term) GROUP BY item_id""")
def q_expand_queries(spark, sf_dir):
    """Every benchmark query with the synonyms of its terms (D9); the first words have two each."""
    b = table(spark, sf_dir, "benchmark", "item_id", "text").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    words = F.filter(F.split(F.lower("query"), "(?U)" + C.JAVA_WS_CLASS + "+"), lambda w: w != "")
    first = b.select(F.get(words, F.lit(0)).alias("term")).distinct()
    syn = first.select("term", F.explode(F.array(F.concat(F.lit("syn_"), "term"), F.concat(F.lit("also_"), "term"))).alias("synonym"))
    return IN.expand_queries(b, syn).select("qid", "expanded_query")
