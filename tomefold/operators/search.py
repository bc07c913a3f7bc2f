"""Batch search: whole tables of queries against a chunk index.

One kNN pass per query batch keeps, per query, the best 30 items with score
>= 0.1.  Both answers come from it: the boosted first pass (rank within
``min(2*limit, 30)``, score >= ``max(min_score - 0.1, 0.2)``) and, for queries
without a first-pass hit only, the unboosted top 5 fallback.  Queries with
neither get a "No Results" row; queries without a usable vector an error row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..session import keep_cached
from ..session import release as _release
from . import cells as CE
from . import embed as E
from . import knn as K


@dataclass(frozen=True)
class RerankRules:
    type_terms: list[str] = field(default_factory=lambda: list(C.TYPE_TERMS))
    type_boost: float = C.TYPE_BOOST
    title_boost: float = C.TITLE_TERM_BOOST
    heading_boost: float = C.HEADING_TERM_BOOST
    code_phrases: list[str] = field(default_factory=lambda: list(C.CODE_QUERY_PHRASES))
    code_boost: float = C.CODE_BOOST
    ui_query_terms: list[str] = field(default_factory=lambda: list(C.UI_QUERY_TERMS))
    ui_content_terms: list[str] = field(default_factory=lambda: list(C.UI_CONTENT_TERMS))
    ui_boost: float = C.UI_BOOST


def _any_in(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: text.contains(t))


def _add_if(acc: Column, cond: Column, amount: float) -> Column:
    return acc + F.when(cond, F.lit(amount)).otherwise(F.lit(0.0))


def query_terms(query: Column) -> Column:
    """The words of a lower-cased query."""
    return F.filter(F.split(query, "(?U)" + C.JAVA_WS_CLASS + "+", -1), lambda w: w != F.lit(""))


def boost_factor(query, content_type, title, heading_path, has_code, content,
                 rules: RerankRules = RerankRules(), terms=None) -> Column:
    """Multiplicative boost, additions in the same order as the rules.

    ``terms``: the column of ``query_terms``, when they were split before."""
    from ..functions.text import let

    def with_texts(t):
        q, title_l, head_l = t["q"], t["title"], t["head"]
        content_l = F.lower(F.coalesce(F.col(content), F.lit("")))  # looked at last, and only for UI queries
        b = _add_if(F.lit(1.0), _any_in(F.lower(F.coalesce(F.col(content_type), F.lit(""))), rules.type_terms),
                    rules.type_boost)
        b = F.aggregate(query_terms(q) if terms is None else F.col(terms), b, lambda acc, w: _add_if(
            _add_if(acc, title_l.contains(w), rules.title_boost), head_l.contains(w), rules.heading_boost))
        b = _add_if(b, F.coalesce(F.col(has_code), F.lit(False)) & _any_in(q, rules.code_phrases),
                    rules.code_boost)
        ui = F.when(_any_in(q, rules.ui_query_terms), _any_in(content_l, rules.ui_content_terms)).otherwise(F.lit(False))
        return _add_if(b, ui, rules.ui_boost)

    # each lower-cased text is computed once, not once per term
    texts = F.struct(
        F.lower(F.col(query)).alias("q"),
        F.lower(F.coalesce(F.col(title), F.lit(""))).alias("title"),
        F.lower(F.array_join(F.coalesce(F.col(heading_path), F.array().cast("array<string>")), " ")).alias("head"))
    return let(texts, with_texts)


RESULT_COLUMNS = ["qid", "rank", "stage", "content", "title", "file_path", "section", "doc_url",
                  "heading_path", "has_code", "content_type", "version", "similarity_score"]


def index_items(index: DataFrame) -> DataFrame:
    """Search key of an index row: ``version/chunk_id`` (chunk ids carry no version)."""
    return index.withColumn("item_id", F.concat_ws("/", "version", "chunk_id"))


def _initial() -> Column:
    """Whether a hit is among the candidates of the boosted pass."""
    return ((F.col("rank") <= F.least(F.col("limit") * 2, F.lit(C.CANDIDATE_CAP)))
            & (F.col("score") >= F.greatest(F.col("min_score") - C.CANDIDATE_MARGIN, F.lit(C.CANDIDATE_FLOOR))))


def _both_passes(cand: DataFrame, rules: RerankRules) -> DataFrame:
    """Candidates with ``initial``, ``boosted`` (of those of the boosted pass), ``passed``, ``pos`` among the passed
    ones of a query and ``answered``: whether any passed (R2-R8).  A boost is worked out once."""
    c = cand.withColumn("initial", _initial())
    c = c.withColumn("boosted", F.when(F.col("initial"), F.col("score") * boost_factor(
        "query", "content_type", "title", "heading_path", "has_code", "content", rules, "terms"))).drop("terms")
    c = c.withColumn("passed", F.coalesce(F.col("boosted") >= F.col("min_score"), F.lit(False)))
    by_query = Window.partitionBy("qid")
    return (c.withColumn("pos", F.row_number().over(by_query.orderBy(F.desc("passed"), F.desc("boosted"), F.asc("rank"))))
            .withColumn("answered", F.max("passed").over(by_query)))


def _kept() -> Column:
    """Whether a candidate is a final hit of the boosted pass."""
    return F.col("passed") & (F.col("pos") <= F.col("limit"))


def _hit_counts(good: DataFrame, cand: DataFrame) -> DataFrame:
    """Per query: candidates returned by the first search and hits kept."""
    n = cand.groupBy("qid").agg(F.count_if("initial").alias("n_initial"), F.count_if(_kept()).alias("n_final"))
    return (good.select("qid").join(n, "qid", "left")
            .select("qid", F.coalesce("n_initial", F.lit(0)).alias("n_initial"),
                    F.coalesce("n_final", F.lit(0)).alias("n_final")))


def store_cells(index: DataFrame, base: str, dim: int = C.EMBED_DIM, append: bool = False) -> None:
    """Write the vectors of ``index`` to the inverted file under ``base`` (a new folder), or append those of a run.

    A run that replaces or deletes chunks needs a new file of the live index: stored
    items that are no longer in it would take places among the candidates."""
    items = index_items(index).select("item_id", "vector", "version")
    if append:
        CE.append_cells(items, base)
    else:
        CE.create_cells(items, base, dim)


def search(queries: DataFrame, index: DataFrame, *, rules: RerankRules = RerankRules(),
           dim: int = C.EMBED_DIM, embedder=None, plan: str = "auto", counts_only: bool = False,
           probes: int | None = None, synonyms: DataFrame | None = None, cells: str | None = None) -> DataFrame:
    """``queries(qid, query, version, limit, min_score)`` x ``index`` -> results.

    ``index`` has the chunk columns plus ``vector``.  ``embedder`` maps a text
    column to a vector column (default: the hashed embedder).

    ``probes``: search approximately, in that many cells per query (A7); None is
    exact.  ``cells``: the folder of a stored inverted file of this index (``store_cells``); exact
    too, reads only the partitions of the versions and cells a query can need and fits
    nothing.  ``synonyms(term, synonym)``: embed the expanded query text (D9); boosts
    and messages keep the text as asked.
    """
    emb = embedder or (lambda c: E.hashed_vector(c, dim))
    q = (queries.select("qid", "query", "version",
                        F.coalesce("limit", F.lit(C.SEARCH_LIMIT)).alias("limit"),
                        F.coalesce("min_score", F.lit(C.SEARCH_MIN_SCORE)).alias("min_score"))
         )
    if synonyms is None:
        q = q.withColumn("qvec", emb(F.col("query")))
    else:
        from .ingest import expand_queries
        q = expand_queries(q, synonyms).withColumn("qvec", emb(F.col("expanded_query"))).drop("expanded_query")
    # the embedded request table (one row per query) feeds several branches:
    # embed once
    q = q.withColumn("problem", F.when(F.col("limit") < 1, F.lit("the limit must be at least 1"))
                     .when(F.col("qvec").isNull() | (F.size("qvec") != dim), F.lit("the query has no usable embedding")))
    q = q.withColumn("bad", F.col("problem").isNotNull()).persist()
    good = q.filter(~F.col("bad"))

    items = index_items(index)
    if cells is not None and probes is not None:
        raise ValueError("give either cells or probes")
    if plan == "auto" and cells is None:
        # the raw request count bounds the embedded query side (no UDF needed to count)
        n_q = queries.count()
        plan = "broadcast" if n_q * dim * 8 <= K.MAX_BROADCAST_BYTES else "grid"
    # no rank beyond the largest limit's candidates and the fallback is ever looked at
    most = q.agg(F.max("limit")).first()[0] or C.SEARCH_LIMIT
    k = min(max(2 * most, C.FALLBACK_K), C.CANDIDATE_CAP)
    asked = good.select("qid", "qvec", F.col("version").alias("qversion"))
    if cells is not None:
        hits = CE.search_cells(asked, cells, k, default_min_score=C.FALLBACK_MIN_SCORE)
    elif probes is None:
        hits = K.knn(asked, items, k, default_min_score=C.FALLBACK_MIN_SCORE, plan=plan)
    else:
        hits = K.knn_ivf(asked, items, k, n_probe=probes, default_min_score=C.FALLBACK_MIN_SCORE)
    # the engine chooses these joins by the measured size of the hits and queries (AQE)
    payload = items.select("item_id", "content", "title", "file_path", "section", "doc_url",
                           "heading_path", "has_code", "content_type", "version")
    # and the texts come last, only to hits that either pass can use; the hits themselves are found once
    hits = hits.persist()
    asks = good.select("qid", "query", "limit", "min_score", query_terms(F.lower("query")).alias("terms"))
    cand = (hits.join(asks, "qid").filter(_initial() | (F.col("rank") <= C.FALLBACK_K)).join(payload, "item_id"))
    cand = _both_passes(cand, rules)
    if counts_only:
        return _keep(_hit_counts(good, cand), q, hits)

    # fallback: only queries without a first-pass hit, top 5 unboosted
    found = cand.filter(_kept() | (~F.col("answered") & (F.col("rank") <= C.FALLBACK_K)))
    found = (found.withColumn("pos", F.when(F.col("answered"), F.col("pos")).otherwise(F.col("rank")))
             .withColumn("stage", F.when(F.col("answered"), "hit").otherwise("fallback"))
             .withColumn("similarity_score", F.round(F.when(F.col("answered"), F.col("boosted")).otherwise(F.col("score")), C.SCORE_DIGITS)))

    out_cols = [F.col("qid"), F.col("pos").cast("int").alias("rank"), "stage",
                F.coalesce("content", F.lit("")).alias("content"), F.coalesce("title", F.lit("")).alias("title"),
                F.coalesce("file_path", F.lit("")).alias("file_path"),
                F.coalesce("section", F.lit("")).alias("section"),
                F.coalesce("doc_url", F.lit("")).alias("doc_url"),
                F.coalesce("heading_path", F.array().cast("array<string>")).alias("heading_path"),
                F.coalesce("has_code", F.lit(False)).alias("has_code"),
                F.coalesce("content_type", F.lit("")).alias("content_type"),
                F.coalesce("version", F.lit("")).alias("version"),
                F.col("similarity_score").cast("double").alias("similarity_score")]
    found = found.select(*out_cols)

    # sentinel and error rows; a query with any hit has a row of either pass, unless a stored file holds chunks the index lost
    none = good.join((hits if cells is None else found).select("qid").distinct(), "qid", "left_anti")
    sentinel = none.select(
        "qid", F.lit(1).alias("rank"), F.lit("none").alias("stage"),
        F.format_string(C.NO_RESULTS_TEXT.replace("{query}", "%s"), "query").alias("content"),
        F.lit(C.NO_RESULTS_TITLE).alias("title"), F.lit("").alias("file_path"),
        F.lit(C.NO_RESULTS_SECTION).alias("section"), F.lit("").alias("doc_url"),
        F.array().cast("array<string>").alias("heading_path"), F.lit(False).alias("has_code"),
        F.lit(C.NO_RESULTS_TYPE).alias("content_type"),
        F.coalesce(F.when(F.col("version") != "", F.col("version")), F.lit(C.UNKNOWN_VERSION)).alias("version"),
        F.lit(0.0).alias("similarity_score"))
    errors = q.filter(F.col("bad")).select(
        "qid", F.lit(1).alias("rank"), F.lit("error").alias("stage"),
        F.concat(F.lit("Error searching knowledge base: "), "problem").alias("content"),
        F.lit(C.ERROR_TITLE).alias("title"), F.lit("").alias("file_path"),
        F.lit(C.ERROR_SECTION).alias("section"), F.lit("").alias("doc_url"),
        F.array().cast("array<string>").alias("heading_path"), F.lit(False).alias("has_code"),
        F.lit(C.ERROR_TYPE).alias("content_type"),
        F.coalesce(F.when(F.col("version") != "", F.col("version")), F.lit(C.UNKNOWN_VERSION)).alias("version"),
        F.lit(0.0).alias("similarity_score"))
    return _keep(found.unionByName(sentinel).unionByName(errors).select(*RESULT_COLUMNS), q, hits)


def _keep(result: DataFrame, *persisted: DataFrame) -> DataFrame:
    return keep_cached(result, *persisted)


release = _release  # unpersist what ``search`` cached, after the result was written
