"""Term associations learned from a corpus, the synonym table of query expansion (roadmap D9)."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

WINDOW = 4        # words at most this far apart go together
MIN_SUPPORT = 3   # documents that hold a pair
TOP = 3           # partners of a term
COMMON = 1000     # terms of the most documents, to which pairs with other terms do not belong
WORDS_AT_ONCE = 1 << 19  # a task works on so many words (or one document) at once,
PAIRS_HELD = 1 << 22     # holds about so many counted pairs before it gives them on,
MAX_PARTNERS = 1 << 12   # in rows of so many at most
ROWS_AT_ONCE = 1 << 16


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, in order, with the sum of its ``n``."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][:len(a)])
    return a[first], b[first], np.add.reduceat(n, first, dtype=np.int32) if len(first) else n


def _doc_pairs(codes: np.ndarray, doc: np.ndarray, window: int, common: np.ndarray):
    """The pairs of different words up to ``window`` places apart, and how many documents have each.

    A pair belongs to its word that is not among the ``common`` ones, else to the lesser code."""
    is_common = np.isin(codes, common)
    found = []
    for d in range(1, window + 1):
        x, y = codes[:-d], codes[d:]
        at = np.flatnonzero((doc[:-d] == doc[d:]) & (x != y))
        x, y, p, q = x[at], y[at], is_common[at], is_common[at + d]
        swap = np.where(p == q, x > y, p)
        found.append((np.where(swap, y, x), np.where(swap, x, y), doc[at]))
    a, b, doc = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (doc[1:] != doc[:-1])][:len(a)]
    return _summed(a[once], b[once], np.ones(int(once.sum()), np.int32))


def _counted(window: int, common: list[int]):
    """Batches of documents' codes to rows (a, its partners, how many documents have each pair)."""
    common = np.asarray(common, np.int64)

    def rows(held):
        a, b, n = _summed(*(np.concatenate(c) for c in zip(*held))) if len(held) > 1 else held[0]
        new = np.r_[True, a[1:] != a[:-1]][:len(a)]
        new[::MAX_PARTNERS] = True  # rows of bounded length
        first = np.flatnonzero(new)
        edges = pa.array(np.r_[first, len(a)], pa.int32())
        out = pa.RecordBatch.from_arrays([pa.array(a[first]), pa.ListArray.from_arrays(edges, pa.array(b)),
                                          pa.ListArray.from_arrays(edges, pa.array(n, pa.int32()))], names=["a", "b", "n"])
        return [out.slice(k, ROWS_AT_ONCE) for k in range(0, len(out), ROWS_AT_ONCE)]

    def count(batches):
        held, size = [], 0
        for batch in batches:
            codes = batch.column(0).flatten().to_numpy()
            edges = np.r_[0, np.cumsum(batch.column(0).value_lengths().to_numpy())]
            begin = 0
            while begin < len(edges) - 1:
                end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + WORDS_AT_ONCE, "right")) - 1)
                doc = np.repeat(np.arange(begin, end, dtype=np.int32), np.diff(edges[begin:end + 1]))
                held.append(_doc_pairs(codes[edges[begin]:edges[end]], doc, window, common))
                size += len(held[-1][0])
                begin = end
                if size > PAIRS_HELD:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)
    return count


def _code(term: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), term)


def _coded_terms(words: DataFrame) -> tuple[DataFrame, int]:
    """Every term with its number of documents and a code that no other term has, and the salt of the codes."""
    terms = written(words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("n")), "terms")
    for salt in itertools.count():  # the first nearly always does
        coded = terms.withColumn("code", _code(F.col("term"), salt))
        if coded.groupBy("code").count().filter(F.col("count") > 1).isEmpty():
            return coded, salt


def term_associations(docs: DataFrame, text_col: str = "text", window: int = WINDOW,
                      min_support: int = MIN_SUPPORT, top: int = TOP) -> DataFrame:
    """``(term, synonym, rank, n_term, n_synonym, n_both)``: per term its strongest partners.

    Counts are of documents; strength is the cosine ``n_both / sqrt(n_term * n_synonym)``,
    ties go to the lesser word.  ``(term, synonym)`` feeds ``ingest.expand_queries`` and
    ``search(synonyms=)``.  A document gives at most ``window`` pairs a word, made distinct
    within it and counted once per order; they are mirrored after the count.  Most pairs are
    met once, so what crosses the shuffle is a word's code and the list of its partners'; no
    two terms have one code.  The most common words own no pairs with others, so no row of
    the shuffle has a key with a large part of all pairs.  A null text has no words."""
    w = docs.select(_words(text_col).alias("w"))
    terms, salt = _coded_terms(w)
    terms = terms.filter(F.col("n") >= min_support)
    common = [r["code"] for r in terms.orderBy(F.desc("n"), "code").limit(COMMON).collect()]
    coded = w.select(F.transform("w", lambda x: _code(x, salt)).alias("codes"))
    pairs = (coded.mapInArrow(_counted(window, common), "a long, b array<long>, n array<int>").repartition("a")
             .select("a", F.explode(F.arrays_zip("b", "n")).alias("p")).select("a", "p.b", "p.n")
             .groupBy("a", "b").agg(F.sum("n").alias("n_both")).filter(F.col("n_both") >= min_support))
    named = (pairs.join(terms.select(F.col("code").alias("a"), F.col("term").alias("term_a"), F.col("n").alias("n_a")), "a")
             .join(terms.select(F.col("code").alias("b"), F.col("term").alias("term_b"), F.col("n").alias("n_b")), "b"))

    def mirrored(x, y):
        return F.struct(F.col(f"term_{x}").alias("term"), F.col(f"term_{y}").alias("synonym"),
                        F.col(f"n_{x}").alias("n_term"), F.col(f"n_{y}").alias("n_synonym"))
    scored = named.select(F.explode(F.array(mirrored("a", "b"), mirrored("b", "a"))).alias("s"), "n_both").select("s.*", "n_both")
    cosine = F.col("n_both").cast("double") / F.sqrt(F.col("n_term").cast("double") * F.col("n_synonym").cast("double"))
    order = Window.partitionBy("term").orderBy(F.desc("cosine"), "synonym")
    return (scored.withColumn("cosine", cosine).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= top).select("term", "synonym", "rank", "n_term", "n_synonym", "n_both"))
