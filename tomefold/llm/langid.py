"""Operator 5: language identification by word-first backoff.

Method: a word that the model knows scores its log frequency in each language; any other
word falls back to its character n-grams (with word edges), longest first: the mean log
frequency of those of the longest order of which the model knows any.  Scores of all words
of a text add up with the log share of each language; the softmax of the sums is the score.

Training counts every word of every training text; the counts leave the workers as
(language, word, count) and are summed by Spark.  The model keeps the ``WORDS`` most
frequent words and the ``GRAMS`` most frequent n-grams of each order (ties by spelling);
these two parameters bound what is broadcast, whatever the corpus.  Unknown words are not
lost: they take the n-gram path.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every
text when no training row has a language; null doc_ids are hashed as the empty text; equal
scores take the first language by code point; repeated rows count and are scored like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomefold.llm.common import held_out, prepare, stored

WORDS = 50_000
GRAMS = 20_000
ORDERS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
FLUSH = 300_000
MEMO = 200_000

_LETTERS = re.compile(r"[^\W\d_]+")
_COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("term", pa.string()), ("n", pa.int64())])
_COUNTS_DDL = "lang string, size int, term string, n long"


def letter_words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams(word: str, size: int) -> list[str]:
    """The n-grams of a word between its edges; single letters without them."""
    edged = f"^{word}$" if size > 1 else word
    return [edged[i:i + size] for i in range(len(edged) - size + 1)]


def _rows(counts: dict) -> pa.RecordBatch:
    keys = [(lang, size, term, n) for (lang, size), c in counts.items() for term, n in c.items()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*keys), _COUNTS)], schema=_COUNTS)


def _flushing(batches, add):
    """Counts of all batches, emitted whenever they hold ``FLUSH`` terms."""
    counts: dict = {}
    for batch in batches:
        for row in zip(*(batch.column(k) for k in range(batch.num_columns))):
            add(counts, *(x.as_py() for x in row))
            if sum(map(len, counts.values())) > FLUSH:
                yield _rows(counts)
                counts = {}
    if any(counts.values()):
        yield _rows(counts)


def _add_words(counts, lang, text):
    counts.setdefault((lang, 0), Counter()).update(letter_words(text))


def _add_grams(counts, lang, word, n):
    for size in ORDERS:
        c = counts.setdefault((lang, size), Counter())
        for g in grams(word, size):
            c[g] += n


def train(docs: DataFrame) -> dict:
    """Fit the model on ``docs`` (text, lang); rows with a null in either are not used."""
    prepare(docs.sparkSession)
    rows = docs.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    priors = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(priors)
    words = stored(rows.mapInArrow(lambda b: _flushing(b, _add_words), _COUNTS_DDL)
                   .groupBy("lang", "size", "term").agg(F.sum("n").alias("n")), "lang-words")
    gram_counts = stored(words.select("lang", "term", "n").mapInArrow(lambda b: _flushing(b, _add_grams), _COUNTS_DDL)
                         .groupBy("lang", "size", "term").agg(F.sum("n").alias("n")), "lang-grams")
    tables = {}
    for size in (0, *ORDERS):
        counts = (words if size == 0 else gram_counts).where(F.col("size") == size)
        totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        top = (counts.groupBy("term").agg(F.sum("n").alias("n"), F.map_from_entries(
            F.collect_list(F.struct("lang", "n"))).alias("by"))  # at most one entry per language
            .orderBy(F.desc("n"), "term").limit(GRAMS if size else WORDS).collect())
        freq = np.array([[r["by"].get(x, 0) for x in langs] for r in top], dtype=np.float64).reshape(len(top), len(langs))
        total = np.array([totals.get(x, 0) for x in langs])
        tables[size] = ({r["term"]: i for i, r in enumerate(top)},
                        np.log((freq + SMOOTHING) / (total + SMOOTHING * (len(top) + 1))))
    share = np.array([priors[x] for x in langs], dtype=np.float64)
    return {"langs": langs, "prior": np.log(share / share.sum()) if langs else share, "tables": tables}


class Scorer:
    """Scores texts; remembers the n-grams of unknown words up to a bound."""

    def __init__(self, model: dict):
        self.model = model
        self.known = model["tables"][0][0]
        self.memo: dict[str, tuple[int, list[int]]] = {}

    def unseen(self, word: str) -> tuple[int, list[int]]:
        """The longest order of which the model knows n-grams of the word, and their rows."""
        for size in ORDERS:
            index = self.model["tables"][size][0]
            found = [index[g] for g in grams(word, size) if g in index]
            if found:
                return size, found
        return ORDERS[-1], []

    def predict(self, text: str | None) -> tuple[str, float]:
        found = Counter(letter_words(text or ""))
        if not found or not self.model["langs"]:
            return "und", 0.0
        rows: dict[int, list[int]] = {size: [] for size in (0, *ORDERS)}
        times: dict[int, list[float]] = {size: [] for size in (0, *ORDERS)}
        for word, n in found.items():
            i = self.known.get(word)
            if i is not None:
                rows[0].append(i)
                times[0].append(n)
                continue
            got = self.memo.get(word)
            if got is None:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                got = self.memo[word] = self.unseen(word)
            size, parts = got
            if parts:
                rows[size] += parts
                times[size] += [n / len(parts)] * len(parts)
        total = self.model["prior"].copy()
        for size, own in rows.items():
            if own:
                total += np.asarray(times[size]) @ self.model["tables"][size][1][own]
        p = np.exp(total - total.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.model["langs"][best], float(p[best])


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS and GRAMS
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def score(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            got = [scorer.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")
