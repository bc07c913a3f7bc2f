"""Operator 8: quality rules as weak supervision.

Method: each rule looks at counts of one text and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation over all texts estimates the share of good texts and how often
each rule's good and bad votes are right; a text is kept when its posterior probability of
being good is at least one half.

Scale: DataFrame functions only.  Counting is one narrow projection per text.  Rounds of
the estimation run over the table of distinct vote patterns (at most 3 to the number of
rules, whatever the corpus); only the estimated rates reach the driver.  Keeping is a
projection with the rates as constants: no join.

Defined cases: null text is the empty text; it has no words and fails the base rules; long
texts are counted whole; repeated rows vote each; with no rows the start rates hold; other
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomefold.llm.common import SPACE, let, stored, words

SYMBOLS = "[#*$%&|<>]"
ROUNDS = 12
BELIEF, WORST, BEST = 0.9, 0.75, 0.99
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_distinct")


def _repeat_words(found: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array ``found``."""
    def counted(w):
        windows = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
                          F.lit(1), F.size(w) - 2)
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(marked(h)))

    def marked(h):
        # Hash and position in one long, so that equal windows are neighbours once sorted.
        bits = F.ceil(F.log2(F.size(h) + 1)).cast("int")
        return let(F.expr("1L") * F.pow(F.lit(2.0), bits).cast("long") - 1,
                   lambda mask: let(F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(
                       i.cast("long")))), lambda s: covered(h, s, mask)))

    def covered(h, s, mask):
        def hash_at(j):
            return F.get(h, F.get(s, j).bitwiseAND(mask).cast("int"))
        twice = F.filter(s, lambda x, j: let(hash_at(j), lambda own: F.coalesce(own == hash_at(j + 1), F.lit(False))
                                             | (F.when(j > 0, own == hash_at(j - 1)).otherwise(False))))
        places = F.transform(twice, lambda x: let(x.bitwiseAND(mask), lambda p: F.array(p, p + 1, p + 2)))
        return F.size(F.array_distinct(F.flatten(places)))

    return F.when(F.size(found) < 4, 0).otherwise(let(found, counted)).cast("long")


def counts(text: Column) -> dict[str, Column]:
    """The counts that the rules look at, by name."""
    whole = F.coalesce(text, F.lit(""))
    found = words(text)
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.concat_ws("", found)).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(found),
        "n_lines": F.size(lines).cast("long"),
        "n_ended": F.size(F.filter(lines, lambda x: x.rlike("[.!?][\"')]*[\\x20\\x09-\\x0D]*$"))).cast("long"),
        "n_distinct": F.size(F.array_distinct(found)).cast("long"),
    }


def base_failed(c: dict[str, Column]) -> Column:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def rules(c: dict[str, Column]) -> dict[str, Column]:
    """Each rule's vote as an int column.  Shares are compared as products, without division."""
    n = c["n_words"]

    def vote(bad, good=F.lit(False)):
        return F.when((n == 0) | bad, -1).when(good, 1).otherwise(0)

    return {
        "length": vote(n < 30),
        "word_size": vote((c["word_chars"] < 2 * n) | (c["word_chars"] > 14 * n)),
        "symbols": vote(10 * c["n_symbols"] > n),
        "dup_lines": vote(10 * c["n_dup_lines"] > 3 * c["n_lines"]),
        "repeats": vote(10 * c["n_repeat_words"] > 4 * n),
        "variety": vote((10 * c["n_distinct"] < n) & (n < 5000), 10 * c["n_distinct"] >= 3 * n),
        "endings": vote((c["n_ended"] == 0) & (n >= 100), 2 * c["n_ended"] >= c["n_lines"]),
    }


def _log_odds(votes: dict[str, Column], rates: dict) -> Column:
    """Log odds of good against bad: those of the share, moved by every vote given."""
    prior = math.log(rates["share"] / (1 - rates["share"]))
    total = F.lit(prior)
    for rule, vote in votes.items():
        for v in (-1, 1):
            right = rates[rule, v]
            total = total + F.when(vote == v, F.lit(v * math.log(right / (1 - right)) - prior)).otherwise(0.0)
    return total


def fit(docs: DataFrame, rounds: int = ROUNDS) -> dict:
    """The share of good texts and how often each rule's vote is right.

    ``docs`` has the counts as columns; all its rows vote.  Each vote is believed right
    with ``BELIEF`` at first and that belief keeps half the weight of the rows seen; a
    vote is always taken to be better than chance (``WORST``).
    """
    votes = rules({k: F.col(k) for k in COUNTS})
    patterns = stored(docs.select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).agg(
        F.count("*").alias("times")), "vote-patterns")
    cols = {k: F.col(k) for k in votes}
    rates: dict = {"share": 0.8} | {(k, v): BELIEF for k in votes for v in (-1, 1)}
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-_log_odds(cols, rates)))
        weighted = patterns.select(*votes, "times", (q * F.col("times")).alias("good"))
        sums = weighted.agg(F.sum("times").alias("n"), F.sum("good").alias("good"), *[
            F.sum(F.when(cols[k] == v, F.col(w)).otherwise(0.0)).alias(f"{k}{v}{w}")
            for k in votes for v in (-1, 1) for w in ("times", "good")]).first()
        if not sums["n"]:
            break
        rates = {"share": min(0.95, max(0.5, sums["good"] / sums["n"]))}
        for k in votes:
            for v in (-1, 1):
                n, good = sums[f"{k}{v}times"], sums[f"{k}{v}good"]
                seen = (good if v > 0 else n - good) + BELIEF * (0.5 * n + 1)
                rates[k, v] = min(BEST, max(WORST, seen / (1.5 * n + 1)))
    return rates


def judged(docs: DataFrame, text: Column, rates: dict, prefix: str = "") -> DataFrame:
    """``docs`` with all counts, ``base_failed``, ``p_good`` and ``kept`` (names prefixed)."""
    at = {k: F.col(prefix + k) for k in COUNTS}
    wide = docs.withColumns({prefix + k: v for k, v in counts(text).items()})
    odds = _log_odds(rules(at), rates)
    return wide.withColumns({prefix + "base_failed": base_failed(at), prefix + "p_good": 1 / (1 + F.exp(-odds)),
                             prefix + "kept": ~base_failed(at) & (odds >= 0)})


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, p_good, kept) of every document; texts are read once."""
    counted = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                 *[v.alias(k) for k, v in counts(F.col("text")).items()]), "quality-counts")
    rates = fit(counted)
    c = {k: F.col(k) for k in COUNTS}
    odds = _log_odds(rules(c), rates)
    return counted.select("doc_id", *COUNTS, base_failed(c).alias("base_failed"),
                          (1 / (1 + F.exp(-odds))).alias("p_good"), (~base_failed(c) & (odds >= 0)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they were."""
    rates = fit(docs.select(*[v.alias(k) for k, v in counts(F.col("text")).items()]))
    prefix = "_quality_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return judged(docs, F.col("text"), rates, prefix).where(F.col(prefix + "kept")).select(
        *[F.col(f"`{c}`") for c in docs.columns])
