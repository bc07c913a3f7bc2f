"""Operator 7: secret scans with a trigram inverted index.

Method: from each rule's regex a Boolean query over trigrams is derived (what any match
must contain, in lower case).  The index holds, for every trigram that a query names, the
postings of the texts that contain it; intersecting postings gives each rule's candidate
texts, and only those are verified with the regex.  A rule without mandatory trigrams
(``hex``) scans every text.

Scale: DataFrame functions only.  The rule set is fixed, so the number of trigrams is too;
postings are narrow rows, counted per text with map-side aggregation, and the candidates
are joined to the texts by a key of the whole row, so neither a frequent trigram nor a
group of copies meets in one task.

Defined cases: null text is the empty text and has no spans; null doc_ids are allowed;
repeated rows are each returned; matches of one kind never overlap, different kinds may;
an empty table gives an empty result; other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomefold.llm.common import SPAN_TYPE, labelled, matches, spelled, stored

# The three base rules.  ``hex`` and ``access`` name their least length in
# the regex, which finds the same spans: a shorter maximal run holds no longer one.
ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
RULES: dict[str, str] = {
    "assign": ASSIGN,
    "access": ACCESS,
    "hex": HEX,
    "private_key": "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "github": "gh[opsu]_[A-Za-z0-9]{36,}+",
    "slack": "xox[abps]-[A-Za-z0-9-]{10,}+",
    "google": "AIza[A-Za-z0-9_-]{35}",
    "jwt": "eyJ[A-Za-z0-9_-]{10,}+\\.eyJ[A-Za-z0-9_-]{10,}+\\.[A-Za-z0-9_-]{10,}+",
}
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6
MAX_CLASS, MAX_STRINGS = 4, 64

# A query is a list of clauses that must all hold; a clause is a list of alternatives; an
# alternative is a set of trigrams that must all be present.
Query = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """The trigrams that every match of ``pattern`` contains; empty if none are certain."""
    return _clauses(re._parser.parse(pattern))


def _strings(op, arg) -> list[str] | None:
    """All lower-case strings that one parsed item can match, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return [chr(arg).lower()]
    if name == "IN":
        if not all(str(o) == "LITERAL" for o, _ in arg):
            return None
        found = sorted({chr(a).lower() for _, a in arg})
        return found if len(found) <= MAX_CLASS else None
    if name == "SUBPATTERN":
        return _joined(arg[-1])
    if name == "BRANCH":
        each = [_joined(x) for x in arg[1]]
        return None if None in each else sorted({s for x in each for s in x})
    if name in ("MAX_REPEAT", "POSSESSIVE_REPEAT") and arg[0] in (0, 1) and arg[1] == 1:
        inner = _joined(arg[2])
        return inner if inner is None or arg[0] else sorted({"", *inner})
    return [""] if name in ("AT", "ASSERT", "ASSERT_NOT") else None


def _joined(items) -> list[str] | None:
    strings = [""]
    for op, arg in items:
        more = _strings(op, arg)
        if more is None or len(strings) * len(more) > MAX_STRINGS:
            return None
        strings = [a + b for a, b in product(strings, more)]
    return strings


def _clauses(items) -> Query:
    clauses: Query = []
    run = [""]  # all strings that the items since the last open item can spell

    def close():
        if all(len(s) >= 3 for s in run):
            clauses.append([frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run])

    for op, arg in items:
        more = _strings(op, arg)
        if more is not None and len(run) * len(more) <= MAX_STRINGS:
            run = [a + b for a, b in product(run, more)]
            continue
        close()
        run = [""]
        if str(op) == "SUBPATTERN":
            clauses += _clauses(arg[-1])
        elif str(op) in ("MAX_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            clauses += _clauses(arg[2])
    close()
    return clauses


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: one (gram, key) row per listed trigram and text that holds it."""
    low = docs.select(_row_key().alias("key"), F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams]), lambda g: g.isNotNull())
    return low.select("key", F.explode(held).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, rules): the rules whose query each text satisfies, from the postings."""
    spark = index.sparkSession
    rows = [(rule, c, a, g, len(alternative), len(query)) for rule, query in queries.items()
            for c, clause in enumerate(query) for a, alternative in enumerate(clause) for g in sorted(alternative)]
    wanted = spark.createDataFrame(rows, "rule string, clause int, alternative int, gram string, need int, clauses int")
    held = (index.join(F.broadcast(wanted), "gram")  # a fixed table
            .groupBy("key", "rule", "clause", "alternative").agg(
                F.count("*").alias("n"), F.first("need").alias("need"), F.first("clauses").alias("clauses"))
            .where(F.col("n") == F.col("need")))
    met = held.groupBy("key", "rule").agg(F.countDistinct("clause").alias("met"), F.first("clauses").alias("clauses"))
    return met.where(F.col("met") == F.col("clauses")).groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _found(text: Column, rule: str) -> Column:
    if rule == "assign":
        return F.filter(matches(text, RULES[rule], 2), lambda x: F.length(x["g"]) >= LEAST_VALUE)
    return matches(text, RULES[rule])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    queries = {rule: trigram_query(pattern) for rule, pattern in RULES.items()}
    indexed = {rule: q for rule, q in queries.items() if q}
    trigrams = sorted({g for q in indexed.values() for clause in q for a in clause for g in a})
    index = stored(postings(docs, trigrams).distinct(), "trigram-postings")
    wanted = candidates(index, indexed)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("key", _row_key()).join(wanted, "key", "left")
    none = F.array().cast(SPAN_TYPE)
    spans = {}
    for order, rule in enumerate(RULES):
        found = labelled(_found(text, rule), order, rule)
        spans[rule] = found if rule not in indexed else F.when(F.array_contains("rules", rule), found).otherwise(none)
    each = keyed.select("doc_id", *[s.alias(rule) for rule, s in spans.items()])
    base = spelled(F.array_sort(F.concat(*BASE)))
    return each.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
                       F.sha2(base, 256).alias("base_sha256"),
                       spelled(F.array_sort(F.concat(*RULES))).alias("spans"))
