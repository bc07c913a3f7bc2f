"""Counts against plain Python; the estimate against the same rounds written out; verdicts on labels."""

import math
import re
from collections import Counter

from messy import frame

from tomefold.llm import weak_rules as wr
from tomefold.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def check(rows, got):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = Counter()
    for d, t in rows:
        c = brute(t)
        want[d, c, c[0] < 50 or 100 * c[4] > 50 * c[0]] += 1
    assert Counter((r.doc_id, tuple(getattr(r, n) for n in names), r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_counts(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rows += [(10 ** 6, "a b c a b c"), (10 ** 6 + 1, "a b c d"), (10 ** 6 + 2, "x x x x"), (10 ** 6 + 3, "# *\n#  *\n# *\n \n"),
             (10 ** 6 + 4, "\x0bone\x0ctwo\rthree "), (10 ** 6 + 5, "a b c " * 3000), (10 ** 6 + 6, "no break   wide")]
    check(rows, wr.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_rates_by_hand(documents):
    counted = stored(documents.select(*[v.alias(k) for k, v in wr.counts(documents["text"]).items()]), "test-counts")
    names = list(wr.rules({k: counted[k] for k in wr.COUNTS}))
    votes = [tuple(r) for r in counted.select(*wr.rules({k: counted[k] for k in wr.COUNTS}).values()).collect()]
    rates = {"share": 0.8} | {(k, v): 0.9 for k in names for v in (-1, 1)}
    for _ in range(wr.ROUNDS):
        prior = math.log(rates["share"] / (1 - rates["share"]))
        q = []
        for row in votes:
            z = prior + sum(v * math.log(rates[k, v] / (1 - rates[k, v])) - prior for k, v in zip(names, row) if v)
            q.append(1 / (1 + math.exp(-z)))
        new = {"share": min(0.95, max(0.5, sum(q) / len(q)))}
        for j, k in enumerate(names):
            for v in (-1, 1):
                cast = [p for p, row in zip(q, votes) if row[j] == v]
                right = sum(cast) if v > 0 else len(cast) - sum(cast)
                new[k, v] = min(wr.BEST, max(wr.WORST, (right + 0.9 * (0.5 * len(cast) + 1)) / (1.5 * len(cast) + 1)))
        rates = new
    got = wr.fit(counted)
    assert got.keys() == rates.keys() and all(math.isclose(got[k], rates[k], rel_tol=1e-6) for k in got)


def test_labels(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in wr.quality(spark.read.parquet(f"{SF}/documents.parquet")).collect()
           if r.doc_id in label and not r.base_failed]
    good = [r.kept for r in got if label[r.doc_id] == 1]
    bad = [r.kept for r in got if label[r.doc_id] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2


def test_keep_good(spark, documents):
    kept = {r.doc_id for r in wr.quality(documents).where("kept").collect()}
    out = wr.keep_good(documents)
    assert out.columns == documents.columns and {r.doc_id for r in out.collect()} == kept


def test_messy(spark):
    docs = frame(spark)
    check([(r.doc_id, r.text) for r in docs.collect()], wr.quality(docs).collect())
    assert wr.keep_good(docs.withColumn("_quality_kept", docs["size"])).columns == [*docs.columns, "_quality_kept"]
    assert wr.quality(frame(spark, empty=True)).count() == 0 and wr.keep_good(frame(spark, empty=True)).count() == 0
