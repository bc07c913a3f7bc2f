"""The join against all pairs of shingle sets."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from messy import frame

from tomefold.llm import chosen_path as cp

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(doc_id, class_id, n_links) of every row."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if (not a and not b) or (a and b and 5 * both >= 4 * (len(a) + len(b) - both)):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    name = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return Counter((d, name[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def near_copies(n, words=120, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base = [word() for _ in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(words)] = word()
        out.append((100_000 + i, " ".join(copy)))
    return out


@pytest.mark.parametrize("small,medium", [(512, 8192), (6, 20), (6, 6)])
def test_links_and_classes(spark, documents, monkeypatch, small, medium):
    monkeypatch.setattr(cp, "SMALL", small)
    monkeypatch.setattr(cp, "MEDIUM", medium)
    rows = [(r.doc_id, r.text) for r in documents.collect()] + near_copies(60)
    rows += [(200_000, "a b c d"), (200_001, "a  b\nc d"), (200_002, None), (200_003, ""), (None, "a b c d"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in cp.jaccard_classes(docs).select("doc_id", "class_id", "n_links").collect())
    assert got == brute(rows)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(cp, "BLOCK", 16)
    rows = near_copies(90, words=60, seed=8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in cp.jaccard_classes(docs).select("doc_id", "class_id", "n_links").collect())
    assert got == brute(rows)


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(cp, "TOKENS_AT_ONCE", 5)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(12)]
    got = cp.shared_counts(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))


def test_keep_first(spark):
    docs = frame(spark)
    kept = cp.keep_first(docs)
    assert kept.columns == docs.columns
    rows = docs.collect()
    classes = cp.jaccard_classes(docs).collect()
    assert len(classes) == len(rows)
    # one row for each distinct class representative
    assert kept.count() == len({(c.class_id, c.rep_hash) for c in classes})
    assert kept.where("doc_id in (3, 4)").count() == 1
    assert cp.keep_first(frame(spark, empty=True)).count() == 0
    assert cp.jaccard_classes(frame(spark, empty=True)).count() == 0
