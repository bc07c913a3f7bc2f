"""Mixing against targets worked out in plain Python."""

import re
from collections import Counter, defaultdict

from messy import frame

from tomefold.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def n_words(text):
    return len(WORD.findall(text or ""))


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        level = (total - 2 * sum(sizes[s] for s in held)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in held else level * weight[s] for s in order}
        held |= above


def check(docs, rows, got):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += n_words(r.text)
    targets = expected_targets(sizes)
    taken, source = defaultdict(int), {}
    for r in rows:
        source[r.doc_id, n_words(r.text)] = r.source
    assert Counter((r.doc_id, n_words(r.text)) for r in rows) == Counter((g.doc_id, g.size) for g in got)
    for g in got:
        s = source[g.doc_id, g.size]
        taken[s] += g.taken
        assert g.source_size == sizes[s] and abs(g.target - targets[s]) < 1e-6 * max(1, targets[s])
        assert g.epochs * g.size <= g.taken <= (g.epochs + 1) * g.size and g.taken <= 2 * g.size
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 3, (s, taken[s], targets[s])


def test_documents(documents):
    rows = documents.collect()
    first = mixing.mixture(documents).collect()
    check(documents, rows, first)
    again = mixing.mixture(documents.repartition(3)).collect()
    assert Counter(first) == Counter(again)


def test_buckets_find_the_same_prefix(documents, monkeypatch):
    whole = Counter(mixing.mixture(documents).collect())
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 2)
    assert Counter(mixing.mixture(documents).collect()) == whole


def test_keys_prefer_heavy_weights(spark):
    docs = spark.range(4000).selectExpr(
        "id doc_id", "'s' source", "case when id % 2 = 0 then repeat('same ', 20) else array_join(transform("
        "sequence(1, 20), x -> concat('w', x)), ' ') end text").union(
        spark.range(8000).selectExpr("id + 10000", "'t'", "repeat('a b ', 20)"))
    got = mixing.mixture(docs).where("doc_id < 4000 and taken % 20 = 0").selectExpr("doc_id % 2 kind", "taken").collect()
    by = {k: sum(g.taken for g in got if g.kind == k) for k in (0, 1)}
    assert by[1] >= by[0]


def test_messy_rows_and_mixed_corpus(spark):
    docs = frame(spark)
    rows = docs.collect()
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    assert all(g.taken == 0 for g in got if g.size == 0)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += n_words(r.text)
        assert r.n_chars == len(r.text)
    want = Counter()
    for g in got:
        want[g.doc_id] += g.taken
    assert +words == +want
    assert mixing.mixture(frame(spark, empty=True)).count() == 0
    assert mixing.mix(frame(spark, empty=True)).count() == 0
