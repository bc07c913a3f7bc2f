"""Packing: every id once, gapless sequences, bounds that hold."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
from messy import frame

from tomefold.llm import packing as pk
from tomefold.llm.tokens import Encoder, default_path

PATH = default_path("byte_bpe_50k.json")


def optimum(lengths, capacity):
    """Fewest sequences by exhaustive search."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                place(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1:])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_bound_and_best_fit():
    rng = np.random.default_rng(7)
    for _ in range(60):
        capacity = int(rng.integers(4, 30))
        lengths = np.sort(rng.integers(1, capacity + 1, int(rng.integers(1, 8))))[::-1]
        best = optimum(lengths.tolist(), capacity)
        at = pk.best_fit_decreasing(lengths, capacity)
        fill = np.bincount(at, weights=lengths)
        assert fill.max() <= capacity and len(fill) >= best
        assert -(-int(lengths.sum()) // capacity) <= pk.lower_bound(lengths, capacity) <= best
    assert pk.lower_bound(np.array([6, 6, 6]), 10) == 3  # more than half each: the sum alone says 2
    assert pk.lower_bound(np.array([], dtype=int), 10) == 0


def check(rows, got, capacity=1024):
    enc = Encoder(PATH, True)
    want = defaultdict(int)
    for doc_id, text in rows:
        ids = enc.plain(text or "") + np.asarray([2], "<u4").tobytes() if text else np.asarray([2], "<u4").tobytes()
        n = len(ids) // 4
        first = n if n <= capacity else (n - 1) % capacity + 1
        for k, a in enumerate([0, *range(first, n, capacity)]):
            b = first if k == 0 else a + capacity
            want[doc_id, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])] += 1
    have, places = defaultdict(int), defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for p in places.values():
        p.sort()
        ends = list(itertools.accumulate(n for _, n in p))
        assert [o for o, _ in p] == [0, *ends[:-1]] and ends[-1] <= capacity
    return len(places)


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = pk.pack_documents(documents, PATH, 2, True).collect()
    used = check(rows, got)
    assert used <= 1.03 * pk.lower_bound(np.array([r.length for r in got]), 1024) + 1


def test_exchange_saves_sequences(spark, monkeypatch):
    monkeypatch.setattr(pk, "PART_ITEMS", 24)
    rng = np.random.default_rng(3)
    sizes = [n for _ in range(150) for n in np.diff([0, *sorted(rng.choice(np.arange(1, 100), 3, replace=False)), 100])]
    items = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(sizes)], pk._PIECES_DDL)
    used = []
    for rounds in (0, 4):  # 150 sequences are enough
        got = pk.pack(items, 100, rounds).collect()
        assert sorted(r.doc_id for r in got) == list(range(len(sizes)))
        fill = defaultdict(int)
        for r in got:
            fill[r.sequence_id] += r.length
        assert max(fill.values()) <= 100
        used.append(len(fill))
    assert 150 <= used[1] < used[0]


def test_messy(spark):
    docs = frame(spark)
    check([(r.doc_id, r.text) for r in docs.collect()], pk.pack_documents(docs, PATH, 2, True).collect())
    assert pk.pack_documents(frame(spark, empty=True), PATH, 2, True).count() == 0
