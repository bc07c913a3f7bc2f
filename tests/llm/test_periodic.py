"""Periodic runs against a period-by-period search."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from messy import frame

from tomefold.llm import periodic as pe


def brute(seq, min_length=pe.MIN_LENGTH):
    """{(start, end): smallest period} of all maximal stretches."""
    n, out = len(seq), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if seq[i] != seq[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            if j + q - i >= max(min_length, 2 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, q, e) for (s, e), q in out.items())


def ours(seq, min_length=pe.MIN_LENGTH):
    codes = np.array([*seq, 1 << 20], np.int64)
    return [(int(s), int(q), int(e)) for s, e, q in zip(*pe.runs_of(codes, min_length))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.sampled_from([2, 4, 12]))
def test_runs_of_small_alphabets(seq, least):
    assert ours(seq, least) == brute(seq, least)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 9)), max_size=7))
def test_runs_of_repeated_pieces(pieces):
    seq = [x for piece, times in pieces for x in piece * times]
    assert ours(seq) == brute(seq)


def test_fibonacci_and_one_letter():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert ours(b, 2) == brute(b, 2)
    assert ours([7] * 500) == [(0, 1, 500)]


def test_suffix_order_and_lcp():
    rng = random.Random(3)
    seq = [rng.randrange(3) for _ in range(300)] + [99]
    suffixes, rank, _, lcp = pe.suffix_order(np.array(seq, np.int64))
    assert suffixes.tolist() == sorted(range(301), key=lambda i: seq[i:])
    assert rank[suffixes].tolist() == list(range(301))
    for k in range(1, 301):
        a, b = seq[suffixes[k - 1]:], seq[suffixes[k]:]
        assert lcp[k] == next(i for i in range(len(b) + 1) if a[i:i + 1] != b[i:i + 1])


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words) if n <= 3000 else [(int(s), int(q), int(e)) for s, q, e in ours_words(words)]
    drop = {i for s, q, e in runs for i in range(s + q, e)}
    spelled = "".join(f"{s},{e - s},{q}\n" for s, q, e in runs)
    best = min(runs, key=lambda r: (r[0] - r[2], r[0], r[1])) if runs else None
    return (doc_id, len(runs), *((best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4),
            hashlib.sha256(spelled.encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest())


def ours_words(words):
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return ours([codes[w] for w in words])


def key(row):
    return tuple((x is not None, x) for x in row)


def test_query_against_brute_force(spark, documents):
    got = sorted((tuple(r) for r in pe.run_digests(documents).collect()), key=key)
    rows = [r for r in documents.select("doc_id", "text").collect()]
    assert got == sorted((expected(*r) for r in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 10


def test_messy_rows(spark):
    rows = frame(spark)
    got = sorted((tuple(r) for r in pe.run_digests(rows).collect()), key=key)
    assert got == sorted((expected(r["doc_id"], r["text"]) for r in rows.collect()), key=key)
    assert pe.run_digests(frame(spark, empty=True)).count() == 0


def test_blocks_do_not_change_the_result(spark, documents, monkeypatch):
    texts = [re.findall(r"\S+", r["text"] or "") for r in documents.select("text").collect()][:40] + [["a", "b"] * 30] * 3
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.list_(pa.string()))],
                                       ["doc_id", "words"])
    whole = list(pe._find(12)([batch]))[0].to_pylist()
    monkeypatch.setattr(pe, "BLOCK_WORDS", 50)
    monkeypatch.setattr(pe, "PAIRS_AT_ONCE", 7)
    assert list(pe._find(12)([batch]))[0].to_pylist() == whole
    assert [r["runs"] for r in whole[-3:]] == [[{"start": 0, "length": 60, "period": 2}]] * 3


@pytest.mark.parametrize("n,h0", [(7, 0), (20, 0)])
def test_periodic_tenth(spark, n, h0):
    from pyspark.sql import functions as F
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == h0][:5]
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(i, words) for i in ids], "doc_id long, words array<string>")
    for r in df.select("doc_id", pe.with_period(F.col("doc_id"), F.col("words")).alias("w")).collect():
        g = zlib.crc32(str(r["doc_id"]).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r["w"] == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
