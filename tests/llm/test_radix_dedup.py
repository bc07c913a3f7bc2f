"""Removal of repeated strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from messy import frame

from tomefold.llm import radix_dedup as rd

NO_ID = (1 << 63) - 1


def expected(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of (doc_id, text)."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in rows:
        i = NO_ID if i is None else i
        for s in range(len(t) - rd.LENGTH + 1):
            w = t[s:s + rd.LENGTH]
            first[w] = min(first.get(w, NO_ID), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - rd.LENGTH + 1):
            if first[t[s:s + rd.LENGTH]] < (NO_ID if i is None else i):
                gone[s:s + rd.LENGTH] = b"\1" * rd.LENGTH
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return Counter(out)


def digests(rows):
    return Counter({(*r[:4], hashlib.sha256(r[4]).hexdigest()): n for r, n in expected(rows).items()})


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in rd.repeat_digests(df).collect())
    assert got == digests(rows)
    return got


def test_whole_table(documents):
    got = check(documents)
    assert sum(r[2] > 0 for r in got) > 10


def test_messy_rows(spark):
    check(frame(spark))
    assert rd.repeat_digests(frame(spark, empty=True)).count() == 0


def mosaic(n, seed=1):
    """Texts put together from shared passages, cut at odd places, of few letters, in shuffled ids."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab cé") for _ in range(rng.randrange(20, 200))) for _ in range(30)] + ["x" * 120, "ab" * 70]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            text += p[a:a + rng.randrange(1, 200)] + rng.choice(["", " ", "q"])
        rows.append((rng.randrange(n), text))
    return rows


@pytest.mark.parametrize("hot,block,bucket", [(4096, 8_000_000, 32_000_000), (3, 2000, 900), (0, 500, 300)])
def test_passages_across_blocks_and_buckets(spark, monkeypatch, hot, block, bucket):
    monkeypatch.setattr(rd, "BLOCK_BYTES", block)
    monkeypatch.setattr(rd, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(rd, "HOT", hot)
    check(spark.createDataFrame(mosaic(150), "doc_id long, text string").repartition(5))


def test_equal_ids_and_missing_ids(spark):
    p = "".join(random.Random(4).choice("abcdef ") for _ in range(90))
    check(spark.createDataFrame([(5, p + "1"), (5, p + "2"), (None, p + "3"), (None, p + "3"), (7, p), (7, p), (6, p[:50]), (8, p[:49])],
                                "doc_id long, text string"))


def test_slices_do_not_change_the_result(spark, monkeypatch):
    rows = mosaic(60, 2)
    texts = [t.encode() for _, t in rows]
    row = {"block": 0, "rows": b"", "ids": np.arange(len(texts)).astype("<i8").tobytes(),
           "ends": np.cumsum([len(t) for t in texts]).astype("<i8").tobytes(), "data": rd._packed(b"".join(texts))}
    whole = rd.Block(row)
    monkeypatch.setattr(rd, "_AT_ONCE", 97)
    cut = rd.Block(row)
    assert sorted(zip(np.repeat(whole.start, whole.windows) + rd._spans(whole.windows), whole.names[whole.digit].repeat(whole.windows))) == \
        sorted(zip(np.repeat(cut.start, cut.windows) + rd._spans(cut.windows), cut.names[cut.digit].repeat(cut.windows)))


def test_kept_texts(spark):
    p = "the quick brown fox jumps over the lazy dog and keeps running far away. "
    df = spark.createDataFrame([(1, "A " + p), (2, "B " + p + "tail"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in rd.remove_repeats(df).collect()} == {1: "A " + p, 2: "Btail", 3: ""}


def test_radix_order_of_windows():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    data[200:330] = data[20:150]
    start = np.arange(351)
    ids = rng.integers(0, 90, 351)
    got = rd.smallest_ids(data, start, np.zeros(351, np.int64), ids)
    windows = [data[s:s + 50].tobytes() for s in start]
    assert got.tolist() == [min(i for w, i in zip(windows, ids) if w == own) for own in windows]
