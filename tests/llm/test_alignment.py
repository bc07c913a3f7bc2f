"""Alignment against whole-text encodings and counts by plain dictionaries."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from messy import frame

from tomefold.llm import alignment as al
from tomefold.llm.perfect_hash import PerfectHash
from tomefold.llm.tokens import default_path

A, B = default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")
TRICKY = ["a\nb c", "foo bar\nbaz. qux", " lead", "trail ", "x  y", "tab\tx", "\n\nq", "<|endoftext|> <s> </s>", "café naïve 漢字 𝄞", "a▁b c",
          "▁", "\x00 nul", "=" * 300, "1234567 89 0x0A <0x0A>", "It's we'll 'tis", "ﬁ é é", "a b " * 200, "\r\n", "😀😀 😀", "▁x y"]


@given(st.sets(st.integers(0, 1 << 40), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.int64)
    made = PerfectHash.of(keys)
    index = made.index(keys)
    assert sorted(index.tolist()) == list(range(len(keys)))
    again = PerfectHash(made.sizes, made.bits)
    assert again.index(keys[::-1]).tolist() == index[::-1].tolist()


def brute_groups(text):
    """[(A ids, B ids)] of a text; None without tokens."""
    if not text:
        return None
    enc = al.tokenizers(A, B)
    a, b = enc.a.encode(" " + text, add_special_tokens=False).ids, enc.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(enc.bytes_a[i] for i in a) != raw or b"".join(enc.bytes_b[i] for i in b) != raw:
        return None
    ends_a, ends_b = np.cumsum([len(enc.bytes_a[i]) for i in a]), np.cumsum([len(enc.bytes_b[i]) for i in b])
    cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    groups = [([], []) for _ in cuts]
    for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
        for i, end in zip(ids, ends.tolist()):
            groups[bisect_left(cuts, end)][side].append(i)
    return groups


def expected(texts):
    groups = [brute_groups(t) for t in texts]
    held = Counter(p for g in groups if g for p in {(x, y) for a, b in g for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for g in groups:
        links = [(x, y) for a, b in g or [] for x in a for y in b]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out.append((sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(links),
                    sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links),
                    hashlib.sha256(spelled.encode()).hexdigest() if g else ""))
    return out


def check(df):
    rows = df.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *e) for r, e in zip(rows, expected([r["text"] for r in rows])))
    assert Counter(tuple(r) for r in al.align(df, A, B).collect()) == want


def test_whole_table(documents):
    check(documents)


def test_tricky_and_messy_rows(spark):
    check(spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    check(frame(spark))
    assert al.align(frame(spark, empty=True), A, B).count() == 0


def test_small_shards_rounds_blocks_and_memo(spark, documents, monkeypatch):
    for name, value in (("SHARD_PAIRS", 300), ("ROUND_SHARDS", 4), ("FAN_IN", 2), ("BLOCK", 64), ("CHARS_AT_ONCE", 3000), ("BYTES_AT_ONCE", 2000)):
        monkeypatch.setattr(al, name, value)
    some = documents.where("doc_id < 60").repartition(9)
    check(some.union(some.where("doc_id < 5")))


@pytest.mark.parametrize("memo", [0, 50, 500_000])
def test_units_give_the_ids_of_whole_texts(monkeypatch, memo, documents):
    texts = [r["text"] for r in documents.select("text").limit(60).collect()] + TRICKY + [None, ""]
    enc = al.Pair(A, B)
    monkeypatch.setattr(al, "MEMO_UNITS", memo)
    want = [(enc.encode(t) if t else None) or ((), ()) for t in texts]
    want = [(list(map(int, a)), list(map(int, b))) for a, b in want]

    def got(some):
        (a, n_a), (b, n_b) = enc.ids(some)
        return [(x.tolist(), y.tolist()) for x, y in zip(np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1]))]

    for _ in range(2):
        assert got(texts) == want
        assert [got([t])[0] for t in texts] == want


def test_large_groups_are_linked_by_distinct_ids(spark, monkeypatch):
    monkeypatch.setattr(al, "LARGE_GROUP", 1)
    check(spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
