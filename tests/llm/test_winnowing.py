"""Fingerprints against a window-by-window count."""

import hashlib
import random

import pytest
from messy import frame

from tomefold.llm import winnowing as wn

MASK = (1 << 64) - 1


def mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ (h >> 31)


def brute(text, k=wn.K, w=wn.WINDOW):
    codes = [ord(c) for c in text]
    if not codes:
        return []
    k = min(k, len(codes))
    hashes = []
    for i in range(len(codes) - k + 1):
        h = 0
        for c in codes[i:i + k]:
            h = (h * wn._BASE + c + 1) & MASK
        hashes.append(mix(h))
    w = min(w, len(hashes))
    out = []
    for s in range(len(hashes) - w + 1):
        low = min(hashes[s:s + w])
        at = max(j for j in range(s, s + w) if hashes[j] == low)
        if not out or out[-1][0] != at:
            out.append((at, hashes[at] & 0xFFFFFFFF))
    return out


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_marks(documents, monkeypatch, block):
    monkeypatch.setattr(wn, "BLOCK", block)
    some = [r.text[:1200] for r in documents.orderBy("doc_id").limit(6).collect()]
    for text in ["", "a", "ab" * 300, "abc" * 20, "𝄞é漢" * 60, *some]:
        at, h = wn.winnow(text)
        assert list(zip(at.tolist(), h.tolist())) == brute(text)


def test_match_guarantee():
    rng = random.Random(4)
    letters = "abcdefghij "
    passage = "".join(rng.choice(letters) for _ in range(wn.K + wn.WINDOW - 1))
    for _ in range(20):
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) + passage + "tail" * rng.randint(0, 50)
                for _ in range(2))
        assert set(wn.winnow(a)[1].tolist()) & set(wn.winnow(b)[1].tolist())


def test_short_texts_share_marks_with_their_edits():
    rng = random.Random(5)
    for n in range(62, 256):
        a, b = ("".join(rng.choice("abcdefghij ") for _ in range(n)) for _ in range(2))
        marks = [set(wn.winnow(t)[1].tolist()) for t in (a, wn.edited_text(a, b))]
        assert wn.likeness(*marks) > 0


def check(rows, got):
    by = {r[0]: r[1] or "" for r in rows}
    order = sorted(by, reverse=True)
    found = {g.doc_id: g for g in got}
    assert len(got) == len(rows)
    for i, d in enumerate(order):
        text, after = by[d], by[order[(i + 1) % len(order)]]
        edited = wn.edited_text(text, after)
        g = found[d]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.fingerprint == ",".join(f"{p}:{h:08x}" for p, h in zip(*(x.tolist() for x in wn.winnow(text))))
        own, nxt, ed = (set(wn.winnow(t)[1].tolist()) for t in (text, after, edited))
        assert g.near_next == wn.likeness(own, nxt) and g.near_edited == wn.likeness(own, ed)


def test_documents(documents):
    check([(r.doc_id, r.text) for r in documents.collect()], wn.fingerprints(documents).collect())


def test_few_rows(spark):
    for rows in ([(1, "alone in the table")], [(5, "b" * 50), (9, None)], [(i % 50, f"text {i % 50}") for i in range(50)]):
        check(rows, wn.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_messy(spark):
    got = wn.fingerprints(frame(spark)).collect()
    assert len(got) == frame(spark).count()
    by = {}
    for g in got:
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        if g.n_chars == 0:
            assert g.fingerprint == ""
        by.setdefault((g.doc_id, g.n_chars), set()).add(g.fingerprint)
    assert all(len(v) == 1 for k, v in by.items() if k[0] is not None)
    assert wn.fingerprints(frame(spark, empty=True)).count() == 0
