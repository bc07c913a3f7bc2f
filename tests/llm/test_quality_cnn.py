"""The network: scoring equals the training-time forward pass, and it tells held-out texts apart."""

import math

import numpy as np
import pytest
from messy import frame

from tomefold.llm import quality_cnn as q
from tomefold.llm.common import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, q.train(q.training_sample(docs, labels.where(~held_out(labels["doc_id"]))))


def test_chunks_cover_all_places():
    for n in (1, 7, 8, 255, 256, 263, 264, 519, 520, 775, 776, 5000):
        data = q.padded(bytes(i % 251 for i in range(n)))
        seen = set()
        at = 0
        for chunk in q.chunks_of(data):
            assert chunk.tobytes() == data[at:at + len(chunk)].tobytes()
            seen |= set(range(at, at + len(chunk) - q.WIDTH + 1))
            at += q.HALF
        assert seen == set(range(len(data) - q.WIDTH + 1))


def test_scorer_equals_forward_pass(fitted, monkeypatch):
    _, _, model = fitted
    scorer = q.Scorer(model)
    rng = np.random.default_rng(1)
    for text in [None, "", "a", "é漢𝄞", "".join(map(chr, rng.integers(32, 500, 3000))), "abc " * 2000]:
        chunks = q.chunks_of(q.padded((text or "").encode()))
        z = q._forward(model, chunks)[3]
        for block in (q.HALF, 4 * q.HALF, 256 * q.HALF):
            monkeypatch.setattr(q, "BLOCK", block)
            assert math.isclose(scorer.score(text), 1 / (1 + math.exp(-z)), rel_tol=1e-4, abs_tol=1e-5)


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    label = {r.doc_id: r.quality for r in labels.collect()}
    got = [(r.score, label[r.doc_id]) for r in q.classify(docs, model).collect() if r.held_out and r.doc_id in label]
    good, bad = ([s for s, y in got if y == k] for k in (1, 0))
    assert good and bad
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.9, auc


def test_messy(spark, fitted):
    _, labels, model = fitted
    docs = frame(spark)
    got = q.classify(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1)}) == 1  # null and empty
    none = labels.limit(0)
    assert q.train(q.training_sample(docs, none)) is None
    assert {r.score for r in q.classify(docs, None).collect()} == {0.5}
    assert q.classify(frame(spark, empty=True), model).count() == 0
    odd = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (3, None), (3, 1), (4, 0)], "doc_id long, quality long")
    assert sorted(y for _, y in q.training_sample(docs, odd)) == [0, 0, 1, 1]  # row 3 stands twice
